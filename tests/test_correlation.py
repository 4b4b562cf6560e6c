"""Correlations at all offsets against plain sums."""

import itertools

import numpy as np
import pytest

from lumenplex.operators import correlation


def long(spark, x):
    axes = [f"m{i}" for i in range(x.ndim - 1)]
    rows = [(*map(int, at), float(x[at])) for at in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in ("n", *axes)) + ", v double")


def by_hand(x, y, cut):
    inner = np.zeros_like(y)
    box = tuple(slice(c, n - c) for c, n in zip(cut, y.shape))
    inner[box] = y[box]
    out = {}
    for t in itertools.product(*[range(1 - n + c, n - c) for n, c in zip(x.shape, cut)]):
        total = 0.0
        for m in zip(*np.nonzero(inner)):
            at = tuple(i + j for i, j in zip(m, t))
            if all(0 <= i < n for i, n in zip(at, x.shape)):
                total += x[at] * inner[m]
        out[t] = total
    return out


@pytest.mark.parametrize(("shape", "cut", "demean"), [((9,), (0,), True), ((6, 5), (0, 0), True), ((6, 5), (1, 2), True), ((6, 5), (0, 0), False), ((4, 3, 5), (1, 0, 1), True)])
def test_products_at_all_offsets(spark, shape, cut, demean, monkeypatch):
    monkeypatch.setattr(correlation, "TOGETHER", 40)  # several groups an axis
    rng = np.random.default_rng(len(shape))
    x = np.where(rng.random((3, *shape)) < 0.6, rng.normal(size=(3, *shape)), 0)
    axes = [f"m{i}" for i in range(len(shape))]
    got = correlation.products_of_frames(long(spark, x), dict(zip(axes, shape)), [(0, 1), (2, 0), (1, 1)], dict(zip(axes, cut)), demean).collect()
    means = x.mean(tuple(range(1, x.ndim)), keepdims=True) if demean else 0
    for a, b in ((0, 1), (2, 0), (1, 1)):
        own = {tuple(r[f"t_{c}"] for c in axes): r.product for r in got if (r.f1, r.f2) == (a, b)}
        want = by_hand((x - means)[a], (x - means)[b], cut)
        assert own.keys() == want.keys()
        np.testing.assert_allclose([own[t] for t in want], list(want.values()), atol=1e-9)


def test_impulses_are_lined_up(spark):
    x = np.zeros((2, 8, 12, 10))
    x[0, 2, 9, 4], x[1, 7, 3, 1] = 1, 1
    sizes = dict(zip(("m0", "m1", "m2"), x.shape[1:]))
    best = correlation.offsets_of_pairs(correlation.products_of_frames(long(spark, x), sizes, [(0, 1)]), list(sizes)).first()
    assert (best.t_m0, best.t_m1, best.t_m2) == (-5, 6, 3)


def test_frames_are_put_in_line(spark):
    rng = np.random.default_rng(5)
    scene, shifts = rng.random((60, 50)), np.array([[0, 0], [3, -2], [-4, 5], [1, 1]])
    x = np.stack([scene[10 + a : 40 + a, 10 + b : 35 + b] for a, b in shifts])
    got = correlation.frame_translations(long(spark, x), [0, 1, 2, 3], {"m0": 30, "m1": 25})
    t = np.zeros((4, 2))
    for r in got.collect():
        t[r.n, r.axis] = r.t
    # What a frame shows at m is at m + shift of the scene: translations differ as shifts do.
    np.testing.assert_allclose(t - t[0], shifts - shifts[0])
