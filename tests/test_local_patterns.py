"""Codes of patches against a loop, one patch after the other."""

import numpy as np
import pytest

from lumenplex.operators import local_patterns
from lumenplex.operators.tiled import kernel


def blur_matrix(box, sigmas):
    out = np.eye(1)
    for n, s in zip(box, sigmas):
        one = sum(w * np.eye(n, k=d) for d, w in kernel(s))
        out = np.kron(out, one)
    return out


def one_pair(x):
    u, s, vt = np.linalg.svd(x)
    sign = -1 if u[:, 0].sum() < 0 else 1
    return np.maximum(sign * u[:, 0] * s[0], 0), np.maximum(sign * vt[0], 0)


def blurry_loop(x, k, steps=5):
    g, f = one_pair(x)
    loss = lambda: ((x - np.outer(g, k @ f)) ** 2).sum()
    losses = [loss()]
    for _ in range(steps):
        gamma, phi = (g @ g) * k.T @ k, k.T @ (x.T @ g)
        s = phi - gamma @ f
        s[(f <= 0) & (s <= 0)] = 0
        if s @ gamma @ s > 1e-12:
            rate, was, old = (s @ s) / (s @ gamma @ s), losses[-1], f
            for _ in range(10):
                f = np.maximum(old + rate * s, 0)
                if loss() < was:
                    break
                f, rate = old, rate * 0.9
        losses.append(loss())
        if (k @ f) @ (k @ f) > 1e-12:
            g = np.maximum(x @ (k @ f) / ((k @ f) @ (k @ f)), 0)
        losses.append(loss())
    return g, f, losses


def one_code(x, rounds, fit, good_rounds, cosine, whole):
    load = fit(x)[0].reshape(rounds, -1)
    code = [int(r.argmax()) if r.max() > 2 * r.mean() else -1 for r in load]
    lit = [r * load.shape[1] + c for r, c in enumerate(code) if c >= 0]
    if len(lit) < int(rounds * good_rounds):
        return "badrounds", code, None
    if not lit:
        return "badr2", code, 0.0
    g, f = fit(x[lit])[:2]
    met = (x[lit] * np.outer(g, f)).sum() / max(np.sqrt((g @ g) * (f @ f) * ((x if whole else x[lit]) ** 2).sum()), 1e-300)
    return "success" if met >= cosine else "badr2", code, met


def simulated(rng, b, rounds, channels, voxels):
    x = 0.05 * rng.random((b, rounds * channels, voxels))
    for i in range(b):
        shape = rng.random(voxels)
        for r in range(rounds):
            if rng.random() < 0.85:
                x[i, r * channels + rng.integers(channels)] += rng.uniform(0.5, 2) * shape
    return x


@pytest.mark.parametrize(("sigmas", "whole"), [(None, True), (None, False), ([1, 0], True)])
def test_codes_equal_a_loop(sigmas, whole):
    rng = np.random.default_rng(1)
    rounds, box = 7, (3, 5)
    x = simulated(rng, 60, rounds, 4, 15)
    k = blur_matrix(box, sigmas or [0, 0])
    fit = one_pair if sigmas is None else lambda y: blurry_loop(y, k)
    status, code, r2 = local_patterns.codes_of(x, box, rounds, 2.0, 0.8, 0.9, sigmas, whole)
    for i in range(len(x)):
        want = one_code(x[i], rounds, fit, 0.8, 0.9, whole)
        assert (status[i], code[i].tolist()) == want[:2], i
        assert np.isnan(r2[i]) if want[2] is None else abs(r2[i] - want[2]) < 1e-7
    assert len(set(status)) > 1 and 5 in (code >= 0).sum(1)[np.array(status) != "badrounds"]  # int(0.8 * 7) rounds suffice


def test_blurry_patches_equal_a_loop():
    rng = np.random.default_rng(2)
    box, sigmas = (5, 3, 3), [1, 1, 0]
    x = simulated(rng, 12, 4, 3, 45)
    g, f, losses = local_patterns.blurry_rank_one(x, box, sigmas, 6)
    k = blur_matrix(box, sigmas)
    for i in range(len(x)):
        want = blurry_loop(x[i], k, 6)
        np.testing.assert_allclose(g[i], want[0], atol=1e-8)
        np.testing.assert_allclose(f[i], want[1], atol=1e-8)
        np.testing.assert_allclose([v[i] for v in losses], want[2], rtol=1e-8)
        assert want[2][-1] <= want[2][0]


def test_blobs_near_the_border_are_left_out(spark):
    rows = [(0, a, b, 5.0) for a, b in ((0, 10), (10, 10), (19, 4), (18, 15))]
    stack = spark.createDataFrame(rows, "n int, m0 int, m1 int, v double")
    got = {(r.m0, r.m1) for r in local_patterns.blobs(stack, ["m0", "m1"], 0.2, inside={"m0": (20, 1), "m1": (20, 5)}).collect()}
    assert got == {(10, 10)}


def test_patches_keep_their_places(spark):
    stack = spark.createDataFrame([(0, 5, 5, 1.0), (0, 5, 6, 2.0), (0, 6, 6, 9.0), (1, 4, 5, 3.0)], "n int, m0 int, m1 int, v double")
    got = local_patterns.patches(stack, spark.createDataFrame([(5, 5)], "m0 int, m1 int"), {"m0": 1, "m1": 1})
    assert {(r.n, r.voxel): r.v for r in got.collect()} == {(0, 4): 1, (0, 5): 2, (1, 1): 3}
