"""The blurred model against a loop over whole arrays with explicit matrices."""

import numpy as np
import pytest

from lumenplex.operators import blurred_model

SIZES = {"m0": 17, "m1": 11}


def blur_matrix(size, sigma):
    if not sigma:
        return np.eye(size)
    d = np.arange(-3 * sigma, 3 * sigma + 1)
    w = np.exp(-(d**2) / (2 * sigma**2))
    return sum(x * np.eye(size, k=k) for k, x in zip(d, w / w.sum()))


def least_squares(gamma, phi):
    """Non-negative minimum of y gamma y / 2 - phi y, by trying every set of free entries."""
    n = len(phi)
    best = (0.0, np.zeros(n))
    gamma = gamma + 1e-10 * np.eye(n)
    for bits in range(1, 1 << n):
        free = [i for i in range(n) if bits >> i & 1]
        y = np.zeros(n)
        y[free] = np.linalg.solve(gamma[np.ix_(free, free)], phi[free])
        if (y >= 0).all():
            best = min(best, (0.5 * y @ gamma @ y - phi @ y, y), key=lambda t: t[0])
    return best[1]


def loop(x, book, k, penalty, plan):
    """x: voxels x rounds x channels; k: the blur as a matrix; plan: names of updates, in order."""
    m, r, c = x.shape
    j = book.shape[2]
    f, a, b, gains, mixing = np.zeros((m, j)), np.zeros(m), np.zeros((r, c)), np.ones((r, c)), np.eye(c)
    losses = []
    for what in plan:
        loads = np.einsum("rc,ck,rkj->rcj", gains, mixing, book).reshape(r * c, j)
        allowed = (x - a[:, None, None] - b - penalty).reshape(m, r * c)
        if what == "F":
            linear = k.T @ allowed @ loads
            apply = lambda y: k.T @ (k @ (y @ loads.T)) @ loads
            value = lambda y: 0.5 * (y * apply(y)).sum() - (linear * y).sum()
            s = linear - apply(f)
            s[(f <= 0) & (s <= 0)] = 0
            if (s**2).sum() > 1e-10:
                rate, was = ((linear * s).sum() - (f * apply(s)).sum()) / (s * apply(s)).sum(), value(f)
                for _ in range(10):
                    if value(np.maximum(f + rate * s, 0)) < was:
                        f = np.maximum(f + rate * s, 0)
                        break
                    rate *= 0.9
        z = np.einsum("mj,rcj->mrc", k @ f, book)
        if what == "gains":
            mixed = np.einsum("ck,mrk->mrc", mixing, z)
            up, down = (mixed * allowed.reshape(x.shape)).sum(0), (mixed**2).sum(0)
            gains = np.maximum(np.where(down > 1e-10, up / np.where(down > 1e-10, down, 1), gains), 1e-10)
        if what == "mixing":
            for i in range(c):
                gamma = np.einsum("r,mrk,mrl->kl", gains[:, i] ** 2, z, z)
                mixing[i] = least_squares(gamma, np.einsum("r,mr,mrk->k", gains[:, i], allowed.reshape(x.shape)[:, :, i], z))
        shown = np.einsum("rc,ck,mrk->mrc", gains, mixing, z)
        if what == "a":
            a = np.maximum((x - shown - b).mean((1, 2)), 0)
        if what == "b":
            b = np.maximum((x - shown - a[:, None, None]).mean(0), 0)
        losses.append(0.5 * ((x - shown - a[:, None, None] - b) ** 2).sum() + penalty * shown.sum())
    return f, a, b, gains, mixing, losses, shown


def simulated(seed=0, rounds=3, channels=3, j=4, sigmas=(1, 1)):
    rng = np.random.default_rng(seed)
    book = (rng.random((rounds, channels, j)) < 0.4) + 0.0
    book[0, np.arange(j) % channels, np.arange(j)] = 1
    k = np.kron(*[blur_matrix(n, s) for n, s in zip(SIZES.values(), sigmas)])
    m = len(k)
    f = np.where(rng.random((m, j)) < 0.05, rng.uniform(2, 9, (m, j)), 0)
    mixing = np.eye(channels) + np.array([[0, 0.4, 0], [0, 0, 0], [0.3, 0, 0]])[:channels, :channels]
    x = np.einsum("ck,rkj,mj->mrc", mixing, book, k @ f) + 0.2 + rng.normal(0, 0.02, (m, rounds, channels))
    return x, book, k, f, mixing


def frames(spark, x, book):
    m, r, c = x.shape
    rows = [(n, i // 11, i % 11, float(v)) for i in range(m) for n, v in enumerate(x[i].ravel()) if v]
    codes = [(n, j, float(v)) for n, own in enumerate(book.reshape(r * c, -1)) for j, v in enumerate(own)]
    return spark.createDataFrame(rows, "n int, m0 int, m1 int, v double"), spark.createDataFrame(codes, "n int, j int, c double")


@pytest.mark.parametrize(("sigmas", "inner", "penalty"), [((1, 1), (5, 4), 0.05), ((2, 0), (3, 20), 0.0), ((0, 0), (17, 3), 0.1)])
def test_fit_equals_a_loop(spark, sigmas, inner, penalty):
    x, book, k, _, _ = simulated(1, sigmas=sigmas)
    stack, codes = frames(spark, x, book)
    m = blurred_model.model(stack, codes, SIZES, 3, dict(zip(SIZES, sigmas)), penalty, dict(zip(SIZES, inner)))
    plan = ["F", *["F", "gains", "mixing", "a", "b"] * 2]
    losses = []
    for what in plan:
        m.update(what)
        losses.append(m.loss())
    f, a, b, gains, mixing, want, shown = loop(x, book, k, penalty, plan)
    np.testing.assert_allclose(losses, want, rtol=1e-8)
    np.testing.assert_allclose(m.gains, gains, rtol=1e-7)
    np.testing.assert_allclose(m.mixing, mixing, atol=1e-7)
    np.testing.assert_allclose(m.offsets, b.ravel(), atol=1e-8)
    got = np.zeros_like(f)
    for r in m.density().collect():
        got[r.m0 * 11 + r.m1, r.j] = r.v
    np.testing.assert_allclose(got, f * m.loads.sum(0), atol=1e-7)
    both = np.zeros((2, *x.shape))
    for part, df in zip(both, (m.reconstruction(), m.backgrounds())):
        for r in df.collect():
            part.reshape(len(x), -1)[r.m0 * 11 + r.m1, r.n] = r.v
    np.testing.assert_allclose(both[1], a[:, None, None] + b + 0 * x, atol=1e-8)
    np.testing.assert_allclose(both[0], shown + both[1], atol=1e-7)
    assert want[-1] < want[0] and all(later <= was * (1 + 1e-12) for was, later in zip(want, want[1:]))


def test_colour_mixing_is_recovered(spark):
    x, book, k, f, mixing = simulated(2, sigmas=(1, 0))
    stack, codes = frames(spark, x, book)
    m = blurred_model.fit(stack, codes, SIZES, 15, 3, {"m0": 1}, gains=False, mixing=True, inner={"m0": 6, "m1": 11})
    scaled = m.mixing / np.diag(m.mixing)
    assert np.abs(scaled - mixing / np.diag(mixing)).max() < 0.05


@pytest.mark.parametrize("seed", range(20))
def test_small_nonnegative_solves(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(9, 1 + seed % 6))
    gamma, phi = a.T @ a, rng.normal(size=a.shape[1])
    np.testing.assert_allclose(blurred_model.nonnegative(gamma, phi), least_squares(gamma, phi), atol=1e-9)


def test_signal_left_by_earlier_rounds():
    book = np.array([[[1.0, 0], [0, 2]], [[0, 1], [0, 0]], [[0, 0], [4, 0]]])
    got = blurred_model.phased(book, np.array([0.5, 0.25]))
    assert got.tolist() == [[[1, 0], [0, 2]], [[0.5, 1], [0, 0.5]], [[0.25, 0.5], [4, 0.125]]]


def test_a_stack_without_rows_has_no_densities(spark):
    x, book, *_ = simulated(1)
    stack, codes = frames(spark, x, book)
    m = blurred_model.fit(stack.limit(0), codes, SIZES, 2, 3, {"m0": 1})
    assert m.density().count() == 0 and m.loss() == 0
