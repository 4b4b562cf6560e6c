"""Operators on small inputs with known results, after the reference's own checks and beyond them."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenplex.functions import columns, rectangles
from lumenplex.operators import codebooks, density, evidence, geometry, grids, pointclouds, registration, tiled, tiling


def stack(spark, x, axes=("m0", "m1", "m2")):
    """LONG of an array frames x axes."""
    at = np.argwhere(np.ones_like(x, bool))
    rows = [(*map(int, k), float(x[tuple(k)])) for k in at]
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in ("n", *axes)) + ", v double")


def array(df, shape, axes=("n", "m0", "m1", "m2"), v="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[a] for a in axes)] = np.nan if r[v] is None else r[v]
    return out


def test_minmax_spans_zero_to_one(spark):
    x = np.random.default_rng(0).normal(size=(3, 5, 6, 7))
    by_frame = array(grids.minmax(stack(spark, x), ["n"]), x.shape)
    assert by_frame.min((1, 2, 3)).tolist() == [0] * 3 and by_frame.max((1, 2, 3)).tolist() == [1] * 3
    fibres = array(grids.minmax(stack(spark, x), ["n", "m2"]), x.shape)
    assert np.allclose(fibres.min((1, 2)), 0) and np.allclose(fibres.max((1, 2)), 1)


def test_minmax_of_a_constant_is_null(spark):
    assert np.isnan(array(grids.minmax(stack(spark, np.ones((1, 2, 2, 1))), ["n"]), (1, 2, 2, 1))).all()


def test_background_keeps_rows(spark):
    x = np.random.default_rng(1).normal(size=(3, 5, 6, 7))
    out = grids.subtract_background(stack(spark, x), {"m0": 5, "m1": 6, "m2": 7}, {"m0": 2.0, "m1": 3.0, "m2": 4.0})
    assert out.count() == x.size and out.where("v < 0").isEmpty()


def test_blur_keeps_the_sum_inside(spark):
    x = np.random.default_rng(2).normal(size=(1, 200, 30))
    x[:, :50] = x[:, -50:] = 0
    out = grids.gaussian(stack(spark, x, ("m0", "m1")), {"m0": 200, "m1": 30}, {"m0": 3.0})
    assert abs(out.agg(F.sum("v")).first()[0] - x.sum()) < 1e-8


def test_tiled_blur_equals_untiled(spark):
    x = np.random.default_rng(3).normal(size=(1, 60, 1))
    df = stack(spark, x, ("m0", "m1"))
    whole = array(grids.gaussian(df, {"m0": 60}, {"m0": 1.5}), x.shape, ("n", "m0", "m1"))
    tiles = tiling.tiles(spark, {"m0": 60}, {"m0": 20}, {"m0": 5})
    dealt = tiling.deal(df, tiles, ["m0"]).select("n", "tile", "put_start_m0", "put_stop_m0", "m0", "m1", "v")
    own = tiling.owned(grids.gaussian(dealt, {"m0": 60}, {"m0": 1.5}), ["m0"])
    assert np.allclose(array(own, x.shape, ("n", "m0", "m1")), whole)


def convolved(df, sizes, sigmas):
    for axis, sigma in sigmas.items():
        df = grids.convolve(df, axis, sizes[axis], tiled.kernel(sigma))
    return df


def test_blur_of_small_tiles_equals_scattered_sums(spark):
    rng = np.random.default_rng(31)
    rows = [(int(n), int(a), int(b), float(rng.normal())) for n, a, b in {tuple(x) for x in rng.integers(0, (20, 50, 37), size=(400, 3))}]
    df, sizes, sigmas = spark.createDataFrame(rows, "n int, m0 int, m1 int, v double"), {"m0": 50, "m1": 37}, {"m0": 1.3, "m1": 0.8}
    kernels = [tiled.kernel(s) for s in sigmas.values()]
    got = tiled.over_tiles(df, sizes, {"m0": 4, "m1": 3}, tiled.gaussian_step(kernels), inner={"m0": 9, "m1": 11})
    want = {(r.n, r.m0, r.m1): r.v for r in convolved(df, sizes, sigmas).collect()}
    found = {(r.n, r.m0, r.m1): r.v for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_reflecting_blur(spark):
    x = np.random.default_rng(32).normal(size=(2, 30, 25))
    got = array(grids.gaussian(stack(spark, x, ("m0", "m1")), {"m0": 30, "m1": 25}, {"m0": 1.5, "m1": 0.7}, truncate=4.0, border="reflect"), x.shape, ("n", "m0", "m1"))
    want = x
    for axis, sigma in ((1, 1.5), (2, 0.7)):
        r = int(4 * sigma + 0.5)
        w = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2))
        pad = np.pad(want, [(r, r) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
        want = sum(wk / w.sum() * np.take(pad, range(k, k + x.shape[axis]), axis) for k, wk in enumerate(w))
    assert np.allclose(got, want)


def test_a_blur_reads_its_source_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select((F.col("event_id") % 3).cast("int").alias("n"), (F.col("user_id") % 50).cast("int").alias("m0"), F.hour("ts").alias("m1"), F.col("value").alias("v"))
    plan = grids.subtract_background(df, {"m0": 50, "m1": 24}, {"m0": 2.0, "m1": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange ") == 1


def test_crop_pads_and_overwrite_ignores_what_is_beyond(spark):
    df = stack(spark, np.arange(6.0).reshape(1, 2, 3), ("m0", "m1"))
    got = array(grids.crop(df, {"m0": 1, "m1": -1}, {"m0": 3, "m1": 2}, 9.0), (1, 2, 3), ("n", "m0", "m1"))
    assert got.tolist() == [[[9, 3, 4], [9, 9, 9]]]
    new = spark.createDataFrame([(0, 0, 0, 7.0, 1), (0, 0, 0, 8.0, 2), (0, 5, 0, 1.0, 3)], "n int, m0 int, m1 int, v double, k int")
    assert array(grids.overwrite(df, new, {"m0": 2, "m1": 3}, "k"), (1, 2, 3), ("n", "m0", "m1")).tolist() == [[[8, 1, 2], [3, 4, 5]]]


def test_doublenorm(spark):
    x = np.abs(np.random.default_rng(33).normal(size=(1, 20, 20)))
    got = array(grids.doublenorm(stack(spark, x, ("m0", "m1")), {"m0": 20, "m1": 20}, 1.0, 1.0), x.shape, ("n", "m0", "m1"))
    y = x / x.max()
    blur = y
    for axis in (1, 2):
        blur = tiled.blurred(blur, axis, tiled.kernel(1.0))
    assert np.allclose(got, y / (1 + blur))


def test_peaks_of_three_impulses(spark):
    x = np.zeros((3, 5, 6, 7))
    x[0, 1, 2, 3], x[1, 2, 3, 4], x[2, 3, 4, 5] = 1, 1.5, 0.001
    found = grids.peaks(stack(spark, x).withColumnRenamed("n", "j"), {"m0": 1, "m1": 1, "m2": 1}, 0.5)
    assert {(r.j, r.m0, r.m1, r.m2) for r in found.collect()} == {(0, 1, 2, 3), (1, 2, 3, 4)}


def test_peaks_keep_plateaus(spark):
    x = np.ones((1, 3, 3, 1))
    assert grids.peaks(stack(spark, x).withColumnRenamed("n", "j"), {"m0": 1, "m1": 1}, 0.5).count() == 9


def reference_shift(x, t, size, method):
    n, f = len(x), int(np.floor(t))
    p = t - f
    at = lambda i: x[i] if 0 <= i < n else 0.0
    if method == "nearest":
        return np.array([at(k + int(np.rint(t))) for k in range(size)])
    if method == "linear":
        return np.array([(1 - p) * at(k + f) + p * at(k + f + 1) for k in range(size)])
    slope = lambda i: 0.0 if not 0 <= i < n else x[1] - x[0] if i == 0 else x[n - 1] - x[n - 2] if i == n - 1 else (x[i + 1] - x[i - 1]) / 2
    h = ((1 + 2 * p) * (1 - p) ** 2, p * (1 - p) ** 2, p * p * (3 - 2 * p), -p * p * (1 - p))
    return np.array([h[0] * at(k + f) + h[1] * slope(k + f) + h[2] * at(k + f + 1) + h[3] * slope(k + f + 1) for k in range(size)])


@pytest.mark.parametrize("method", ["nearest", "linear", "hermite"])
@pytest.mark.parametrize("t", [0.0, 2.5, 2.3, -1.7, 3.0])
def test_shift(spark, method, t):
    x = np.random.default_rng(4).normal(size=20)
    df = stack(spark, x[None], ("m0",))
    got = array(grids.shift(df, "m0", F.lit(t), 8, method, 20), (1, 8), ("n", "m0"))[0]
    assert np.allclose(got, reference_shift(x, t, 8, method))


def test_regions(spark):
    t = spark.createDataFrame([(0, 0, 0.0), (1, 0, 2.3)], "n int, axis int, t double")
    got = lambda mode, method: sorted((r.n, round(r.t, 6), r.size) for r in registration.region(t, {0: 10}, mode, method).collect())
    assert got("valid", "linear") == [(0, 0.0, 7), (1, 2.3, 7)]
    assert got("valid", "hermite") == [(0, 1.0, 5), (1, 3.3, 5)]
    assert got("full", "linear") == [(0, -2.3, 13), (1, 0.0, 13)]


def test_correlation_of_two_impulses(spark):
    a, b = np.zeros((1, 20, 30, 40)), np.zeros((1, 20, 30, 40))
    a[0, 2, 9, 4] = b[0, 7, 3, 11] = 1
    rows = [stack(spark, x).where("v <> 0") for x in (a, b)]
    best = registration.best_offset(registration.products_at_offsets(*rows, ["m0", "m1", "m2"]), ["m0", "m1", "m2"]).first()
    assert (best.t_m0, best.t_m1, best.t_m2) == (-5, 6, -7)


def test_impulses_meet_after_registration(spark):
    rng = np.random.default_rng(5)
    at = rng.integers(5, 15, size=(5, 3))
    rows = [(n, *map(int, p), 1.0) for n, p in enumerate(at)]
    df = spark.createDataFrame(rows, "n int, m0 int, m1 int, m2 int, v double")
    t = registration.centred(registration.pair_offsets(df, ["m0", "m1", "m2"]))
    moved = registration.apply_translations(df, t, ["m0", "m1", "m2"], [20, 20, 20], "full", "linear")
    per = moved.where("v > 1e-9").groupBy("m0", "m1", "m2").agg(F.count("*").alias("k"), F.product("v").alias("p"))
    assert abs(per.where("k = 5").agg(F.sum("p")).first()[0] - 1) < 1e-6


def test_affine_fit(spark):
    rng = np.random.default_rng(6)
    rows = [(n, ax, *map(float, p), float([[0.1, -0.2, 3], [0.3, 0.05, -1]][ax] @ np.r_[p, 1]) * (n + 1)) for n in range(2) for p in rng.uniform(0, 9, size=(8, 2)) for ax in range(2)]
    df = spark.createDataFrame(rows, "n int, axis int, x_m0 double, x_m1 double, d double")
    got = {(r.n, r.axis): r.coefficients for r in registration.fit_affines(df, ["m0", "m1"]).collect()}
    assert np.allclose(got[1, 1], [0.6, 0.1, -2])


def test_tile_table():
    t = tiling.axis_tiles(24, 5, 2)
    assert [x[:2] for x in t] == [(0, 7), (3, 12), (8, 17), (13, 22), (18, 24)]
    assert [x[2:4] for x in t] == [(0, 5), (2, 7), (2, 7), (2, 7), (2, 6)]
    assert [x[4:] for x in t] == [(0, 5), (5, 10), (10, 15), (15, 20), (20, 24)]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 200), st.integers(1, 40), st.integers(0, 20))
def test_tiles_partition_the_axis(length, inner, border):
    for rows in (tiling.axis_tiles(length, inner, border), tiling.inside_tiles(length, inner, border)):
        puts = [x[4:] for x in rows]
        assert all(a[1] == b[0] for a, b in zip(puts, puts[1:]))
        assert all(0 <= lo <= lo + g0 < lo + g1 <= hi <= length for lo, hi, g0, g1, *_ in rows)
    assert tiling.axis_tiles(length, inner, border)[-1][5] == length


def test_evidence_worked_example(spark):
    v = spark.createDataFrame([(0, [3.0, 4.0])], "m0 int, obs array<double>")
    c = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.0), (0, 1, 0.0), (1, 1, 0.0)], "n int, j int, c double")
    got = {r.j: r.e for r in evidence.evidence(v, c, 0.05).collect()}
    assert abs(got[0] - 0.594059) < 1e-6 and got[1] is None


def test_singleshot_finds_every_spot(spark):
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 2, size=(15, 5)) + 0.0
    codes[0] = 1
    codes /= np.linalg.norm(codes, axis=0)
    spots = [(5, 5, 0), (15, 30, 1), (25, 12, 2), (35, 40, 3), (44, 22, 4)]
    rows = [(n, a, b, float(codes[n, j] * (1 + 0.2 * j))) for a, b, j in spots for n in range(15)]
    img = spark.createDataFrame(rows, "n int, m0 int, m1 int, v double")
    blurred = grids.gaussian(img, {"m0": 50, "m1": 50}, {"m0": 1.0, "m1": 1.0})
    voxels = evidence.to_voxels(blurred, 15, ["m0", "m1"])
    book = spark.createDataFrame([(n, j, float(codes[n, j])) for n in range(15) for j in range(5)], "n int, j int, c double")
    found = grids.peaks(evidence.evidence(voxels, book, 0.01), {"m0": 1, "m1": 1}, 0.8, value="e")
    truth = spark.createDataFrame(spots, "m0 int, m1 int, j int")
    result = pointclouds.match(truth, found.select("m0", "m1", "j"), 5.0, ["m0", "m1"])
    assert result["fn"].count() == 0 and result["fp"].count() == 0


def test_voxels_and_back(spark):
    x = np.random.default_rng(8).normal(size=(3, 2, 2))
    df = stack(spark, x, ("m0", "m1"))
    assert np.allclose(array(evidence.to_long(evidence.to_voxels(df, 3, ["m0", "m1"])), x.shape, ("n", "m0", "m1")), x)


def test_unknown_entries(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (1, 0, None)], "n int, j int, c double")
    b = spark.createDataFrame([(0, 0, 0.0), (1, 0, 1.0)], "n int, j int, c double")
    assert codebooks.distances(a, b).first().d == 1.0
    assert {(r.n, r.c) for r in codebooks.merge_entries(b, a).collect()} == {(0, 1.0), (1, 1.0)}


def test_wildcard_query(spark):
    lit = [(j, r, int(ch)) for j, code in enumerate(("1020", "1220", "1120", "0020")) for r, ch in enumerate(code)]
    hot = codebooks.onehot(spark.createDataFrame(lit, "j int, r int, ch int"), 3)
    assert sorted(r.j for r in codebooks.query_onehot(hot, "1?20").collect()) == [0, 1, 2]


def test_deduplication_is_greedy_in_order(spark):
    rows = [(n, j, c) for j, code in enumerate(([1.0, None, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 1.0])) for n, c in enumerate(code)]
    got = codebooks.deduplicate(spark.createDataFrame(rows, "n int, j int, c double"))
    assert sorted((r.j, r.n, r.c) for r in got.collect()) == [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 0.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 1.0)]


def one_pass_after_another(book, tolerance):
    names = list(range(len(book)))
    while True:
        kept, of = [], []
        for name, code in zip(names, book):
            d = [np.nansum(np.abs(k - code)) for k in kept]
            if d and min(d) <= tolerance:
                at = d.index(min(d))
                kept[at] = np.where(np.isnan(code), kept[at], code)
            else:
                kept.append(code)
                of.append(name)
        if len(kept) == len(book):
            return dict(zip(of, kept))
        book, names = kept, of


@pytest.mark.parametrize("tolerance, unknown", [(0.0, 0.0), (0.0, 0.2), (1.0, 0.0), (0.25, 0.1)])
def test_deduplication_by_classes_equals_a_loop(spark, tolerance, unknown):
    rng = np.random.default_rng(5)
    book = [np.where(rng.random(9) < unknown, np.nan, c) for c in rng.integers(0, 2, (60, 9)).astype(float)]
    book += book[:5]
    rows = [(n, j, None if np.isnan(c) else float(c)) for j, code in enumerate(book) for n, c in enumerate(code)]
    got: dict = {}
    for r in codebooks.deduplicate(spark.createDataFrame(rows, "n int, j int, c double"), tolerance).collect():
        got.setdefault(r.j, [None] * 9)[r.n] = np.nan if r.c is None else r.c
    want = one_pass_after_another(book, tolerance)
    assert got.keys() == want.keys() and all(np.array_equal(got[j], want[j], equal_nan=True) for j in want)


def test_deduplication_of_an_empty_book(spark):
    assert codebooks.deduplicate(spark.createDataFrame([], "n int, j int, c double")).isEmpty()


def test_divergence_of_empty_sets(spark):
    a = spark.createDataFrame([(0, 0, 1)], "m0 int, m1 int, j int")
    b = spark.createDataFrame([(0, 3, 2)], "m0 int, m1 int, j int")
    assert {(r.j, r.divergence) for r in pointclouds.meanmin_divergence(a, b, ["m0", "m1"]).collect()} == {(1, float("inf")), (2, 0.0)}


def test_boxes(spark):
    one = spark.range(1)
    lit = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    a, b = rectangles.box(lit(0, 0), lit(5, 5)), rectangles.box(lit(3, 7), lit(9, 9))
    r = one.select(rectangles.intersection(a, b).alias("i"), rectangles.is_empty(a).alias("e"), rectangles.is_degenerate(rectangles.box(lit(1, 1), lit(1, 4))).alias("g"), rectangles.product(a, b).alias("p")).first()
    assert r.i.start == r.i.stop == [3, 7] and not r.e and r.g and r.p.stop == [5, 5, 9, 9]


def test_density_loss_never_rises_and_finds_codes(spark):
    rng = np.random.default_rng(9)
    book = rng.uniform(0, 1, size=(8, 3))
    truth = rng.uniform(0, 1, size=(40, 3)) * (rng.uniform(size=(40, 3)) < 0.4)
    x = truth @ book.T
    voxels = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "m0 int, obs array<double>")
    codes = spark.createDataFrame([(n, j, float(book[n, j])) for n in range(8) for j in range(3)], "n int, j int, c double")
    got = density.fit(voxels, codes, 12, gains=False)
    assert all(b <= a + 1e-9 for a, b in zip(got.losses[1:], got.losses[2:]))
    assert got.losses[-1] < 0.2 * 0.5 * (x**2).sum()


def fitted(x, g0, iterations, penalty):
    """The fit of density.fit(), voxel by voxel."""
    n, j = g0.shape
    f, a, b, gain, losses = np.zeros((len(x), j)), np.zeros(len(x)), np.zeros(n), np.ones(n), []
    for _ in range(iterations):
        g = gain[:, None] * g0
        for m in range(len(x)):
            value = lambda y: 0.5 * np.sum((x[m] - a[m] - b - g @ y) ** 2) + penalty * np.sum(g @ y)  # noqa: B023, E731
            down = g.T @ (x[m] - a[m] - b - penalty - g @ f[m])
            down[(f[m] <= 0) & (down <= 0)] = 0
            curve = np.sum((g @ down) ** 2)
            size = np.sum(down**2) / curve if curve > 1e-12 else 0
            for _ in range(10 if size > 0 else 0):
                y = np.maximum(f[m] + size * down, 0)
                if value(y) < value(f[m]):
                    f[m] = y
                    break
                size *= 0.9
        losses.append(0.5 * ((x - a[:, None] - b - f @ g.T) ** 2).sum() + penalty * (f @ g.sum(0)).sum())
        load = f @ g0.T
        gain = np.where((load**2).sum(0) > 1e-10, np.maximum((load * (x - a[:, None] - b - penalty)).sum(0) / np.maximum((load**2).sum(0), 1e-300), 1e-10), gain)
        g = gain[:, None] * g0
        a = np.maximum((x - b - f @ g.T).mean(1), 0)
        b = np.maximum((x - a[:, None] - f @ g.T).mean(0), 0)
    return f, a, b, gain, losses


@pytest.mark.parametrize("penalty", [0.0, 0.05])
def test_density_fit_equals_a_loop(spark, penalty):
    rng = np.random.default_rng(12)
    book = rng.uniform(0, 1, size=(6, 4))
    x = rng.uniform(0, 1, size=(30, 4)) @ book.T + rng.uniform(0, 0.3, size=(30, 6))
    voxels = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "m0 int, obs array<double>").repartition(3)
    codes = spark.createDataFrame([(n, j, float(book[n, j])) for n in range(6) for j in range(4)], "n int, j int, c double")
    got = density.fit(voxels, codes, 5, penalty)
    f, a, b, gain, losses = fitted(x, book, 5, penalty)
    rows = {r.m0: r for r in got.voxels.collect()}
    assert np.allclose([rows[i].f for i in range(30)], f, atol=1e-8) and np.allclose([rows[i].a for i in range(30)], a, atol=1e-8)
    assert np.allclose(got.offsets, b) and np.allclose(got.gains, gain) and np.allclose(got.losses[:-1], losses)


@pytest.mark.parametrize(("inner", "guessed"), [(512, False), (60, True), (12, False)])
def test_deconvolution_equals_a_loop(spark, inner, guessed, monkeypatch):
    # Small tiles: one iteration or two at a time, with halos over several tiles.
    monkeypatch.setitem(tiled.INNER, 2, inner)
    x = np.abs(np.random.default_rng(13).normal(size=(2, 20, 15))) + 0.1
    sizes, sigmas = {"m0": 20, "m1": 15}, {"m0": 1.0, "m1": 0.7}
    first = np.abs(np.random.default_rng(14).normal(size=x.shape)) + 0.1 if guessed else np.ones_like(x)
    guess = stack(spark, first, ("m0", "m1")) if guessed else None
    got = array(grids.lucy_richardson(stack(spark, x, ("m0", "m1")), sizes, sigmas, 4, guess=guess), x.shape, ("n", "m0", "m1"))

    def blur(y):
        for axis, s in ((1, 1.0), (2, 0.7)):
            y = tiled.blurred(y, axis, tiled.kernel(s))
        return y

    y = first
    for _ in range(4):
        y = y * blur(x / blur(y)) / blur(np.ones_like(x))
    assert np.allclose(got, y)


def test_surface_of_two_tetrahedra(spark):
    s = spark.createDataFrame([(0, 1, 2, 3), (1, 2, 3, 4)], "p0 int, p1 int, p2 int, p3 int")
    assert geometry.boundary_faces(s).count() == 6


def test_hermite_meets_its_ends(spark):
    r = spark.range(1).select(columns.hermite(F.lit(2.0), F.lit(1.0), F.lit(5.0), F.lit(0.5), 0.0).alias("a"), columns.hermite(F.lit(2.0), F.lit(1.0), F.lit(5.0), F.lit(0.5), 1.0).alias("b")).first()
    assert (r.a, r.b) == (2.0, 5.0)


def test_deconvolution_keeps_what_is_flat(spark):
    x = np.ones((1, 9, 1))
    df = stack(spark, x, ("m0", "m1"))
    got = array(grids.lucy_richardson(grids.gaussian(df, {"m0": 9}, {"m0": 1.0}), {"m0": 9}, {"m0": 1.0}, 3), x.shape, ("n", "m0", "m1"))
    assert np.allclose(got, 1)


def test_signal_left_behind_by_rounds(spark):
    codes = spark.createDataFrame([(0, 1, 1.0), (1, 1, 2.0), (3, 1, None), (4, 1, 4.0), (2, 2, 8.0)], "n int, j int, c double")
    got = {(r.n, r.j): r.c for r in codebooks.phased(codes, 2, [0.5, 0.25]).collect()}
    assert got == {(0, 1): 1, (2, 1): 0.5, (4, 1): 4.25, (1, 1): 2, (3, 1): 0.5, (5, 1): 0.125, (0, 2): 0, (2, 2): 8, (4, 2): 4}


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 12).flatmap(lambda n: st.lists(st.lists(st.one_of(st.integers(0, 60).map(float), st.floats(0, 1e5), st.just(1e5)), min_size=n, max_size=n), min_size=1, max_size=5)))
def test_envelopes_are_least_sums(lines):
    g = np.array(lines)
    at = np.arange(g.shape[1])
    want = (g[:, None, :] + (at[:, None] - at) ** 2).min(2)
    np.testing.assert_allclose(geometry.envelope(g), want, rtol=1e-12)


def test_distances_have_no_reach(spark):
    seeds = spark.createDataFrame([(0, 3, 0), (0, 900, 5), (1, 0, 2)], "n int, m0 int, g int")
    got = {(r.n, r.m0): r.g for r in geometry.distance_transform(seeds, "m0", 1000, ["n"], 1e9).collect()}
    assert len(got) == 2000 and got[0, 400] == min(397**2, 500**2 + 5) and got[1, 999] == 999**2 + 2
    assert geometry.distance_transform(seeds, "m0", 1000, ["n"], 100.0).count() == 13 + 19 + 10
    assert geometry.distance_transform(seeds.limit(0), "m0", 1000, ["n"]).count() == 0


def test_sweep_equals_one_matching_per_threshold(spark):
    rng = np.random.default_rng(8)
    points = lambda n: [(int(a), int(b), int(j), float(v)) for a, b, j, v in zip(rng.integers(0, 40, n), rng.integers(0, 40, n), rng.integers(0, 2, n), rng.integers(0, 9, n))]
    truth = spark.createDataFrame(points(60) + [(100, 100, 0, 1.0)] * 2, "m0 int, m1 int, j int, x double").drop("x")
    found = spark.createDataFrame(points(80), "m0 int, m1 int, j int, v double")
    levels = [0.0, 3.0, 3.5, 8.0, 20.0]
    got = {r.threshold: (r.n_found, r.fn, r.fp) for r in pointclouds.sweep(truth, found, 4.0, ["m0", "m1"], levels).collect()}
    for t in levels:
        own = found.where(found.v >= t)
        parts = pointclouds.match(truth, own, 4.0, ["m0", "m1"])
        assert got[t] == (own.count(), parts["fn"].count(), parts["fp"].count()), t
    none = {r.threshold: (r.n_found, r.fn, r.fp) for r in pointclouds.sweep(truth, found.limit(0), 4.0, ["m0", "m1"], [1.0]).collect()}
    assert none == {1.0: (0, 62, 0)}


def test_explained_and_left_over_are_the_stack(spark):
    codes = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (0, 2, 1.0)], "n int, j int, c double")
    found = spark.createDataFrame([(5, 0, 9.0), (7, 0, 1.0), (9, 1, 8.0), (20, 2, 3.0), (30, 0, 2.0)], "m0 int, j int, v double")
    shown = density.gated_reconstruction(found, codes, codes.where("j = 2"), {"m0": 40}, {"m0": 2})
    assert {(r.n, r.m0): r.v for r in shown.collect()} == {(0, 5): 9, (0, 7): 1, (1, 9): 8}
    seen = spark.createDataFrame([(0, 5, 10.0), (1, 30, 4.0)], "n int, m0 int, v double")
    rows = density.left_over(seen, shown, ["m0"]).collect()
    assert len(rows) == 4 and all(r.explained + r.left == r.v for r in rows)


def test_distances_compare_where_codes_lie(spark):
    rng = np.random.default_rng(4)
    books = [np.where(rng.random((n, 6)) < 0.2, np.nan, rng.random((n, 6))) for n in (7, 12)]
    tables = [spark.createDataFrame([(n, j, None if np.isnan(c) else float(c)) for j, code in enumerate(b) for n, c in enumerate(code) if (n, j) != (5, 0)], "n int, j int, c double") for b in books]
    for b in books:
        b[0, 5] = np.nan  # rows that are absent are unknown
    for x, y, p, q in ((0, 1, books[0], books[1]), (1, 0, books[1], books[0])):
        got = {(r.i, r.j): r.d for r in codebooks.distances(tables[x], tables[y]).collect()}
        want = {(i, j): np.nansum(np.abs(u - v)) for i, u in enumerate(p) for j, v in enumerate(q)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = codebooks.distances(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_decoys_are_found_block_by_block(spark):
    book = spark.createDataFrame([(j, r, (j * (r + 2)) % 3) for j in range(9) for r in range(4)], "j int, r int, ch int")
    every = [tuple(r) for r in codebooks.decoys(book, 4, 3, 2, 6).collect()]
    assert every == [tuple(r) for r in codebooks.decoys(book, 4, 3, 2, 6, block=2).collect()] and len(every) % 4 == 0 and every
    assert codebooks.decoys(book, 4, 3, 2, 1000, block=5).count() == codebooks.decoys(book, 4, 3, 2, 1000).count()


def joined(df):
    """Rows that the last join of a query gives."""
    df._jdf.queryExecution().toRdd().count()
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if "Join" in node.nodeName():
            return node.metrics().apply("numOutputRows").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        nodes += [node.children().apply(k) for k in range(node.children().size())]


@pytest.mark.parametrize("together", [1, 3, 256])
def test_overlapping_boxes_equal_a_loop(spark, together):
    rng = np.random.default_rng(together)
    low = rng.integers(-6, 7, (120, 2))
    rows = [(k % 115, int(a), int(a + s), int(b), int(b + t)) for k, ((a, b), (s, t)) in enumerate(zip(low, rng.integers(-1, 5, (120, 2))))]
    rows += [(200 + k, 0, 3, 0, 2) for k in range(20)] + [(300, None, 3, 0, 2), (None, 0, 3, 0, 2)]
    df = spark.createDataFrame(rows, "tile long, look_start_x long, look_stop_x long, look_start_y long, look_stop_y long")
    got = Counter(map(tuple, tiling.neighbours(df, ["x", "y"], together=together).collect()))
    real = [r for r in rows if None not in r and r[1] < r[2] and r[3] < r[4]]
    want = Counter((p[0], q[0]) for p in real for q in real if p[0] != q[0] and p[1] < q[2] and q[1] < p[2] and p[3] < q[4] and q[3] < p[4])
    assert got == want


def test_equal_boxes_are_compared_together(spark):
    rows = [(k, 0, 3, 0, 2) for k in range(1000)]
    df = spark.createDataFrame(rows, "tile long, look_start_x long, look_stop_x long, look_start_y long, look_stop_y long")
    found = tiling.neighbours(df, ["x", "y"])
    assert joined(found) <= 16 and found.count() == 1000 * 999
