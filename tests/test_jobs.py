import numpy as np
from pyspark.sql import functions as F

from lumenplex.jobs import spot_calling
from lumenplex.operators import blurred_model, linear_programs, local_patterns, model_registration, simulate, tiling

SIZES = {"m0": 40, "m1": 40}


def scene(spark, n=4):
    codes = simulate.codebook(spark, 5, 3, 6, seed=3)
    points = spark.createDataFrame([(6 + 9 * k, 8 + 7 * k, k, k) for k in range(n)], "m0 int, m1 int, j int, spot long")
    return codes, points, simulate.stack(points, codes, SIZES, {"m0": 1.0, "m1": 1.0}, noise=0.001)


def test_simulation_is_repeatable(spark):
    a, b = (simulate.spots(spark, SIZES, 6, 50, seed=4).repartition(k) for k in (1, 5))
    assert a.exceptAll(b).isEmpty() and a.count() == 50
    lit = simulate.codebook(spark, 5, 3, 6, seed=3).groupBy("j", "r").agg(F.sum("c").alias("s"))
    assert lit.where("s <> 1").isEmpty() and lit.count() == 30


def test_points_follow_their_lines(spark):
    lines = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 30.0, 40.0, 0.0) for k in range(40)], "line int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    got = simulate.points_on_line(spark, lines, 0.2)
    assert got.where(F.abs(F.col("x") * 40 - F.col("y") * 30) > 1e-6).isEmpty() and 300 < got.count() < 500


def test_iterative_job_finds_every_spot(spark):
    codes, points, stack = scene(spark)
    found = spot_calling.iterative(stack, codes, SIZES, 15, 8, 0.3)
    r = spot_calling.accuracy(points.withColumn("status", F.lit("good")), found.select("m0", "m1", "j"), 3.0, ["m0", "m1"]).first()
    assert (r.fn, r.fp) == (0, 0) and r.detection_rate == 1


def decoys_of(spark):
    return simulate.codebook(spark, 5, 3, 2, seed=77).withColumn("j", F.col("j") + 100)


def test_two_phases_keep_the_truth(spark):
    codes, points, stack = scene(spark)
    got = spot_calling.two_phase(stack, codes, decoys_of(spark), SIZES, 5, {"m0": 2, "m1": 2}, {"m0": 16, "m1": 16}, {"m0": 1, "m1": 1}, iterations=((2, 2), (5, 12)))
    top = got.where("j < 100").join(points.select("m0", "m1", F.col("j").alias("truth")), ["m0", "m1"]).groupBy("m0", "m1", "truth").agg(F.max_by("j", "v").alias("best"))
    assert top.count() == 4 and top.where("truth <> best").isEmpty()


def test_codes_that_a_tile_did_not_keep_are_never_fitted_there(spark, monkeypatch):
    codes, _, stack = scene(spark)
    decoys = decoys_of(spark)
    tiled = tiling.tiles(spark, SIZES, {"m0": 16, "m1": 16}, {"m0": 4, "m1": 4})
    chosen = {t: k % 6 for k, t in enumerate(sorted(r.tile for r in tiled.select("tile").collect()))}
    kept = spark.createDataFrame([(t, j) for t, k in chosen.items() for j in (k, 100, 101)], "tile string, j int")
    monkeypatch.setattr(spot_calling, "kept_codes", lambda *a, **k: kept)
    got = spot_calling.two_phase(stack, codes, decoys, SIZES, 5, {"m0": 2, "m1": 2}, {"m0": 16, "m1": 16}, {"m0": 1, "m1": 1}, iterations=((1, 0), (3, 2)))
    own = tiling.owned(tiling.deal(got, tiled, ["m0", "m1"]), ["m0", "m1"]).collect()
    assert len(own) == got.count() > 0
    assert all(r.j in (chosen[r.tile], 100, 101) for r in own)
    # A tile alone, with its three codes, gives the same.
    r = tiled.orderBy("tile").first()
    part = stack.toPandas()
    x = np.zeros((40, 40, 15))
    x[part.m0, part.m1, part.n] = part.v
    book = {j: np.zeros(15) for j in (0, 100, 101)}
    for c in codes.unionByName(decoys).select("n", "j", "c").collect():
        if c.j in book:
            book[c.j][c.n] = c.c
    matrix = np.stack([book[j] for j in (0, 100, 101)], -1).reshape(5, 3, 3)
    x = x[r.look_start_m0 : r.look_stop_m0, r.look_start_m1 : r.look_stop_m1]
    want = blurred_model.fit_block(x, matrix, [1, 1], 0.01, ["F"] * 3 + ["a", "F"] * 2)
    for o in own:
        if o.tile == r.tile:
            np.testing.assert_allclose(want[o.m0 - r.look_start_m0, o.m1 - r.look_start_m1, (0, 100, 101).index(o.j)], o.v, rtol=1e-9)


def test_codes_are_kept_where_they_beat_the_decoys(spark):
    tiled = tiling.tiles(spark, {"m0": 40}, {"m0": 10}, {"m0": 2})
    coarse = spark.createDataFrame([(1, 0, 3.0), (1, 100, 1.0), (3, 101, 2.0), (7, 1, 2.0), (7, 2, 2.5)], "m0 int, j int, v double")
    decoys = spark.createDataFrame([(0, 100, 1.0), (0, 101, 1.0)], "n int, j int, c double")
    real = lambda **k: sorted(tuple(r) for r in spot_calling.kept_codes(coarse, decoys, tiled, {"m0": 5}, 8, **k).where("j < 100").collect())
    inside = lambda at: {r.tile for r in tiled.collect() if r.look_start_m0 // 5 <= at < r.look_stop_m0 // 5}
    assert real() == sorted((t, j) for at, j in ((1, 0), (7, 2)) for t in inside(at))
    assert real(multiplier=1.3) == sorted((t, 0) for t in inside(1))
    # Of eight voxels one is above zero: the median is 0, so all codes are kept; over decoys the level lies between.
    assert {j for _, j in real(by_voxel=50.0)} == {0, 1, 2} and {j for _, j in real(by_code=0.0)} == {0, 1, 2}


def test_codes_are_read_off_blobs(spark):
    codes, points, stack = scene(spark)
    centres = local_patterns.blobs(stack, ["m0", "m1"], 0.2)
    got = local_patterns.read_codes(local_patterns.patches(stack, centres, {"m0": 2, "m1": 2}), {"m0": 2, "m1": 2}, 5, 3, 1.5).collect()
    lit = {}
    for r in codes.where("c > 0").collect():
        lit.setdefault(r.j, {})[r.r] = r.ch
    want = {",".join(str(lit[k][r]) for r in range(5)) for k in range(4)}
    assert {r.code for r in got if r.status == "success"} == want


def test_linear_programs(spark):
    rows = [(k, [-1.0, -1.0], [1.0, 1.0], [float(k + 1)]) for k in range(5)]
    got = linear_programs.solve(spark.createDataFrame(rows, "k int, c array<double>, a array<double>, b array<double>")).collect()
    assert all(r.done and abs(sum(r.x) - (r.k + 1)) < 1e-9 for r in got)


def test_slopes_of_moved_frames():
    x = np.random.default_rng(0).normal(size=(2, 14, 14))
    t = np.array([[0.3, -0.7], [1.2, 0.4]])
    y, slopes = model_registration._moved(x, t, 4)
    for k in range(2):
        step = np.zeros((2, 2))
        step[:, k] = 1e-6
        z, _ = model_registration._moved(x, t + step, 4)
        assert np.allclose((z - y) / 1e-6, slopes[k], atol=1e-4)


def test_registration_recovers_shifts(spark):
    rng = np.random.default_rng(2)
    n, size = 8, 48
    book = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 1], [1, 0, 0, 1], [1, 0, 1, 0], [0, 1, 0, 1], [1, 1, 1, 0]]) + 0.0
    shifts = rng.uniform(-1.2, 1.2, size=(n, 2))
    shifts -= shifts.mean(0)
    g = np.arange(size)
    img = np.zeros((n, size, size))
    for k in range(16):  # apart from each other, so that the truth explains most
        a, b, j, s = 12 + 8 * (k // 4), 12 + 8 * (k % 4), rng.integers(4), rng.uniform(1, 2)
        for f in range(n):
            img[f] += s * book[f, j] * np.exp(-((g[:, None] - a - shifts[f, 0]) ** 2 + (g[None] - b - shifts[f, 1]) ** 2) / 4.5)
    rows = [(int(f), int(a), int(b), float(img[f, a, b])) for f in range(n) for a in range(size) for b in range(size) if img[f, a, b] > 1e-6]
    df = spark.createDataFrame(rows, "n int, m0 int, m1 int, v double")
    sizes = {"m0": size, "m1": size}
    tiles = tiling.tiles(spark, sizes, {"m0": 20, "m1": 20}, {"m0": 4, "m1": 4}, outer=False)
    blocks = model_registration.blocks(tiling.deal(df, tiles, ["m0", "m1"]), n).cache()
    codes = spark.createDataFrame([(f, j, float(book[f, j])) for f in range(n) for j in range(4)], "n int, j int, c double")
    t, losses = model_registration.register(blocks, codes, 4, 40)
    assert np.abs(t - shifts).mean() < 0.05 and min(losses) < 0.1 and losses[0] > min(losses)


def test_slopes_on_three_axes():
    x = np.random.default_rng(0).normal(size=(2, 13, 12, 11))
    t = np.array([[0.3, -0.7, 0.1], [1.2, 0.4, -1.1]])
    y, slopes = model_registration._moved(x, t, (4, 3, 3))
    assert y.shape == (2, 5, 6, 5)
    for k in range(3):
        step = np.zeros((2, 3))
        step[:, k] = 1e-6
        z, _ = model_registration._moved(x, t + step, (4, 3, 3))
        assert np.allclose((z - y) / 1e-6, slopes[k], atol=1e-4)
    flat, still = model_registration._moved(x, t, (4, 0, 3))
    assert flat.shape == (2, 5, 12, 5) and not still[1].any()


def test_registration_on_three_axes(spark):
    rng = np.random.default_rng(3)
    n, shape = 6, (16, 26, 26)
    book = np.array([[1, 1, 1], [1, 1, 0], [0, 1, 1], [1, 0, 1], [1, 0, 0], [0, 1, 0]]) + 0.0
    shifts = rng.uniform(-1, 1, size=(n, 3))
    shifts -= shifts.mean(0)
    g = [np.arange(s) for s in shape]
    img = np.zeros((n, *shape))
    for k in range(9):
        at, j = (8, 8 + 5 * (k // 3), 8 + 5 * (k % 3)), k % 3
        for f in range(n):
            d = [(g[i] - at[i] - shifts[f, i]) ** 2 for i in range(3)]
            img[f] += book[f, j] * np.exp(-(d[0][:, None, None] + d[1][None, :, None] + d[2][None, None]) / 3)
    rows = [(int(f), *map(int, p), float(img[(f, *p)])) for f in range(n) for p in zip(*np.nonzero(img[f] > 1e-5))]
    df = spark.createDataFrame(rows, "n int, m0 int, m1 int, m2 int, v double")
    axes = ("m0", "m1", "m2")
    tiles = tiling.tiles(spark, dict(zip(axes, shape)), {"m0": 8, "m1": 9, "m2": 18}, dict.fromkeys(axes, 4), outer=False)
    blocks = model_registration.blocks(tiling.deal(df, tiles, list(axes)), n, axes).cache()
    codes = spark.createDataFrame([(f, j, float(book[f, j])) for f in range(n) for j in range(3)], "n int, j int, c double")
    t, losses = model_registration.register(blocks, codes, 4, 35)
    assert np.abs(t - shifts).mean() < 0.1 and losses[0] > min(losses)
