import tempfile

from lumenplex.sources.bundle import Bundle
from lumenplex.streaming.arrivals import label_arrivals, signal_by_window


def bundle(spark):
    x = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 1, 3.0)], "n int, m0 int, m1 int, v double")
    codes = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5)], "n int, j int, c double")
    points = spark.createDataFrame([(0, 0, 0, "bad"), (1, 1, 1, None)], "j int, m0 int, m1 int, status string")
    return Bundle(x, codes, points, meta={"name": "small"})


def test_bundle_round_trip(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/b"
    bundle(spark).write(path)
    back = Bundle.read(spark, path)
    assert back.meta["name"] == "small" and back.voxels is None
    assert back.counts().first().asDict() == {"n_spots": 2, "n_good_spots": 1, "n_genes": 2}


def test_bundle_grows_and_shrinks(spark):
    b = bundle(spark)
    more = b.with_more(spark.createDataFrame([(1, 0, 1)], "j int, m0 int, m1 int"))
    assert more.rolonies.count() == 3 and more.counts().first().n_good_spots == 2
    assert b.downsample(2).stack.collect()[0].v == 1.0


def test_labels_as_fields_arrive(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    rows = spark.createDataFrame([(0, [3.0, 0.0]), (1, [0.0, 2.0])], "m0 int, obs array<double>")
    rows.write.parquet(f"{top}/in")
    codes = spark.createDataFrame([(0, 7, 1.0), (1, 7, 0.0), (0, 8, 0.0), (1, 8, 1.0)], "n int, j int, c double")
    label_arrivals(spark, f"{top}/in", "m0 int, obs array<double>", codes, f"{top}/out", f"{top}/state").awaitTermination()
    assert sorted((r.m0, r.j) for r in spark.read.parquet(f"{top}/out").collect()) == [(0, 7), (1, 8)]


def test_windows_of_a_stream(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    spark.sql("select 0 as n, timestamp'2024-01-01 00:00:10' as ts, 1.5D as v union all select 0, timestamp'2024-01-01 00:04:00', 2D union all select 0, timestamp'2024-01-01 02:00:00', 9D").write.parquet(f"{top}/in")
    stream = spark.readStream.schema("n int, ts timestamp, v double").parquet(f"{top}/in")
    q = signal_by_window(stream, "5 minutes", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.v for r in spark.table("windows").collect()) == [3.5, 9.0]
