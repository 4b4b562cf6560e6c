"""Fields of view that arrive one after the other: each is labelled or summed as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenplex.operators.evidence import best_code


def label_arrivals(spark: SparkSession, source: str, schema: str, codes: DataFrame, out: str, checkpoint: str, floor: float = 0.05, threshold: float = 0.2) -> StreamingQuery:
    """Label every voxel of Parquet files (keys, obs) that arrive under source; a batch's results are one table below out.

    A batch is written under its number, in overwrite mode, so a repeated batch replaces itself: exactly once.
    """
    voxels = spark.readStream.schema(schema).parquet(source)

    def one(batch: DataFrame, number: int) -> None:
        best_code(batch, codes, floor, threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return voxels.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signal_by_window(events: DataFrame, window: str, late: str) -> DataFrame:
    """Summed signal per frame and window of event time; rows later than `late` behind the newest are dropped.

    events: a streaming DataFrame of n, ts, v.
    """
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "n").agg(F.sum("v").alias("v"), F.count("*").alias("n_rows")).select(F.col("w.start").alias("start"), "n", "v", "n_rows")
