"""Stacks, codebooks and point clouds read from general tables.

Sums are of integer hundredths, so they don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
ROWS, HOURS = 40, 24


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VOXEL: m0 = vector, obs = its components, with its label j."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("m0"), F.col("embedding").cast("array<double>").alias("obs"), F.col("label").alias("j"))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CODES: one code per label, the mean of its vectors' components by position n."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("j"), F.posexplode("embedding").alias("n", "x"))
    return rows.groupBy("n", "j").agg(F.avg(F.col("x").cast("double")).alias("c"))


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LONG: frames n by event type, m0 = user mod 40, m1 = hour, v = summed value; absent cells are absent rows."""
    e = read(spark, sf_dir, "events")
    n = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    keys = [n.cast("int").alias("n"), (F.col("user_id") % ROWS).cast("int").alias("m0"), F.hour("ts").alias("m1")]
    return e.groupBy(*keys).agg((cents / 100.0).alias("v"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LONG in one dimension: frames n by event type, m0 = minute of the day."""
    e = read(spark, sf_dir, "events")
    n = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("int")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return e.groupBy(n.cast("int").alias("n"), minute.alias("m0")).agg((cents / 100.0).alias("v"))


def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot channels: code j = part, three rounds r, channel ch = the brand number's digit to base 3."""
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("j"), brand.alias("b"))
    digits = F.array(*[F.floor(F.col("b") / 3**k).cast("int") % 3 for k in (2, 1, 0)])
    return p.select("j", F.posexplode(digits).alias("r", "ch"))


def event_points(spark: SparkSession, sf_dir: str, shift: int = 0, at_least: float = 0.0) -> DataFrame:
    """POINTS: cells of the event grid above a value, moved along m0; j = frame."""
    g = event_grid(spark, sf_dir).where(F.col("v") >= at_least)
    return g.select((F.col("m0") + shift).alias("m0"), "m1", F.col("n").alias("j"))
