"""Seeded synthetic data: codebooks, spots and stacks. Randomness is a hash of keys, so any plan gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenplex.operators.grids import gaussian


def unit(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the keys alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**40)) + 0.5) / 2.0**40


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number likewise."""
    return F.sqrt(-2 * F.log(unit(seed, *keys))) * F.cos(2 * 3.141592653589793 * unit(seed + 1, *keys))


def codebook(spark: SparkSession, rounds: int, channels: int, codes: int, seed: int = 0) -> DataFrame:
    """j, r, ch, n, c: in each round one channel, picked uniformly, is lit."""
    j = spark.range(codes).select(F.col("id").cast("int").alias("j"))
    each = j.select("j", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
    lit = each.withColumn("lit", F.floor(unit(seed, F.col("j"), F.col("r")) * channels).cast("int"))
    every = lit.select("j", "r", "lit", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("ch"))
    return every.select("j", "r", "ch", (F.col("r") * channels + F.col("ch")).alias("n"), (F.col("ch") == F.col("lit")).cast("double").alias("c"))


def spots(spark: SparkSession, sizes: dict[str, int], codes: int, n: int, seed: int = 0) -> DataFrame:
    """Points with axes, j and spot, spread uniformly."""
    s = F.col("id")
    at = [F.floor(unit(seed + 10 + k, s) * size).cast("int").alias(a) for k, (a, size) in enumerate(sizes.items())]
    return spark.range(n).select(*at, F.floor(unit(seed + 5, s) * codes).cast("int").alias("j"), s.alias("spot"))


def stack(points: DataFrame, codes: DataFrame, sizes: dict[str, int], sigmas: dict[str, float], signal: tuple[float, float] = (10.0, 15.0), noise: float = 0.01, dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """LONG: every point's code scaled by its own gain, some frames dropped, blurred; noise where there is signal, clipped at 0.

    The codebook joins by j, so a point's frames are made where the point is.
    """
    low, high = signal
    gain = low + (high - low) * unit(seed + 20, F.col("spot"))
    kept = F.when(unit(seed + 21, F.col("spot"), F.col("n")) >= dropout, F.col("c")).otherwise(0.0)
    lit = points.join(codes.where("c > 0"), "j").withColumn("v", gain * kept)
    axes = list(sizes)
    summed = lit.groupBy("n", *axes).agg(F.sum("v").alias("v"))
    blurred = gaussian(summed, sizes, sigmas)
    return blurred.withColumn("v", F.greatest(F.col("v") + noise * normal(seed + 30, F.col("n"), *[F.col(a) for a in axes]), F.lit(0.0)))


def points_on_line(spark: SparkSession, lines: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Points spread at a rate along chords (line, x0, y0, z0, x1, y1, z1): gaps between them are exponential.

    How many points a chord holds is known from its length and bounded by 4 times what is expected, plus 20.
    """
    length = F.sqrt(sum(((F.col(f"{a}1") - F.col(f"{a}0")) ** 2 for a in "yz"), (F.col("x1") - F.col("x0")) ** 2))
    most = (4 * rate * length + 20).cast("int")
    gaps = F.transform(F.sequence(F.lit(1), most), lambda k: -F.log(unit(seed, F.col("line"), k)) / rate)
    steps = lines.withColumn("__len", length).withColumn("__gaps", gaps)
    along = F.transform("__gaps", lambda g, k: F.aggregate(F.slice("__gaps", 1, k + 1), F.lit(0.0), lambda s, x: s + x))
    at = steps.select("*", F.explode(F.filter(along, lambda d: d < F.col("__len"))).alias("__d"))
    return at.select("line", *[(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * F.col("__d") / F.col("__len")).alias(a) for a in "xyz"])
