"""Codes found in the data itself: per voxel and round, which channel stands out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def choices(voxels: DataFrame, n_channels: int, stand_out: float) -> DataFrame:
    """keys and per round (top, total, ch): the largest value, the sum, and the first largest channel or -1.

    obs holds rounds one after the other. A channel is chosen if its value exceeds stand_out times the round's mean.
    Map-only: a voxel's frames are in its row.
    """
    rounds = F.transform(F.sequence(F.lit(0), (F.size("obs") / n_channels).cast("int") - 1), lambda r: F.slice("obs", r * n_channels + 1, n_channels))
    pick = lambda x: F.struct(
        F.array_max(x).alias("top"),
        F.aggregate(x, F.lit(0.0), lambda s, v: s + v).alias("total"),
        F.when(F.array_max(x) > stand_out * F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n_channels, (F.array_position(x, F.array_max(x)) - 1).cast("int")).otherwise(-1).alias("ch"),
    )
    keys = [c for c in voxels.columns if c not in ("obs", "j")]
    return voxels.select(*keys, F.transform(rounds, pick).alias("rounds"))


def seek(voxels: DataFrame, n_channels: int, stand_out: float, share_of_rounds: float) -> DataFrame:
    """Distinct codes, as channels joined by commas, of voxels with enough rounds that have a choice; and how many."""
    x = choices(voxels, n_channels, stand_out).select(F.transform("rounds", lambda r: r["ch"]).alias("ch"))
    good = F.size(F.filter("ch", lambda c: c >= 0)) >= share_of_rounds * F.size("ch")
    return x.where(good).select(F.concat_ws(",", F.transform("ch", lambda c: c.cast("string"))).alias("code")).groupBy("code").agg(F.count("*").alias("n_voxels"))


def signal_share(voxels: DataFrame, n_channels: int, stand_out: float = 1.0, low: float = 0.01, squares: bool = False, scaled: bool = True) -> DataFrame:
    """Per voxel the share of its signal that the chosen channels hold: sum of their values / (low + sum of all).

    scaled divides all values by the largest one anywhere first; squares sums squared values.
    """
    if scaled:
        top = F.broadcast(voxels.agg(F.max(F.array_max("obs")).alias("__top")))  # one row
        voxels = voxels.crossJoin(top).withColumn("obs", F.transform("obs", lambda v: v / F.col("__top"))).drop("__top")
    power = (lambda v: v * v) if squares else (lambda v: v)
    keys = [c for c in voxels.columns if c not in ("obs", "j")]
    x = choices(voxels.withColumn("__all", F.aggregate("obs", F.lit(0.0), lambda s, v: s + power(v))), n_channels, stand_out)
    chosen = F.aggregate("rounds", F.lit(0.0), lambda s, r: s + F.when(r["ch"] >= 0, power(r["top"])).otherwise(0.0))
    return x.select(*keys, (chosen / (F.col("__all") + low)).alias("share"), F.concat_ws(",", F.transform("rounds", lambda r: r["ch"].cast("string"))).alias("code"))


def seek_by_share(voxels: DataFrame, n_channels: int, least: float, stand_out: float = 1.0, squares: bool = True, low: float = 0.001) -> DataFrame:
    """Distinct codes of voxels whose share, over the largest share anywhere, is at least `least`; and how many."""
    x = signal_share(voxels, n_channels, stand_out, low, squares)
    top = F.broadcast(x.agg(F.max("share").alias("__top")))  # one row
    return x.crossJoin(top).where(F.col("share") / F.col("__top") >= least).groupBy("code").agg(F.count("*").alias("n_voxels"))
