"""Coloured point clouds: which points of one are near a point of the same colour in another.

Points meet in grid cells as wide as the radius, one side spread to the neighbouring cells, so a join looks
at near points only, whatever the cloud's size; a cell's points and nothing else must fit a task.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenplex.operators.lineage import cut


def _cells(points: DataFrame, axes: list[str], radius: float, spread: bool) -> DataFrame:
    steps = F.array(*[F.array(*map(F.lit, s)) for s in (product((-1, 0, 1), repeat=len(axes)) if spread else [(0,) * len(axes)])])
    cell = F.array(*[F.floor(F.col(a) / radius) for a in axes])
    return points.select("*", F.explode(steps).alias("__s")).withColumn("__cell", F.zip_with(cell, "__s", lambda c, s: c + s)).drop("__s")


def _placed(axes: list[str]):
    ok = F.lit(True)
    for a in axes:
        x = F.col(a).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return ok


def _near(axes: list[str], radius: float):
    d2 = sum(((F.col(f"a.{x}") - F.col(f"b.{x}")) * (F.col(f"a.{x}") - F.col(f"b.{x}")) for x in axes[1:]), (F.col(f"a.{axes[0]}") - F.col(f"b.{axes[0]}")) ** 2)
    return (F.col("a.j") == F.col("b.j")) & (F.col("a.__cell") == F.col("b.__cell")) & (d2 <= radius * radius)


def _split(points: DataFrame, others: DataFrame, radius: float, axes: list[str], how: str) -> DataFrame:
    a = _cells(points, axes, radius, False).alias("a")
    b = _cells(others, axes, radius, True).alias("b")
    return a.join(b, _near(axes, radius), how).drop("__cell")


def within(points: DataFrame, others: DataFrame, radius: float, axes: list[str]) -> DataFrame:
    """Points with an other of their colour j at most radius away."""
    return _split(points, others, radius, axes, "left_semi")


def beyond(points: DataFrame, others: DataFrame, radius: float, axes: list[str]) -> DataFrame:
    """Points without one."""
    return _split(points, others, radius, axes, "left_anti")


def match(truth: DataFrame, found: DataFrame, radius: float, axes: list[str]) -> dict[str, DataFrame]:
    """fn: truth without a found point nearby; fp: found ones without truth; agreement: found ones with. Not one to one."""
    return {"fn": beyond(truth, found, radius, axes), "fp": beyond(found, truth, radius, axes), "agreement": within(found, truth, radius, axes)}


def match_rolonies(rolonies: DataFrame, found: DataFrame, radius: float, axes: list[str], subset: DataFrame | None = None) -> dict[str, DataFrame]:
    """match() by status: bad rolonies match nothing; only good ones (of the subset j) can be missed."""
    status = F.coalesce(F.col("status"), F.lit("good"))
    usable = rolonies.where(status != "bad")
    good = rolonies.where(status == "good")
    if subset is not None:
        good = good.join(subset.select("j").distinct(), "j", "left_semi")
    return {"fn": beyond(good, found, radius, axes), "fp": beyond(found, usable, radius, axes), "agreement": within(found, usable, radius, axes)}


def meanmin_divergence(points: DataFrame, others: DataFrame, axes: list[str], start: float = 2.0) -> DataFrame:
    """Per colour j of points or others: the mean distance to the nearest other of that colour.

    0 without points, infinity without others. The nearest one is looked for in grid cells of a width that doubles
    until every point has one that near, so a point meets others of its surroundings and not all of its colour.
    Points with a coordinate that is null or not finite take no part.
    """
    points, others = (df.where(_placed(axes)) for df in (points, others))
    same = others.select("j").distinct()
    left = cut(points.select("j", *axes, F.monotonically_increasing_id().alias("__id")))
    lonely = left.join(same, "j", "left_anti").select("j", F.lit(float("inf")).alias("d"))
    left = left.join(same, "j", "left_semi")
    parts, width = [lonely], start
    while not left.isEmpty():
        a = _cells(left, axes, width, False).alias("a")
        b = _cells(others.select("j", *axes), axes, width, True).alias("b")
        d2 = sum(((F.col(f"a.{x}") - F.col(f"b.{x}")) ** 2 for x in axes[1:]), (F.col(f"a.{axes[0]}") - F.col(f"b.{axes[0]}")) ** 2)
        near = cut(a.join(b, _near(axes, width)).groupBy("a.j", "a.__id").agg(F.sqrt(F.min(d2)).alias("d")))
        parts.append(near.select("j", "d"))
        left = cut(left.join(near.select("__id"), "__id", "left_anti"))
        width *= 2
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    means = every.groupBy("j").agg(F.avg("d").alias("divergence"))
    return points.select("j").union(others.select("j")).distinct().join(means, "j", "left").select("j", F.coalesce("divergence", F.lit(0.0)).alias("divergence"))


def voxel_divergences(voxels: DataFrame, found: DataFrame, axes: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Per colour j of voxels: ours (how far our voxels are from found ones), theirs (the other way), and unmatched.

    pairs (i, j) say which of our colours j a found colour i stands for; without them colours have the same names.
    """
    names = voxels.select("j").distinct()
    if pairs is not None:
        found = found.withColumnRenamed("j", "i").join(pairs, "i").select("j", *axes)
    found = found.join(names, "j", "left_semi")
    ours = meanmin_divergence(voxels, found, axes).select("j", F.col("divergence").alias("ours"))
    theirs = meanmin_divergence(found, voxels, axes).select("j", F.col("divergence").alias("theirs"))
    matched = names if pairs is None else pairs.select("j").distinct()
    out = names.join(ours, "j", "left").join(theirs, "j", "left").join(matched.withColumn("__m", F.lit(True)), "j", "left")
    return out.select("j", "ours", "theirs", F.col("__m").isNull().alias("unmatched"))


def voxel_labels(points: DataFrame, axes: list[str], reach: int = 0) -> DataFrame:
    """Voxels within reach steps along one axis each (a cross) of a point, with the largest j of those that reach them."""
    steps = [(0,) * len(axes)]
    for k in range(len(axes)):
        steps += [tuple(d if i == k else 0 for i in range(len(axes))) for r in range(1, reach + 1) for d in (-r, r)]
    lit = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    spread = points.select("j", *axes, F.explode(lit).alias("s"))
    return spread.select(*[(F.col(x) + F.col("s")[i]).alias(x) for i, x in enumerate(axes)], "j").groupBy(*axes).agg(F.max("j").alias("j"))


def dilate(mask: DataFrame, radii: dict[str, int], by: list[str] = ()) -> DataFrame:
    """Voxels within an ellipsoid of a voxel of the mask, within each of `by`."""
    axes = list(radii)
    ok = [s for s in product(*[range(-r, r + 1) for r in radii.values()]) if sum((x / max(r, 1e-9)) ** 2 for x, r in zip(s, radii.values()) if x) <= 1]
    lit = F.array(*[F.array(*map(F.lit, s)) for s in ok])
    moved = mask.select(*by, *axes, F.explode(lit).alias("s"))
    return moved.select(*by, *[(F.col(x) + F.col("s")[i]).alias(x) for i, x in enumerate(axes)]).distinct()


def sweep(truth: DataFrame, found: DataFrame, radius: float, axes: list[str], thresholds: list[float], value: str = "v") -> DataFrame:
    """threshold, n_found, fn, fp, detection_rate, false_discovery_rate of the found points of at least each threshold.

    One matching serves all thresholds: a true point is missed above the largest value near it, a found one is false at
    any. Both are counted by the number of thresholds that they reach, and a row a threshold is summed up from there.
    """
    levels = sorted(set(map(float, thresholds)))
    reached = lambda c: F.size(F.filter(F.array(*map(F.lit, levels)), lambda t: t <= c))
    a = _cells(truth.withColumn("__row", F.struct(*truth.columns)), axes, radius, False).alias("a")
    b = _cells(found, axes, radius, True).alias("b")
    seen = truth.groupBy(*axes, "j").agg(F.count("*").alias("__times"))  # equal points have equal neighbours
    best = a.join(b, _near(axes, radius)).groupBy(*[F.col(f"a.{x}").alias(x) for x in axes], F.col("a.j").alias("j")).agg(F.max(F.col(f"b.{value}")).alias("__best"))
    truths = seen.join(best, [*axes, "j"], "left").groupBy(F.coalesce(reached(F.col("__best")), F.lit(0)).alias("k")).agg(F.sum("__times").alias("truths"))
    near = within(found, truth, radius, axes).groupBy(reached(F.col(value)).alias("k")).agg(F.count("*").alias("agreeing"))
    every = found.groupBy(reached(F.col(value)).alias("k")).agg(F.count("*").alias("found"))
    zero = F.lit(0).cast("long")
    parts = [truths.select("k", "truths", zero.alias("agreeing"), zero.alias("found")), near.select("k", zero.alias("truths"), "agreeing", zero.alias("found")), every.select("k", zero.alias("truths"), zero.alias("agreeing"), "found")]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = truth.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(levels)], "nth int, threshold double")
    # A row for each number of reached thresholds: as many as there are thresholds.
    reach = lambda c: F.sum(F.when(F.col("k") >= F.col("nth"), F.col(c)).otherwise(0))
    by = F.broadcast(counts.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("truths", "agreeing", "found")]))
    summed = rows.crossJoin(by).groupBy("nth", "threshold").agg(F.sum("truths").alias("all"), reach("truths").alias("hit"), reach("agreeing").alias("agreeing"), reach("found").alias("n_found"))
    fn, fp = F.col("all") - F.col("hit"), F.col("n_found") - F.col("agreeing")
    return summed.select("threshold", "n_found", fn.alias("fn"), fp.alias("fp"), (1 - fn / F.col("all")).alias("detection_rate"), (fp / F.greatest("n_found", F.lit(1))).alias("false_discovery_rate"))
