"""Evidence of every code in every voxel: the normalised inner product of what was seen with what is expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenplex.functions.columns import dot, norm
from lumenplex.operators.codebooks import MAX_ENTRIES, packed


def _one_row(codes: DataFrame) -> DataFrame:
    """The codebook as one row `codes`: ARRAY<STRUCT<j, code, size>>; refused beyond MAX_ENTRIES."""
    if codes.limit(MAX_ENTRIES + 1).count() > MAX_ENTRIES:
        raise ValueError(f"a codebook of more than {MAX_ENTRIES} entries doesn't go into one row")
    filled = packed(codes).withColumn("code", F.transform("code", lambda x: F.coalesce(x, F.lit(0.0))))
    return filled.agg(F.sort_array(F.collect_list(F.struct("j", "code", norm("code").alias("size")))).alias("codes"))


def _valued(voxels: DataFrame, codes: DataFrame, floor: float | None, factor: float) -> tuple[DataFrame, list[str]]:
    """Voxels with `all`: ARRAY<STRUCT<j, e>>, an entry per code; and the voxels' own columns."""
    book = F.broadcast(_one_row(codes))
    if floor is None:
        top = voxels.agg((F.max(F.array_max("obs")) * factor * F.max(F.size("obs"))).alias("__floor"))
        book = F.broadcast(book.crossJoin(top))
    else:
        book = book.withColumn("__floor", F.lit(float(floor)))
    keys = [c for c in voxels.columns if c not in ("obs", "j")]
    seen = voxels.select(*keys, "obs", norm("obs").alias("__size")).crossJoin(book)
    value = lambda c: F.when(c["size"] > 0, dot("obs", c["code"]) / ((F.col("__size") + F.col("__floor")) * c["size"]))
    return seen.select(*keys, F.transform("codes", lambda c: F.struct(c["j"].alias("j"), value(c).alias("e"))).alias("all")), keys


def evidence(voxels: DataFrame, codes: DataFrame, floor: float | None = None, factor: float = 0.0005, above: float | None = None) -> DataFrame:
    """Columns of voxels without obs, j and e = <obs, code> / ((|obs| + floor) |code|), for every voxel and code.

    The VOXEL layout keeps a voxel's frames in one row, so nothing is shuffled: the codebook, of checked size, is
    broadcast as one row. Unknown entries count as 0; an all-zero code has NULL. Without a floor it is
    max(obs) * factor * frames, from one aggregate over the voxels. above: only rows with a larger e leave the voxel.
    """
    seen, keys = _valued(voxels, codes, floor, factor)
    held = "all" if above is None else F.filter("all", lambda x: x["e"] > above)
    return seen.select(*keys, F.explode(held).alias("x")).select(*keys, "x.j", "x.e")


def best_code(voxels: DataFrame, codes: DataFrame, floor: float | None = None, threshold: float | None = None, factor: float = 0.0005) -> DataFrame:
    """Per voxel the code of the largest evidence, the least j among equals; -1 below the threshold. Map-only.

    Voxels without evidence of any code have no row.
    """
    seen, keys = _valued(voxels, codes, floor, factor)
    best = F.array_min(F.transform(F.filter("all", lambda x: x["e"].isNotNull()), lambda x: F.struct((-x["e"]).alias("v"), x["j"].alias("j"))))
    found = seen.select(*keys, best.alias("b")).where("b is not null")
    low = F.lit(False) if threshold is None else -F.col("b.v") < threshold
    return found.select(*keys, F.when(low, F.lit(-1)).otherwise(F.col("b.j")).alias("j"), (-F.col("b.v")).alias("e"))


def label(density: DataFrame, keys: list[str], threshold: float | None = None, value: str = "e") -> DataFrame:
    """Per voxel the code with the largest value, the least j among equals; -1 below the threshold (no threshold: all)."""
    best = F.min(F.struct((-F.col(value)).alias("v"), "j")).alias("b")
    found = density.where(F.col(value).isNotNull()).groupBy(*keys).agg(best)
    top = -F.col("b.v")
    low = F.lit(True) if threshold is None else top < threshold
    return found.select(*keys, F.when(low, F.lit(-1)).otherwise(F.col("b.j")).alias("j"), top.alias(value))


def above_share_of_top(density: DataFrame, share: float, value: str = "e") -> DataFrame:
    """Rows above a share of the largest value anywhere."""
    top = F.broadcast(density.agg((F.max(value) * share).alias("__least")))  # one row
    return density.crossJoin(top).where(F.col(value) > F.col("__least")).drop("__least")


def to_voxels(stack: DataFrame, n_frames: int, axes: list[str]) -> DataFrame:
    """VOXEL from LONG: one shuffle by voxel; absent frames are zeros."""
    held = stack.groupBy(*axes).agg(F.map_from_entries(F.collect_list(F.struct("n", "v"))).alias("__m"))
    obs = F.transform(F.sequence(F.lit(0), F.lit(n_frames - 1)), lambda n: F.coalesce(F.try_element_at("__m", n), F.lit(0.0)))
    return held.select(*axes, obs.alias("obs"))


def to_long(voxels: DataFrame) -> DataFrame:
    """LONG from VOXEL, without a shuffle."""
    keys = [c for c in voxels.columns if c != "obs"]
    return voxels.select(*keys, F.posexplode("obs").alias("n", "v"))
