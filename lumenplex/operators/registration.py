"""Where frames lie relative to each other, and stacks moved accordingly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenplex.operators.grids import shift


def centred(pairs: DataFrame) -> DataFrame:
    """f1, f2, axis, d pairwise offsets to one offset t per frame f2 and axis: mean over f2 of d less its column mean."""
    of_f2 = pairs.groupBy("f2", "axis").agg(F.avg("d").alias("m"))
    return pairs.join(of_f2, ["f2", "axis"]).groupBy(F.col("f1").alias("n"), "axis").agg(F.avg(F.col("d") - F.col("m")).alias("t"))


def _meeting(x: DataFrame, y: DataFrame, axes: list[str], reach: int | dict[str, int] | None, by: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Summed products of x[m + t] y[m] by offset t_<axis> and the columns `by` (x's name, y's name).

    Voxels meet by grid cells as wide as the reach, so no pair of far ones is looked at.
    """
    if reach is None:
        spans = x.select(*axes).unionByName(y.select(*axes)).agg(*[F.max(c).alias(f"hi_{c}") for c in axes], *[F.min(c).alias(f"lo_{c}") for c in axes]).first()
        reach = {c: int((spans[f"hi_{c}"] or 0) - (spans[f"lo_{c}"] or 0)) for c in axes}
    reach = reach if isinstance(reach, dict) else dict.fromkeys(axes, reach)
    a = x.select(*[F.col(n) for n, _ in by], *[F.col(c).alias(f"a_{c}") for c in axes], F.col("v").alias("a_v"))
    b = y.select(*[F.col(n) for _, n in by], *[F.col(c).alias(f"b_{c}") for c in axes], F.col("v").alias("b_v"))
    cell = lambda c, side, s: (F.floor(F.col(f"{side}_{c}") / (reach[c] + 1)) + s).cast("long")
    a = a.select("*", *[cell(c, "a", 0).alias(f"k_{c}") for c in axes])
    near = F.lit(True)
    for c in axes:
        b = b.select("*", F.explode(F.array(*[cell(c, "b", s) for s in (-1, 0, 1)])).alias(f"k_{c}"))
        near = near & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= reach[c])
    offset = [(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"t_{c}") for c in axes]
    names = [n for pair in by for n in pair]
    return a.join(b, [f"k_{c}" for c in axes]).where(near).groupBy(*names, *offset).agg(F.sum(F.col("a_v") * F.col("b_v")).alias("product"))


def products_at_offsets(x: DataFrame, y: DataFrame, axes: list[str], reach: int | dict[str, int] | None = None) -> DataFrame:
    """Summed products of x[m + t] y[m] for every offset t; both sparse, with columns axes and v.

    reach keeps offsets within a distance, by axis or one for all; without one every pair counts, which is for few voxels.
    """
    return _meeting(x, y, axes, reach)


def best_offset(products: DataFrame, axes: list[str]) -> DataFrame:
    """The offset with the largest product, the first in order among equals: one row."""
    names = [f"t_{c}" for c in axes]
    return products.agg(F.min(F.struct((-F.col("product")).alias("p"), *names)).alias("b")).select(*[F.col(f"b.{n}").alias(n) for n in names], (-F.col("b.p")).alias("product"))


def demeaned(stack: DataFrame, n_voxels: int) -> DataFrame:
    """Values less the mean over all n_voxels voxels of their frame; absent voxels stay absent, so densify first."""
    mean = stack.groupBy("n").agg((F.sum("v") / n_voxels).alias("__m"))
    return stack.join(mean, "n").withColumn("v", F.col("v") - F.col("__m")).drop("__m")


def pair_offsets(stack: DataFrame, axes: list[str], reach: int | dict[str, int] | None = None) -> DataFrame:
    """f1, f2, axis, d for every two frames: the best offset of f1 against f2 within the reach."""
    names = [f"t_{c}" for c in axes]
    sums = _meeting(stack.withColumnRenamed("n", "f1"), stack.withColumnRenamed("n", "f2"), axes, reach, (("f1", "f2"),))
    best = sums.groupBy("f1", "f2").agg(F.min(F.struct((-F.col("product")).alias("p"), *names)).alias("b"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(f"b.{n}").cast("double").alias("d")) for k, n in enumerate(names)]))
    return best.select("f1", "f2", each.alias("x")).select("f1", "f2", "x.axis", "x.d")


def region(translations: DataFrame, lengths: dict[int, int], mode: str = "valid", method: str = "linear") -> DataFrame:
    """n, axis, t in the output's frame of reference, and size, the output's length along the axis.

    valid: what all frames cover; full: all that any covers.
    """
    if mode not in ("valid", "full") or method not in ("nearest", "linear", "hermite"):
        raise ValueError((mode, method))
    edge = 1 if method == "hermite" else 0
    span = translations.groupBy("axis").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    length = F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv])[F.col("axis")]
    if mode == "valid":
        move, size = edge - F.col("lo"), length - 1 - 2 * edge - F.floor(F.col("hi") - F.col("lo"))
    else:
        move, size = -F.col("hi"), length + F.ceil(F.col("hi") - F.col("lo"))
    return translations.join(span, "axis").select("n", "axis", (F.col("t") + move).alias("t"), size.cast("int").alias("size"))


def apply_translations(stack: DataFrame, translations: DataFrame, axes: list[str], lengths: list[int], mode: str = "valid", method: str = "linear") -> DataFrame:
    """Frames moved by their translations onto a common grid; axes are moved one after the other."""
    placed = region(translations, dict(enumerate(lengths)), mode, method)
    sizes = {r["axis"]: r["size"] for r in placed.select("axis", "size").distinct().collect()}  # one row per axis
    for k, axis in enumerate(axes):
        own = placed.where(F.col("axis") == k).select("n", F.col("t").alias("__t"))
        moved = shift(stack.join(own, "n"), axis, F.col("__t"), sizes[k], method, lengths[k])
        stack = moved.drop("__t")
    return stack


def sample(stack: DataFrame, points: DataFrame, axes: list[str], constant: float = 0.0) -> DataFrame:
    """points with v: the voxel at their coordinates at_<axis>, rounded half to even; a constant where there is none."""
    keyed = points.select("*", *[F.rint(f"at_{a}").cast("int").alias(f"__{a}") for a in axes])
    near = stack.select("n", *[F.col(a).alias(f"__{a}") for a in axes], "v")
    joined = keyed.join(near, ["n", *[f"__{a}" for a in axes]], "left")
    return joined.select(*points.columns, F.coalesce("v", F.lit(constant)).alias("v"))


def affine_coordinates(voxels: DataFrame, affine: list[list[float]], axes: list[str]) -> DataFrame:
    """voxels with at_<axis> = m + A m + b for an affine given as rows of A with b last."""
    def at(row: list[float]) -> Column:
        return sum((F.col(a) * w for a, w in zip(axes, row)), F.lit(row[-1]))

    return voxels.select("*", *[(F.col(a) + at(row)).alias(f"at_{a}") for a, row in zip(axes, affine)])


def fit_affines(points: DataFrame, axes: list[str]) -> DataFrame:
    """n, axis and coefficients: least squares of local translations d on coordinates, per frame and axis.

    points: n, axis, x_<axis> coordinates and d. The normal equations are summed by Spark, a few numbers per frame and
    axis; each is then solved where it lies.
    """
    import numpy as np
    import pandas as pd

    names = [*[f"x_{a}" for a in axes], "__one"]
    x = points.withColumn("__one", F.lit(1.0))
    k = len(names)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]
    sums += [F.sum(F.col(a) * F.col("d")).alias(f"h{i}") for i, a in enumerate(names)]

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                g = np.array([[r[f"g{i}_{j}"] for j in range(k)] for i in range(k)])
                h = np.array([r[f"h{i}"] for i in range(k)])
                out.append((r["n"], r["axis"], np.linalg.lstsq(g, h, rcond=None)[0].tolist()))
            yield pd.DataFrame(out, columns=["n", "axis", "coefficients"])

    return x.groupBy("n", "axis").agg(*sums).mapInPandas(solve, "n int, axis int, coefficients array<double>")


def affine_residuals(points: DataFrame, fitted: DataFrame, axes: list[str]) -> DataFrame:
    """points with residual: what the fits of their frame and axis say, less d. Fits are a row a frame and axis, joined as Spark sees their size."""
    said = sum((F.get("coefficients", F.lit(i)) * F.col(f"x_{a}") for i, a in enumerate(axes)), F.get("coefficients", F.lit(len(axes))))
    return points.join(fitted, ["n", "axis"]).select(*points.columns, (said - F.col("d")).alias("residual"))


def resample_affine(stack: DataFrame, affine: list[list[float]], sizes: dict[str, int], constant: float = 0.0) -> DataFrame:
    """Frames on a grid of any sizes: at m the nearest voxel to m + A m + b, a constant where there is none.

    Only places of the grid are made; voxels come by one equi-join on rounded coordinates.
    """
    grid = stack.select("n").distinct()
    for axis, size in sizes.items():
        grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(axis))
    return sample(stack, affine_coordinates(grid, affine, list(sizes)), list(sizes), constant).select("n", *sizes, "v")
