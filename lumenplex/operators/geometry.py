"""Meshes and shapes as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Places of the lines that are looked at together.
TOGETHER = 1 << 20


def boundary_faces(simplices: DataFrame, by: list[str] = ()) -> DataFrame:
    """a, b, c of the faces that occur once among tetrahedra p0..p3: the surface of what they fill, within each of `by`."""
    p = [F.col(f"p{i}") for i in range(4)]
    faces = F.array(*[F.sort_array(F.array(*[p[i] for i in range(4) if i != k])) for k in range(4)])
    each = simplices.select(*by, F.explode(faces).alias("f")).select(*by, *[F.col("f")[i].alias(x) for i, x in enumerate("abc")])
    return each.groupBy(*by, "a", "b", "c").agg(F.count("*").alias("__n")).where(F.col("__n") == 1).drop("__n")


def envelope(g: np.ndarray) -> np.ndarray:
    """For each line of g (lines, places) the least of g[q] + (p - q)^2 at every p: lower envelopes of parabolas, all lines at once."""
    lines, size = g.shape
    if not size:
        return g
    rows, at = np.arange(lines), np.zeros((lines, size), int)
    edge = np.full((lines, size + 1), np.inf)
    edge[:, 0] = -np.inf
    top = np.zeros(lines, int)
    for q in range(1, size):
        open_ = rows
        while len(open_):  # drop parabolas that the new one hides
            v = at[open_, top[open_]]
            cross = ((g[open_, q] + q * q) - (g[open_, v] + v * v)) / (2.0 * (q - v))
            hidden = cross <= edge[open_, top[open_]]
            done = open_[~hidden]
            top[done] += 1
            at[done, top[done]] = q
            edge[done, top[done]] = cross[~hidden]
            open_ = open_[hidden]
            top[open_] -= 1
        edge[rows, top + 1] = np.inf
    out, k = np.empty(g.shape), np.zeros(lines, int)
    for p in range(size):
        while (behind := edge[rows, k + 1] < p).any():
            k += behind
        v = at[rows, k]
        out[:, p] = g[rows, v] + (p - v) ** 2
    return out


def distance_transform(mask: DataFrame, axis: str, size: int, by: list[str], far: float = 100_000.0, every: bool = False) -> DataFrame:
    """One pass of the squared distance transform: along an axis, the least of value + squared distance, at most far.

    mask: by, axis, g (the squared distance so far; absent rows are far). A task holds whole lines, some together; places
    that stay far have no row unless every place of a line is asked for.
    """
    columns = [*by, axis, "g"]
    together = max(TOGETHER // size, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), together):
                pdf = whole.iloc[k : k + together]
                g = np.full((len(pdf), size), float(far))
                for row, (places, values) in enumerate(zip(pdf[axis], pdf["g"])):
                    np.minimum.at(g[row], np.asarray(places, int), np.asarray(values, float))
                g = np.minimum(envelope(g), far)
                line, place = np.nonzero(np.ones_like(g, bool) if every else g < far)
                yield pd.DataFrame({b: pdf[b].to_numpy()[line] for b in by} | {axis: place, "g": g[line, place]})[columns]

    inside = mask.where(F.col(axis).between(0, size - 1) & (F.lit(True) if every else F.col("g") < far)).withColumn("__g", F.col("g").cast("double"))
    lines = inside.groupBy(*by).agg(F.collect_list(axis).alias(axis), F.collect_list("__g").alias("g"))
    kinds = {f.name: f.dataType.simpleString() for f in mask.schema}
    return lines.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*by, axis]) + ", g double")


def signal_distance(stack: DataFrame, sizes: dict[str, int], by: list[str], far: float = 100_000.0) -> DataFrame:
    """by, axes, g at every place: the least of far * (1 - v) + squared distance over the frame's places. Absent voxels are zeros, so densify first."""
    axes = list(sizes)
    out = stack.select(*by, *axes, (F.lit(far) * (1 - F.col("v"))).alias("g"))
    for a in axes:
        out = distance_transform(out, a, sizes[a], [*by, *[o for o in axes if o != a]], far, every=True)
    return out.select(*by, *axes, "g")


def skeleton(stack: DataFrame, sizes: dict[str, int], radius: float = 20.0, smooth: float = 1.0, far: float = 100_000.0, padded: bool = False) -> DataFrame:
    """n, axes, g: the squared distance to what lies farther than `radius` (squared) from the signal, softly.

    v within 0..1, every voxel present. padded: beyond the border all counts as far from the signal, one place wide.
    """
    axes = list(sizes)
    soft = 1 / (1 + F.exp(-(F.col("g") - radius) / smooth))
    far_off = signal_distance(stack, sizes, ["n"], far).select("n", *axes, soft.alias("v"))
    if not padded:
        return signal_distance(far_off, sizes, ["n"], far)
    moved = far_off.select("n", *[(F.col(a) + 1).alias(a) for a in axes], "v")
    wide = {a: n + 2 for a, n in sizes.items()}
    rim = stack.select("n").distinct()
    for a, n in wide.items():
        rim = rim.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(a))
    at_border = F.lit(False)
    for a, n in wide.items():
        at_border = at_border | (F.col(a) == 0) | (F.col(a) == n - 1)
    both = moved.unionByName(rim.where(at_border).withColumn("v", F.lit(1.0)))
    found = signal_distance(both, wide, ["n"], far).select("n", *[(F.col(a) - 1).alias(a) for a in axes], "g")
    return found.where(" and ".join(f"{a} between 0 and {n - 1}" for a, n in sizes.items()))


def total_variation(truth: DataFrame, estimate: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Half the summed absolute difference of two stacks, each scaled to sum 1 within its group."""
    share = lambda df, name: df.join(df.groupBy(*by).agg(F.sum("v").alias("__s")), by).select(*keys, (F.col("v") / F.col("__s")).alias(name))
    both = share(truth, "__a").join(share(estimate, "__b"), keys, "full")
    return both.groupBy(*by).agg((0.5 * F.sum(F.abs(F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0))))).alias("loss"))
