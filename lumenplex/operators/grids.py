"""Stacks in LONG layout: normalisation, blocks, blur, neighbourhoods, fractional shifts.

Absent rows are zeros for sums; operators that need rows present say so. Blur, sharpening and background work on
tiles with halos, all axes at once. Elsewhere a table of offsets is a literal of a few entries: values scatter to their
neighbours' keys and are summed or maximised there, so partial aggregation meets most of a neighbourhood before
anything is shuffled, where rows are stored by place.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenplex.operators.lineage import cut
from lumenplex.operators.tiled import INNER, blurred, gaussian_step, kernel, over_tiles


def dense(stack: DataFrame, sizes: dict[str, int], frames: DataFrame | None = None) -> DataFrame:
    """Every voxel of every frame, zeros where rows are absent. frames: the frames n, those with rows if None."""
    grid = frames if frames is not None else stack.select("n").distinct()
    for axis, size in sizes.items():
        grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(axis))
    return grid.join(stack, ["n", *sizes], "left").select("n", *sizes, F.coalesce("v", F.lit(0.0)).alias("v"))


def minmax(stack: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Values scaled to 0..1 within each group; NULL where a group is constant. Small groups' bounds are joined."""
    bounds = stack.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return stack.join(bounds, by).withColumn(value, F.when(span > 0, (F.col(value) - F.col("__lo")) / span)).drop("__lo", "__hi")


def preprocessed(stack: DataFrame, sizes: dict[str, int], sigmas: dict[str, float], by: list[str]) -> DataFrame:
    """The standard chain: scaled to 0..1 within each group, less the background, scaled again.

    What the tiles make is written once, as the second scaling reads it twice: for the bounds and for the values.
    """
    return minmax(cut(subtract_background(minmax(stack, by), sizes, sigmas)), by)


def convolve(stack: DataFrame, axis: str, size: int, weights: list[tuple[int, float]], value: str = "v") -> DataFrame:
    """Sums of weighted neighbours along an axis of 0..size - 1, zeros beyond; only reached voxels have rows."""
    if weights == [(0, 1.0)]:
        return stack
    keys = [c for c in stack.columns if c not in (value, axis)]
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in weights])
    spread = stack.select(*keys, F.col(axis), F.col(value), F.explode(taps).alias("k"))
    moved = spread.select(*keys, (F.col(axis) + F.col("k.d")).alias(axis), (F.col(value) * F.col("k.w")).alias(value))
    return moved.where(F.col(axis).between(0, size - 1)).groupBy(*keys, axis).agg(F.sum(value).alias(value)).select(*stack.columns)


def gaussian(stack: DataFrame, sizes: dict[str, int], sigmas: dict[str, float], value: str = "v", truncate: float = 3.0, border: str = "zero") -> DataFrame:
    """Separable blur over the named axes; a sigma of 0 leaves its axis alone.

    border "zero": nothing beyond the edges, only reached voxels have rows. "reflect": the stack mirrored at its
    edges, the kernel ending at the integer nearest to truncate * sigma (4 is usual); an axis must be as long as that.
    """
    if border not in ("zero", "reflect"):
        raise ValueError(border)
    kernels = {a: kernel(s, truncate, border == "reflect") for a, s in sigmas.items() if s > 0}
    if not kernels:
        return stack
    return over_tiles(stack, sizes, {a: k[-1][0] for a, k in kernels.items()}, gaussian_step(list(kernels.values()), border == "reflect"), value)


def sharpen(stack: DataFrame, sizes: dict[str, int], sigmas: dict[str, float], levels: dict[str, float]) -> DataFrame:
    """x + level * (x - blurred x), one axis after the other; rows stay as they are."""
    kernels = {a: kernel(s) for a, s in sigmas.items()}

    def step(x, held, at_edge):
        for i, a in enumerate(kernels):
            x = np.where(held, x + levels[a] * (x - blurred(x, i + 1, kernels[a])), 0.0)
        return x, held

    return over_tiles(stack, sizes, {a: k[-1][0] for a, k in kernels.items()}, step)


def subtract_background(stack: DataFrame, sizes: dict[str, int], sigmas: dict[str, float], last_axis_only: bool = False) -> DataFrame:
    """max(x - blurred x, 0); rows stay as they are. last_axis_only blurs along the last axis alone."""
    if last_axis_only:
        sigmas = dict([list(sigmas.items())[-1]])
    kernels = {a: kernel(s) for a, s in sigmas.items()}
    blur = gaussian_step(list(kernels.values()))
    step = lambda x, held, at_edge: (np.maximum(x - blur(x, held, at_edge)[0], 0.0), held)
    return over_tiles(stack, sizes, {a: k[-1][0] for a, k in kernels.items()}, step)


def doublenorm(stack: DataFrame, sizes: dict[str, int], low: float = 1.0, sigma: float = 5.0) -> DataFrame:
    """Values over the largest one anywhere, then each over low + its blurred surroundings; rows stay as they are."""
    top = F.broadcast(stack.agg(F.max("v").alias("__top")))  # one row
    scaled = stack.crossJoin(top).withColumn("v", F.col("v") / F.col("__top")).drop("__top")
    weights = kernel(sigma)
    blur = gaussian_step([weights] * len(sizes))
    step = lambda x, held, at_edge: (x / (low + blur(x, held, at_edge)[0]), held)
    return over_tiles(scaled, sizes, dict.fromkeys(sizes, weights[-1][0]), step)


def crop(stack: DataFrame, start: dict[str, int], stop: dict[str, int], fill: float | None = 0.0) -> DataFrame:
    """Every voxel of the box [start, stop), counted from its start; `fill` where the stack has no row (None: no row)."""
    inside = F.lit(True)
    for a in start:
        inside = inside & (F.col(a) >= start[a]) & (F.col(a) < stop[a])
    own = stack.where(inside).withColumns({a: F.col(a) - start[a] for a in start})
    if fill is None:
        return own
    grid = stack.select("n").distinct()
    for a in start:
        grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(stop[a] - start[a] - 1))).alias(a))
    return grid.join(own, ["n", *start], "left").select("n", *start, F.coalesce("v", F.lit(float(fill))).alias("v"))


def overwrite(stack: DataFrame, updates: DataFrame, sizes: dict[str, int], order: str) -> DataFrame:
    """The stack with the values of updates in their voxels, the last by `order` among several; those beyond the sizes are ignored."""
    inside = F.lit(True)
    for a, size in sizes.items():
        inside = inside & F.col(a).between(0, size - 1)
    last = updates.where(inside).groupBy("n", *sizes).agg(F.max_by("v", order).alias("__new"))
    return stack.join(last, ["n", *sizes], "full").select("n", *sizes, F.coalesce("__new", "v").alias("v"))


def log_counts(pairs: DataFrame, x: str, y: str, width: float, weight: str | None = None) -> DataFrame:
    """bin_x, bin_y and the logarithm of how many pairs (or of 1 + the sum of a weight) fall into square bins."""
    total = F.log(F.count("*")) if weight is None else F.log(1 + F.sum(weight))
    return pairs.groupBy(F.floor(F.col(x) / width).alias("bin_x"), F.floor(F.col(y) / width).alias("bin_y")).agg(total.alias("log_n"))


def block_mean(stack: DataFrame, blocks: dict[str, int], sizes: dict[str, int] | None = None, trim: bool = True) -> DataFrame:
    """Mean over blocks of voxels, absent ones counted as zeros. trim drops a partial last block (needs sizes)."""
    if trim and sizes:
        for axis, d in blocks.items():
            stack = stack.where(F.col(axis) < sizes[axis] // d * d)
    return _blocks(stack, blocks, math.prod(blocks.values()))


def block_sum(stack: DataFrame, blocks: dict[str, int]) -> DataFrame:
    """Strided sums over blocks, each divided by the block's nominal lengths, a partial last block too."""
    return _blocks(stack, blocks, math.prod(blocks.values()))


def _blocks(stack: DataFrame, blocks: dict[str, int], volume: int) -> DataFrame:
    keys = [F.floor(F.col(c) / blocks[c]).cast("int").alias(c) if c in blocks else F.col(c) for c in stack.columns if c != "v"]
    return stack.groupBy(*keys).agg((F.sum("v") / volume).alias("v"))


def decimate(stack: DataFrame, axis: str, n: int, size: int) -> DataFrame:
    """Mean of every n consecutive voxels; n must divide the axis."""
    if size % n:
        raise ValueError(f"{n} doesn't divide {size}")
    return block_mean(stack, {axis: n}, {axis: size})


def peaks(stack: DataFrame, radius: dict[str, int], threshold: float, by: str = "j", value: str = "v") -> DataFrame:
    """Voxels above the threshold that no neighbour within the box exceeds; all of a plateau. Compared as FLOAT.

    Each candidate asks its box's keys: only voxels above the threshold matter on either side, since a larger
    neighbour of such a voxel is above it too.
    """
    axes = list(radius)
    x = stack.select(by, *axes, F.col(value).cast("float").alias(value)).where(F.col(value) > F.lit(threshold).cast("float"))
    steps = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, ds)]) for ds in product(*[range(-r, r + 1) for r in radius.values()])])
    reached = x.select(by, *axes, value, F.explode(steps).alias("s")).select(by, *[(F.col(a) + F.col(f"s.{a}")).alias(a) for a in axes], value)
    best = reached.groupBy(by, *axes).agg(F.max(value).alias("__best"))
    return x.join(best, [by, *axes]).where(F.col(value) == F.col("__best")).drop("__best")


def shift(stack: DataFrame, axis: str, t: Column, size: int, method: str = "linear", length: int | None = None) -> DataFrame:
    """out[k] = X[k + t] for k in 0..size - 1 along an axis; t may differ by row (by frame). Zero beyond the edges.

    Each value scatters to the outputs that it takes part in: 1 for nearest, 2 for linear, 4 for hermite. Hermite
    slopes are central differences, one-sided at the ends of an axis of `length` voxels and zero beyond them.
    """
    keys = [c for c in stack.columns if c not in ("v", axis)]
    m = F.col(axis)
    f = F.floor(t).cast("int")
    p = t - f
    if method == "nearest":
        taps = F.array(F.struct((m - F.rint(t).cast("int")).alias("k"), F.lit(1.0).alias("w")))
    elif method == "linear":
        taps = F.array(F.struct((m - f).alias("k"), (1 - p).alias("w")), F.struct((m - f - 1).alias("k"), p.alias("w")))
    elif method == "hermite":
        u = 1 - p
        h00, h10, h01, h11 = (1 + 2 * p) * u * u, p * u * u, p * p * (3 - 2 * p), -p * p * u
        # X[i] enters out[k] as a value at i = k + f and i = k + f + 1, and in the slopes of both.
        up = lambda i: F.when(i == 0, 1.0).otherwise(0.5)  # noqa: E731  weight of X[i + 1] in the slope at i
        down = lambda i: F.when(i == length - 1, 1.0).otherwise(0.5)  # noqa: E731  of -X[i - 1]
        here = lambda i: F.when(i == 0, -1.0).when(i == length - 1, 1.0).otherwise(0.0)  # noqa: E731  of X[i] itself
        tap = lambda k, w: F.struct(k.alias("k"), w.alias("w"))
        inside = lambda i, w: F.when((i >= 0) & (i < length), w).otherwise(0.0)
        taps = F.array(
            tap(m - f, h00 + h10 * here(m)),
            tap(m - f - 1, h01 + h11 * here(m)),
            tap(m - f - 1, inside(m - 1, h10 * up(m - 1))),
            tap(m - f - 2, inside(m - 1, h11 * up(m - 1))),
            tap(m - f + 1, inside(m + 1, -h10 * down(m + 1))),
            tap(m - f, inside(m + 1, -h11 * down(m + 1))),
        )
    else:
        raise ValueError(method)
    moved = stack.select(*keys, F.col("v"), F.explode(taps).alias("x")).select(*keys, F.col("x.k").cast("int").alias(axis), (F.col("v") * F.col("x.w")).alias("v"))
    return moved.where(F.col(axis).between(0, size - 1)).groupBy(*keys, axis).agg(F.sum("v").alias("v")).select(*stack.columns)


def lucy_richardson(target: DataFrame, sizes: dict[str, int], sigmas: dict[str, float], niter: int, threshold: float = 1e-10, guess: DataFrame | None = None) -> DataFrame:
    """Deconvolution by repeated blur and ratio from a guess (flat if None) of the target's voxels; the kernel is symmetric.

    An iteration looks twice the kernel's reach around a voxel, so tiles with a halo of several times that do several
    iterations at once: one shuffle and one written table for them.
    """
    keys = [c for c in target.columns if c != "v"]
    kernels = {a: kernel(s) for a, s in sigmas.items()}
    weights, reach = list(kernels.values()), {a: k[-1][0] for a, k in kernels.items()}
    x = target.withColumn("__x", F.lit(1.0)) if guess is None else target.join(guess.select(*keys, F.col("v").alias("__x")), keys, "left").withColumn("__x", F.coalesce("__x", F.lit(0.0)))
    together = max(min((INNER.get(len(reach), 32) // max(8 * r, 1) for r in reach.values()), default=1), 1)

    def steps(n: int):
        def blur(x: np.ndarray) -> np.ndarray:
            for i, w in enumerate(weights):
                x = blurred(x, i + 1, w)
            return x

        def run(block: np.ndarray, held: np.ndarray, at_edge):
            seen, x = block[..., 0], np.where(held, block[..., 1], 0.0)
            total = blur(held.astype(float))
            for _ in range(n):
                b = blur(x)
                ratio = np.where(held & (b >= threshold), seen / np.where(b >= threshold, b, 1), 0)
                x = np.where(held, x * blur(ratio) / np.where(held, total, 1), 0)
            return np.stack((seen, x), -1), held

        return run

    for first in range(0, niter, together):
        n = min(together, niter - first)
        x = cut(over_tiles(x, sizes, {a: 2 * r * n for a, r in reach.items()}, steps(n), ("v", "__x")))
    return x.withColumn("v", F.col("__x")).select(*target.columns)
