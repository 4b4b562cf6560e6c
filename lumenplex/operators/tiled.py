"""Neighbourhood operators on tiles: each row goes to the tiles that look at it, once, and all axes are done there.

A tile is a dense block of a few frames, as wide as INNER plus a halo of the operator's reach, so any stack is cut
into independent pieces: one shuffle for an operator, however many axes it has, and its input is evaluated once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, StructField, StructType

#: A tile's own width by the number of axes that an operator works on, and how many frames or planes are in one block.
INNER = {1: 4096, 2: 512, 3: 64}
TOGETHER = 8

#: fn(block, held, at_edge) gives block and held anew: axes are (rest, *axes), at_edge[axis] tells which sides are the stack's own.
Step = Callable[[np.ndarray, np.ndarray, list[tuple[bool, bool]]], tuple[np.ndarray, np.ndarray]]


def over_tiles(stack: DataFrame, sizes: dict[str, int], reach: dict[str, int], fn: Step, value: str | tuple[str, ...] = "v", inner: dict[str, int] | None = None) -> DataFrame:
    """Rows of fn's result; held says which voxels have rows. Rows beyond the sizes take no part; nulls count as zeros.

    With several value columns, blocks have them along a last axis.
    """
    axes = list(reach)
    values = [value] if isinstance(value, str) else list(value)
    inner = inner or dict.fromkeys(axes, INNER.get(len(axes), 32))
    columns = stack.columns
    rest = [c for c in columns if c not in (*axes, *values)]
    dealt = stack
    for a in axes:
        low = F.greatest(F.floor((F.col(a) - reach[a]) / inner[a]), F.lit(0))
        high = F.least(F.floor((F.col(a) + reach[a]) / inner[a]), F.lit((sizes[a] - 1) // inner[a]))
        dealt = dealt.where(F.col(a).between(0, sizes[a] - 1)).withColumn(f"__t_{a}", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    whole = {f.name for f in stack.schema if isinstance(f.dataType, IntegralType)}
    groups = [(F.floor(F.col(c) / TOGETHER) if c in whole else F.col(c)).alias(f"__g{i}") for i, c in enumerate(rest)]
    schema = StructType([StructField(f.name, DoubleType()) if f.name in values else f for f in stack.schema])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = [int(pdf[f"__t_{a}"].iloc[0]) for a in axes]
        own = [(k * inner[a], min((k + 1) * inner[a], sizes[a])) for k, a in zip(tile, axes)]
        look = [(max(lo - reach[a], 0), min(hi + reach[a], sizes[a])) for (lo, hi), a in zip(own, axes)]
        which, kinds = pd.MultiIndex.from_frame(pdf[rest]).factorize() if rest else (np.zeros(len(pdf), int), None)
        at = (which, *[pdf[a].to_numpy() - lo for a, (lo, _) in zip(axes, look)])
        held = np.zeros((which.max() + 1, *[hi - lo for lo, hi in look]), bool)
        x = np.zeros((*held.shape, len(values)))
        np.add.at(x, at, pdf[values].fillna(0.0).to_numpy(float))
        held[at] = True
        x = x[..., 0] if isinstance(value, str) else x
        x, held = fn(x, held, [(lo == 0, hi == sizes[a]) for (lo, hi), a in zip(look, axes)])
        inside = (slice(None), *[slice(lo - l0, hi - l0) for (lo, hi), (l0, _) in zip(own, look)])
        x, held = x[inside], held[inside]
        found = np.nonzero(held)
        out = {a: f + lo for a, f, (lo, _) in zip(axes, found[1:], own)} | dict(zip(values, x[found].reshape(len(found[0]), -1).T))
        for i, c in enumerate(rest):
            out[c] = kinds.get_level_values(i).to_numpy()[found[0]]
        return pd.DataFrame(out)[columns]

    return dealt.groupBy(*[f"__t_{a}" for a in axes], *groups).applyInPandas(run, schema)


def kernel(sigma: float, truncate: float = 3.0, rounded: bool = False) -> list[tuple[int, float]]:
    """A normalised Gaussian on the integers up to ceil(truncate * sigma), or to the nearest integer."""
    if sigma <= 0:
        return [(0, 1.0)]
    r = int(truncate * sigma + 0.5) if rounded else math.ceil(truncate * sigma)
    w = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    return [(d, x / sum(w)) for d, x in zip(range(-r, r + 1), w)]


def blurred(x: np.ndarray, axis: int, weights: list[tuple[int, float]], at_edge: tuple[bool, bool] = (False, False)) -> np.ndarray:
    """Weighted sums of neighbours along an axis; beyond an edge in at_edge the block is mirrored, elsewhere zero."""
    r = weights[-1][0]
    if not r:
        return x
    n = x.shape[axis]
    cut = lambda a, b: x[(slice(None),) * axis + (slice(a, b),)]
    side = lambda part, mirror: np.flip(part, axis) if mirror else np.zeros_like(part)
    wide = np.concatenate((side(cut(0, min(r, n)), at_edge[0]), x, side(cut(max(n - r, 0), n), at_edge[1])), axis)
    lead = min(r, n)
    out = np.zeros_like(x, dtype=float)
    for d, w in weights:
        a, b = lead + d, lead + d + n
        lo, hi = max(a, 0), min(b, wide.shape[axis])
        if lo < hi:
            out[(slice(None),) * axis + (slice(lo - a, n - (b - hi)),)] += w * wide[(slice(None),) * axis + (slice(lo, hi),)]
    return out


def gaussian_step(kernels: list[list[tuple[int, float]]], mirrored: bool = False) -> Step:
    def step(x, held, at_edge):
        seen = held.astype(float)
        for i, weights in enumerate(kernels):
            edges = at_edge[i] if mirrored else (False, False)
            x = blurred(x, i + 1, weights, edges)
            seen = blurred(seen, i + 1, [(d, 1.0) for d, _ in weights], edges)
        return x, seen > 0.5

    return step
