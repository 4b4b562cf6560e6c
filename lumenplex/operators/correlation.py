"""Correlations of frames at all offsets, in the frequency domain: Fourier transforms along one axis at a time.

A transform along an axis needs whole lines along it and nothing else, so lines are grouped, some together, and each
axis is one shuffle of the voxels: no pair of voxels or tiles is looked at, and a task holds lines, never a frame. Along
the first axis the frames' spectra meet, are multiplied by pairs and transformed back; the other axes follow.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenplex.operators.grids import dense

#: Values of the lines in one group, and what sets the inner copies of frames apart.
TOGETHER, INNER = 1 << 16, 1 << 20


def _along(df: DataFrame, by: list[str], others: dict[str, int], axis: str, length: int, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """by, others, axis, re, im: every line along the axis, `length` values with zeros where rows are absent, put through step."""
    columns = [*by, *others, axis, "re", "im"]
    line = functools.reduce(lambda c, o: c * others[o] + F.col(o), others, F.lit(0).cast("long"))
    per = max(TOGETHER // length, 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [*by, *others]
        which, kinds = pd.MultiIndex.from_frame(pdf[names]).factorize() if names else (np.zeros(len(pdf), int), None)
        x = np.zeros((which.max() + 1, length), complex)
        x[which, pdf[axis]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = step(x)
        out = {c: np.repeat(kinds.get_level_values(i).to_numpy(), y.shape[1]) for i, c in enumerate(names)}
        out |= {axis: np.tile(np.arange(y.shape[1], dtype=np.int32), len(y)), "re": y.real.ravel(), "im": y.imag.ravel()}
        return pd.DataFrame(out)[columns]

    schema = ", ".join(f"{c} int" for c in columns[:-2]) + ", re double, im double"
    return df.select(*columns, F.floor(line / per).alias("__g")).groupBy(*by, "__g").applyInPandas(run, schema)


def _multiplied(df: DataFrame, others: dict[str, int], axis: str, length: int, pairs: list[tuple[int, int]]) -> DataFrame:
    """f1, f2, others, axis, re, im: per pair the product of f1's spectrum and f2's conjugate, back along the axis."""
    columns = ["f1", "f2", *others, axis, "re", "im"]
    line = functools.reduce(lambda c, o: c * others[o] + F.col(o), others, F.lit(0).cast("long"))
    frames = sorted({f for p in pairs for f in p})
    at = {f: i for i, f in enumerate(frames)}
    per = max(TOGETHER // (length * len(frames)), 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        which, kinds = pd.MultiIndex.from_frame(pdf[list(others)]).factorize() if others else (np.zeros(len(pdf), int), None)
        x = np.zeros((len(frames), which.max() + 1, length), complex)
        x[pdf["n"].map(at), which, pdf[axis]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        x = np.fft.fft(x)
        parts = []
        for a, b in pairs:
            y = np.fft.ifft(x[at[a]] * x[at[b]].conj())
            out = {"f1": a, "f2": b} | {c: np.repeat(kinds.get_level_values(i).to_numpy(), length) for i, c in enumerate(others)}
            parts.append(pd.DataFrame(out | {axis: np.tile(np.arange(length, dtype=np.int32), len(y)), "re": y.real.ravel(), "im": y.imag.ravel()}))
        return pd.concat(parts)[columns]

    schema = ", ".join(f"{c} int" for c in columns[:-2]) + ", re double, im double"
    return df.select("n", *columns[2:], F.floor(line / per).alias("__g")).groupBy("__g").applyInPandas(run, schema)


def products_of_frames(stack: DataFrame, sizes: dict[str, int], pairs: list[tuple[int, int]], cutin: dict[str, int] | None = None, demean: bool = True) -> DataFrame:
    """f1, f2, t_<axis>, product: sums of f1[m + t] f2[m] at every offset t, for each pair of frames.

    Absent voxels are zeros. demean: frames less their mean over all voxels. cutin: only places of f2 so far from its
    borders count.
    """
    axes = list(sizes)
    wanted = sorted({f for p in pairs for f in p})
    own = stack.where(F.col("n").isin(wanted))
    frames = stack.sparkSession.createDataFrame([(f,) for f in wanted], "n int")
    if demean:
        voxels = functools.reduce(lambda a, b: a * b, sizes.values())
        mean = frames.join(own.groupBy("n").agg((F.sum("v") / voxels).alias("__m")), "n", "left").select("n", F.coalesce("__m", F.lit(0.0)).alias("__m"))
        own = dense(own, sizes, frames).join(F.broadcast(mean), "n").select("n", *axes, (F.col("v") - F.col("__m")).alias("v"))  # a row a frame
    cut = {a: (cutin or {}).get(a, 0) for a in axes}
    if any(cut.values()):
        inner = own.where(F.col("n").isin(sorted({b for _, b in pairs})))
        for a in axes:
            inner = inner.where(F.col(a).between(cut[a], sizes[a] - 1 - cut[a]))
        own = own.unionByName(inner.withColumn("n", F.col("n") + INNER))
        pairs = [(a, b + INNER) for a, b in pairs]
    length = {a: 2 * n - 1 for a, n in sizes.items()}
    # Real lines have half a spectrum, which the last axis keeps to its end.
    half = length[axes[-1]] // 2 + 1
    extent = dict(sizes)
    x = own.select("n", *axes, F.col("v").alias("re"), F.lit(0.0).alias("im"))
    first, *rest = axes
    for a in reversed(rest):
        step = (lambda z, n=length[a]: np.fft.rfft(z.real, n)) if a == axes[-1] else (lambda z, n=length[a]: np.fft.fft(z, n))
        x = _along(x, ["n"], {o: extent[o] for o in axes if o != a}, a, sizes[a], step)
        extent[a] = half if a == axes[-1] else length[a]
    x = _multiplied(x, {o: extent[o] for o in rest}, first, length[first], pairs)
    extent[first] = length[first]
    for a in rest:
        step = (lambda z, n=length[a]: np.fft.irfft(z, n) + 0j) if a == axes[-1] else (lambda z: np.fft.ifft(z))
        x = _along(x, ["f1", "f2"], {o: extent[o] for o in axes if o != a}, a, extent[a], step)
        extent[a] = length[a]
    for a, n in sizes.items():
        offset = F.when(F.col(a) < n, F.col(a)).otherwise(F.col(a) - length[a])
        x = x.withColumn(a, offset).where(F.col(a).between(cut[a] + 1 - n, n - 1 - cut[a]))
    return x.select("f1", (F.col("f2") % INNER).cast("int").alias("f2"), *[F.col(a).alias(f"t_{a}") for a in axes], F.col("re").alias("product"))


def offsets_of_pairs(products: DataFrame, axes: list[str]) -> DataFrame:
    """f1, f2, t_<axis>, product: each pair's offset with the largest product, the first in order among equals."""
    names = [f"t_{a}" for a in axes]
    best = products.groupBy("f1", "f2").agg(F.min(F.struct((-F.col("product")).alias("p"), *names)).alias("b"))
    return best.select("f1", "f2", *[f"b.{n}" for n in names], (-F.col("b.p")).alias("product"))


def less_axis_means(stack: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Every voxel less the mean of its line along each axis, one axis after the other; absent voxels are zeros first."""
    x = dense(stack, sizes)
    for a in sizes:
        keys = ["n", *[o for o in sizes if o != a]]
        x = x.join(x.groupBy(*keys).agg(F.avg("v").alias("__m")), keys).select("n", *sizes, (F.col("v") - F.col("__m")).alias("v"))
    return x


def frame_translations(stack: DataFrame, frames: list[int], sizes: dict[str, int], submean: bool = True, cutin: dict[str, int] | None = None) -> DataFrame:
    """n, axis, t: one translation per frame from the best offsets of all pairs of frames, each pair looked at once.

    The offset of a pair is taken with its sign turned for the pair the other way round; a frame's translation is the
    mean over frames of these, less each column's own mean.
    """
    from lumenplex.operators.registration import centred

    axes = list(sizes)
    x = less_axis_means(stack, sizes) if submean else stack
    pairs = [(a, b) for i, a in enumerate(frames) for b in frames[i + 1 :]]
    best = offsets_of_pairs(products_of_frames(x, sizes, pairs, cutin, demean=False), axes)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(f"t_{a}").cast("double").alias("d")) for k, a in enumerate(axes)]))
    there = best.select("f1", "f2", each.alias("x")).select("f1", "f2", "x.axis", (-F.col("x.d")).alias("d"))
    back = there.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "axis", (-F.col("d")).alias("d"))
    own = stack.sparkSession.createDataFrame([(f, f, k, 0.0) for f in frames for k in range(len(axes))], "f1 int, f2 int, axis int, d double")
    return centred(there.unionByName(back).unionByName(own))
