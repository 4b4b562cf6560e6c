"""Iterative densities: voxels as a non-negative mix of codes, with per-voxel and per-frame backgrounds and gains.

Model: obs[n] ~ gain[n] * sum_j F[j] * code[n, j] + a + b[n]. The VOXEL layout holds all that a voxel's step needs
in one row, so every pass is one map over the voxels and one sum of a few numbers per frame: nothing is shuffled.
The codebook and the frames' parameters are small arrays, checked when the fit starts, and travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenplex.operators.codebooks import MAX_ENTRIES, packed
from lumenplex.operators.grids import gaussian
from lumenplex.operators.lineage import cut
from lumenplex.operators.pointclouds import dilate


@dataclass
class Fit:
    """Voxels with their densities, the frames' gains and backgrounds, and the loss before each pass and at the end."""

    voxels: DataFrame
    names: list
    codes: np.ndarray
    gains: np.ndarray
    offsets: np.ndarray
    losses: list[float] = field(default_factory=list)

    def density(self) -> DataFrame:
        """keys, j, v: densities scaled by their code's total load; zeros left out."""
        keys = [c for c in self.voxels.columns if c not in ("obs", "f", "a")]
        load = (self.gains[:, None] * self.codes).sum(0).tolist()
        each = F.transform("f", lambda x, i: F.struct(F.get(F.array(*[F.lit(n) for n in self.names]), i).alias("j"), (x * F.get(F.array(*map(F.lit, load)), i)).alias("v")))
        return self.voxels.select(*keys, F.explode(F.filter(each, lambda x: x["v"] > 0)).alias("x")).select(*keys, "x.j", "x.v")


def codebook_matrix(codes: DataFrame) -> tuple[list, np.ndarray]:
    """Names j and the N x J matrix of a codebook of checked size; unknown entries are 0."""
    if codes.limit(MAX_ENTRIES + 1).count() > MAX_ENTRIES:
        raise ValueError(f"a codebook of more than {MAX_ENTRIES} entries")
    rows = packed(codes).orderBy("j").collect()
    return [r["j"] for r in rows], np.array([[0.0 if x is None else x for x in r["code"]] for r in rows]).T


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(pdf["obs"].to_numpy()).astype(float), np.stack(pdf["f"].to_numpy()).astype(float), pdf["a"].to_numpy()


def _step(x: np.ndarray, f: np.ndarray, a: np.ndarray, g: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    """One projected gradient step per voxel with an exact line search, never accepted if it isn't better."""
    down = (x - a[:, None] - b) @ g - penalty * g.sum(0) - f @ (g.T @ g)
    down[(f <= 0) & (down <= 0)] = 0
    along = down @ g.T
    curve = (along**2).sum(1)
    size = np.where(curve > 1e-12, (down**2).sum(1) / np.maximum(curve, 1e-12), 0)

    def loss(y: np.ndarray) -> np.ndarray:
        left = x - a[:, None] - b - y @ g.T
        return 0.5 * (left**2).sum(1) + penalty * (y @ g.sum(0))

    was, best, open_rows = loss(f), f.copy(), size > 0
    for _ in range(10):
        trial = np.maximum(f + size[:, None] * down, 0)
        better = open_rows & (loss(trial) < was)
        best[better] = trial[better]
        open_rows &= ~better
        if not open_rows.any():
            break
        size = size * 0.9
    return best


def fit(voxels: DataFrame, codes: DataFrame, iterations: int = 10, penalty: float = 0.0, gains: bool = True) -> Fit:
    """Per iteration densities, then gains, then voxels' and then frames' backgrounds. voxels: keys and obs.

    An iteration writes the densities once and reads them for two rounds of sums: of the gains, and of the frames'
    backgrounds with the loss. A voxel's background follows from its densities and the parameters before it.
    """
    names, book = codebook_matrix(codes)
    n, j = book.shape
    start = voxels.select(*[c for c in voxels.columns if c != "j"], F.array_repeat(F.lit(0.0), j).alias("f"), F.lit(0.0).alias("a"))
    schema: StructType = start.schema
    out = Fit(start, names, book, np.ones(n), np.zeros(n))

    def summed(df: DataFrame, of, width: int) -> np.ndarray:
        """Sums over all voxels of what `of` makes of a batch's arrays: `width` numbers."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(width)
            for pdf in batches:
                if len(pdf):
                    total += of(*_arrays(pdf))
            yield pd.DataFrame({"x": [total]})

        each = df.select("obs", "f", "a").mapInPandas(run, "x array<double>").select(F.posexplode("x").alias("i", "v"))
        got = {r["i"]: r["v"] for r in each.groupBy("i").agg(F.sum("v").alias("v")).collect()}  # `width` numbers
        return np.array([got.get(i, 0.0) for i in range(width)])

    def loss(g: np.ndarray, b: np.ndarray):
        return lambda x, f, a: np.array([0.5 * ((x - a[:, None] - b - f @ g.T) ** 2).sum() + penalty * (f @ g.sum(0)).sum()])

    for _ in range(iterations):
        g, b = out.gains[:, None] * out.codes, out.offsets.copy()

        def step(batches: Iterator[pd.DataFrame], g=g, b=b) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(f=list(_step(*_arrays(pdf), g, b, penalty)))

        out.voxels = cut(out.voxels.mapInPandas(step, schema))
        code = out.codes

        def gain_sums(x, f, a, code=code, g=g, b=b):
            load, left = f @ code.T, x - a[:, None] - b
            return np.concatenate(((load * (left - penalty)).sum(0), (load**2).sum(0), loss(g, b)(x, f, a)))

        s = summed(out.voxels, gain_sums, 2 * n + 1)
        out.losses.append(float(s[-1]))
        if gains:
            ok = s[n : 2 * n] > 1e-10
            out.gains = np.where(ok, np.maximum(s[:n] / np.where(ok, s[n : 2 * n], 1), 1e-10), out.gains)
        g = out.gains[:, None] * out.codes

        def background(batches: Iterator[pd.DataFrame], g=g, b=b) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x, f, _ = _arrays(pdf)
                    yield pdf.assign(a=np.maximum((x - b - f @ g.T).mean(1), 0))

        out.voxels = out.voxels.mapInPandas(background, schema)
        s = summed(out.voxels, lambda x, f, a, g=g: np.append((x - a[:, None] - f @ g.T).sum(0), len(x)), n + 1)
        out.offsets = np.maximum(s[:n] / max(s[n], 1), 0)
    out.losses.append(float(summed(out.voxels, loss(out.gains[:, None] * out.codes, out.offsets), 1)[0]))
    return out


def reconstructed(density: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """LONG of what densities (keys, j, v) make the codes show: sums over j of v times the code's entry; zeros left out."""
    lit = codes.where(F.col("c") != 0).select("n", "j", "c")
    return density.join(lit, "j").groupBy("n", *keys).agg(F.sum(F.col("v") * F.col("c")).alias("v"))


def left_over(stack: DataFrame, explained: DataFrame, keys: list[str]) -> DataFrame:
    """LONG with v, explained and left = v - explained, for every row of either."""
    both = stack.select("n", *keys, "v").join(explained.select("n", *keys, F.col("v").alias("explained")), ["n", *keys], "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("n", *keys, zero("v").alias("v"), zero("explained").alias("explained"), (zero("v") - zero("explained")).alias("left"))


def gated_reconstruction(found: DataFrame, codes: DataFrame, decoys: DataFrame, sizes: dict[str, int], radii: dict[str, int], sigmas: dict[str, float] | None = None, multiplier: float = 1.0) -> DataFrame:
    """LONG of what densities explain where they beat the decoys.

    found: axes, j, v scaled by their code's total load, decoys along. A code counts within an ellipsoid of places where
    it exceeds the decoys' largest density times the multiplier; there its density, unscaled and blurred, is shown.
    """
    axes = list(sizes)
    level = found.join(decoys.select("j").distinct(), "j", "left_semi").agg((F.coalesce(F.max("v"), F.lit(0.0)) * multiplier).alias("__level"))
    spots = found.crossJoin(F.broadcast(level)).where(F.col("v") > F.col("__level"))  # one row
    grown = dilate(spots.select("j", *axes), radii, ["j"])
    load = codes.groupBy("j").agg(F.sum("c").alias("__load")).where("__load <> 0")
    plain = found.join(load, "j").select(F.col("j").alias("n"), *axes, (F.col("v") / F.col("__load")).alias("v"))
    seen = gaussian(plain, sizes, sigmas) if sigmas else plain
    return reconstructed(seen.withColumnRenamed("n", "j").join(grown, ["j", *axes], "left_semi"), codes, axes)
