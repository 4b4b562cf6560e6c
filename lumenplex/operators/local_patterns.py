"""Codes read off bright blobs: around each, the frames' common pattern is one rank of the patch."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenplex.operators.grids import peaks
from lumenplex.operators.tiled import blurred, kernel

#: Patches whose arrays are fitted together in a task.
TOGETHER = 256


def blobs(stack: DataFrame, axes: list[str], share: float, distance: int = 2, inside: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Local maxima of the largest frame per voxel, above a share of the largest value anywhere.

    inside: by axis a size and a radius; blobs nearer to the border than that are left out.
    """
    top = stack.groupBy(*axes).agg(F.max("v").alias("v"))
    least = share * (top.agg(F.max("v")).first()[0] or 0.0)
    found = peaks(top.withColumn("j", F.lit(0)), dict.fromkeys(axes, distance), least).select(*axes)
    for a, (size, radius) in (inside or {}).items():
        found = found.where(F.col(a).between(radius, size - radius - 1))
    return found


def patches(stack: DataFrame, centres: DataFrame, radius: dict[str, int]) -> DataFrame:
    """blob, n, voxel, v for the voxels within an ellipsoid of each centre; voxel is the place in the box around it.

    Centres spread to keys, then one equi-join.
    """
    axes = list(radius)
    box = list(product(*[range(-r, r + 1) for r in radius.values()]))
    inside = [(k, *s) for k, s in enumerate(box) if sum((x / r) ** 2 for x, r in zip(s, radius.values()) if r) <= 1]
    steps = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in inside]))
    spread = centres.select(F.concat_ws("/", *axes).alias("blob"), *axes, steps.alias("s"))
    keys = spread.select("blob", F.col("s")[0].alias("voxel"), *[(F.col(a) + F.col("s")[i + 1]).alias(a) for i, a in enumerate(axes)])
    return stack.join(keys, axes).select("blob", "n", "voxel", "v")


def rank_one(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames' loads (patches, frames) and shapes (patches, voxels) of the leading singular pair, at least 0."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    load, shape = u[:, :, 0] * s[:, :1], vt[:, 0]
    sign = np.where(load.sum(1) < 0, -1.0, 1.0)[:, None]
    return np.maximum(sign * load, 0), np.maximum(sign * shape, 0)


def blurry_rank_one(x: np.ndarray, box: tuple[int, ...], sigmas: list[int], steps: int = 5) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Loads, shapes and losses of patches (patches, frames, voxels of the box) as loads times blurred shapes.

    From the leading singular pair on, in turn one non-negative step of the shapes, of the best length for each patch,
    and the best non-negative loads.
    """

    def blur(f: np.ndarray) -> np.ndarray:
        f = f.reshape(-1, *box)
        for i, s in enumerate(sigmas):
            f = blurred(f, i + 1, kernel(s))
        return f.reshape(len(f), -1)

    def loss(g: np.ndarray, f: np.ndarray) -> np.ndarray:
        return ((x - g[:, :, None] * blur(f)[:, None]) ** 2).sum((1, 2))

    g, f = rank_one(x)
    losses = [loss(g, f)]
    for _ in range(steps):
        size = (g**2).sum(1, keepdims=True)
        down = blur(np.einsum("bn,bnm->bm", g, x)) - size * blur(blur(f))
        down[(f <= 0) & (down <= 0)] = 0
        curve = (size * blur(down) ** 2).sum(1)
        rate = np.where(curve > 1e-12, (down**2).sum(1) / np.maximum(curve, 1e-12), 0)
        open_ = rate > 0
        for _ in range(10):
            trial = np.maximum(f + rate[:, None] * down, 0)
            better = open_ & (loss(g, trial) < losses[-1])
            f = np.where(better[:, None], trial, f)
            open_ &= ~better
            rate = rate * 0.9
        losses.append(loss(g, f))
        seen = blur(f)
        own = (seen**2).sum(1)[:, None]
        g = np.where(own > 1e-12, np.maximum(np.einsum("bm,bnm->bn", seen, x) / np.maximum(own, 1e-12), 0), g)
        losses.append(loss(g, f))
    return g, f, losses


def _fitted(x: np.ndarray, box: tuple[int, ...], sigmas: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    return rank_one(x) if sigmas is None else blurry_rank_one(x, box, sigmas)[:2]


def codes_of(x: np.ndarray, box: tuple[int, ...], rounds: int, stand_out: float = 2.0, good_rounds: float = 0.8, cosine: float = 0.8, sigmas: list[int] | None = None, whole: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Status, code (patches, rounds; -1 unknown) and agreement (NaN where rounds are missing) of patches (patches, frames, voxels)."""
    b, n, _ = x.shape
    load = _fitted(x, box, sigmas)[0].reshape(b, rounds, n // rounds)
    ok = load.max(2) > stand_out * load.mean(2)
    code = np.where(ok, load.argmax(2), -1)
    enough = ok.sum(1) >= int(rounds * good_rounds)
    lit = (np.arange(n // rounds) == code[:, :, None]).reshape(b, n)
    kept = x * lit[:, :, None]
    load, shape = _fitted(kept, box, sigmas)
    against = ((x if whole else kept) ** 2).sum((1, 2))
    size = np.sqrt((load**2).sum(1) * (shape**2).sum(1) * against)
    met = np.einsum("bnm,bn,bm->b", kept, load, shape) / np.maximum(size, 1e-300)
    agreement = np.where(enough, met, np.nan)
    status = np.where(~enough, "badrounds", np.where(met >= cosine, "success", "badr2"))
    return status.tolist(), code, agreement


def read_codes(patched: DataFrame, radius: dict[str, int], rounds: int, channels: int, stand_out: float = 2.0, good_rounds: float = 0.8, cosine: float = 0.8, blur: dict[str, int] | None = None, whole: bool = True) -> DataFrame:
    """blob, status, code (channels by round, -1 unknown) and r2 of every patch.

    A rank-one fit gives each frame's load (with `blur`, one of blurred shapes); a round's channel must exceed
    stand_out times the round's mean, and the integer part of good_rounds * rounds rounds must. A second fit of the lit
    frames alone must agree with the patch (`whole`), or with these frames.
    """
    n, box = rounds * channels, tuple(2 * r + 1 for r in radius.values())
    voxels = int(np.prod(box))
    sigmas = None if blur is None else [blur.get(a, 0) for a in radius]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        which, names = pdf["blob"].factorize(sort=True)
        parts = []
        for k in range(0, len(names), TOGETHER):
            own = (which >= k) & (which < k + TOGETHER)
            x = np.zeros((min(TOGETHER, len(names) - k), n, voxels))
            x[which[own] - k, pdf["n"].to_numpy()[own], pdf["voxel"].to_numpy()[own]] = pdf["v"].to_numpy(float)[own]
            status, code, r2 = codes_of(x, box, rounds, stand_out, good_rounds, cosine, sigmas, whole)
            text = [",".join(map(str, c)) for c in code.tolist()]
            parts.append(pd.DataFrame({"blob": names[k : k + TOGETHER], "status": status, "code": text, "r2": [None if np.isnan(v) else v for v in r2.tolist()]}))
        return pd.concat(parts)

    # Patches come to tasks as plain columns; a group holds many.
    groups = int(patched.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8
    spread = F.pmod(F.xxhash64("blob"), F.lit(groups))
    return patched.groupBy(spread.alias("g")).applyInPandas(run, "blob string, status string, code string, r2 double")
