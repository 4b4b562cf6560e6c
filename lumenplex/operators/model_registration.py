"""Frames registered by how well codes explain their stack: stochastic-free gradient descent over tiles.

Loss: 1 - sum over voxels of max_j <code_j, x>^2 / sum of x^2, with x the frames moved by their translations (hermite
interpolation along each axis). Tiles are dealt by rows; a pass sends the translations, a number per frame and axis,
to the tasks and gets back sums of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenplex.operators.density import codebook_matrix


def _weights(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the four neighbours -1, 0, 1, 2 for a fraction p, and their derivatives."""
    w = np.stack([-0.5 * p + p**2 - 0.5 * p**3, 1 - 2.5 * p**2 + 1.5 * p**3, 0.5 * p + 2 * p**2 - 1.5 * p**3, -0.5 * p**2 + 0.5 * p**3])
    d = np.stack([-0.5 + 2 * p - 1.5 * p**2, -5 * p + 4.5 * p**2, 0.5 + 4 * p - 4.5 * p**2, -p + 1.5 * p**2])
    return w, d


def _moved(block: np.ndarray, t: np.ndarray, halo: int | tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Frames (n, *axes) with a halo, moved by t (n, axes) and cropped to the inside, and the derivatives by each t.

    An axis without a halo isn't moved.
    """
    dims = block.ndim - 1
    halos = (halo,) * dims if isinstance(halo, int) else tuple(halo)
    shift = np.floor(t).astype(int)
    w, d = _weights(t - shift)

    def along(x: np.ndarray, axis: int, first: int, weights: np.ndarray) -> np.ndarray:
        n = x.shape[axis] - 2 * halos[axis]
        at = (slice(None),) * axis
        return sum(weights[i] * x[(*at, slice(halos[axis] + first + i - 1, halos[axis] + first + i - 1 + n))] for i in range(4))

    out = np.zeros((len(block), *[n - 2 * h for n, h in zip(block.shape[1:], halos)]))
    slopes = [np.zeros_like(out) for _ in range(dims)]
    moving = [k for k in range(dims) if halos[k]]
    for f, x in enumerate(block):
        for which, to in [(None, out), *[(k, slopes[k]) for k in moving]]:
            y = x
            for k in moving:
                y = along(y, k, shift[f, k], (d if k == which else w)[:, f, k])
            to[f] = y
    return out, slopes


def blocks(dealt: DataFrame, n_frames: int, axes: tuple[str, ...] = ("m0", "m1")) -> DataFrame:
    """tile, shape and data (frames x look box) from dealt rows: one shuffle by tile, rows as plain columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = [int(pdf[f"look_start_{a}"].iloc[0]) for a in axes]
        block = np.zeros((n_frames, *[int(pdf[f"look_stop_{a}"].iloc[0]) - lo for a, lo in zip(axes, low)]))
        block[(pdf["n"].to_numpy(), *[pdf[a].to_numpy() - lo for a, lo in zip(axes, low)])] = pdf["v"].to_numpy(float)
        return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "shape": [list(block.shape)], "data": [block.ravel()]})

    bounds = [f"look_{end}_{a}" for a in axes for end in ("start", "stop")]
    return dealt.select("tile", *bounds, "n", *axes, "v").groupBy("tile").applyInPandas(run, "tile string, shape array<int>, data array<double>")


def register(tiles: DataFrame, codes: DataFrame, halo: int | tuple[int, ...], iterations: int = 50, momentum: float = 0.8, first: float = 0.1) -> tuple[np.ndarray, list[float]]:
    """The best translations (frames x axes, mean 0 over frames) found, and the losses. tiles: blocks(), written or cached.

    halo: of all axes, or by axis; along an axis without one frames stay where they are. Steps are `first` over the
    largest first slope. Translations stay within halo - 2.
    """
    _, book = codebook_matrix(codes)
    unit = book / np.maximum(np.linalg.norm(book, axis=0), 1e-12)
    n = len(book)
    one = tiles.select(F.size("shape").alias("n")).first()
    dims = one["n"] - 1 if one else 1 if isinstance(halo, int) else len(halo)
    limit = np.maximum(np.array([halo] * dims if isinstance(halo, int) else halo) - 2, 0)

    def measured(t: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(2 + 2 * dims * n)
            for pdf in batches:
                for shape, data in zip(pdf["shape"], pdf["data"]):
                    x, slopes = _moved(np.asarray(data, float).reshape(shape), t, halo)
                    fit = np.tensordot(unit.T, x, 1)
                    best = fit.argmax(0)
                    top = np.take_along_axis(fit, best[None], 0)[0]
                    code = unit[:, best]
                    total[0] += (top**2).sum()
                    total[1] += (x**2).sum()
                    for k in range(dims):
                        total[2 + k * n : 2 + (k + 1) * n] += (2 * top * code * slopes[k]).reshape(n, -1).sum(1)
                        total[2 + (dims + k) * n : 2 + (dims + 1 + k) * n] += (2 * x * slopes[k]).reshape(n, -1).sum(1)
            yield pd.DataFrame({"x": [total]})

        each = tiles.mapInPandas(run, "x array<double>").select(F.posexplode("x").alias("i", "v"))
        got = {r["i"]: r["v"] for r in each.groupBy("i").agg(F.sum("v").alias("v")).collect()}  # 2 + 2 N numbers an axis
        s = np.array([got.get(i, 0.0) for i in range(2 + 2 * dims * n)])
        num, den, dnum, dden = s[0], max(s[1], 1e-12), s[2 : 2 + dims * n].reshape(dims, n).T, s[2 + dims * n :].reshape(dims, n).T
        return 1 - num / den, -(dnum - num / den * dden) / den

    t, speed, losses, best, rate = np.zeros((n, dims)), np.zeros((n, dims)), [], (np.inf, None), None
    for _ in range(iterations):
        loss, slope = measured(t)
        losses.append(loss)
        if loss < best[0]:
            best = (loss, t.copy())
        rate = rate or first / max(np.abs(slope).max(), 1e-12)
        speed = momentum * speed - rate * slope
        t = np.clip(t + speed, -limit, limit)
    return best[1] - best[1].mean(0), losses
