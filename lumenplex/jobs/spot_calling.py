"""Whole jobs: from a stack and a codebook to spots, and their accuracy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenplex.operators import blurred_model, density, evidence, grids, pointclouds, tiling
from lumenplex.operators.lineage import cut


def singleshot(stack: DataFrame, codes: DataFrame, sizes: dict[str, int], n_frames: int, sigmas: dict[str, float], threshold: float, floor: float | None = None, radius: int = 1) -> DataFrame:
    """Spots: normalise, subtract background, normalise, evidence of each code, local peaks of it."""
    axes = list(sizes)
    x = grids.preprocessed(stack, sizes, sigmas, ["n"])
    e = evidence.evidence(evidence.to_voxels(x, n_frames, axes), codes, floor, above=threshold)
    return grids.peaks(e, dict.fromkeys(axes, radius), threshold, value="e").select("j", *axes, "e")


def iterative(stack: DataFrame, codes: DataFrame, sizes: dict[str, int], n_frames: int, iterations: int, share: float = 0.1, radius: int = 1) -> DataFrame:
    """Spots: local peaks of the iterative densities above a share of the largest one."""
    axes = list(sizes)
    found = density.fit(evidence.to_voxels(stack, n_frames, axes), codes, iterations).density()
    high = evidence.above_share_of_top(found, share, "v")
    return grids.peaks(high, dict.fromkeys(axes, radius), 0.0).select("j", *axes, "v")


def kept_codes(coarse: DataFrame, decoys: DataFrame, tiled: DataFrame, factors: dict[str, int], voxels: int, by_voxel: float = 100.0, by_code: float = 100.0, multiplier: float = 1.0) -> DataFrame:
    """tile, j: the decoys in every tile, and the codes whose coarse density exceeds the decoys' somewhere where it looks.

    The level is the percentile over decoys of the percentile over voxels (zeros included) of their densities, times
    the multiplier.
    """
    names = decoys.select("j").distinct()
    own = coarse.join(names, "j", "left_semi")
    zeros = own.groupBy("j").agg((F.lit(voxels) - F.count("*")).alias("n"))
    zeros = names.join(zeros, "j", "left").select("j", F.lit(0.0).alias("v"), F.coalesce("n", F.lit(voxels)).alias("n")).where("n > 0")
    own = own.select("j", "v", F.lit(1).cast("long").alias("n")).unionByName(zeros)
    top = F.max("v") if by_voxel == 100 else F.percentile("v", by_voxel / 100, F.col("n"))
    level = own.groupBy("j").agg(top.alias("v")).agg(F.percentile("v", by_code / 100)).first()[0] or 0.0
    real = coarse.join(names, "j", "left_anti").where(F.col("v") > level * multiplier)
    found = tiling.deal(real, tiling.downsampled(tiled, factors), list(factors)).select("tile", "j").distinct()
    return found.unionByName(tiled.select("tile").crossJoin(F.broadcast(names)))  # a few decoys


def two_phase(
    stack: DataFrame,
    codes: DataFrame,
    decoys: DataFrame,
    sizes: dict[str, int],
    rounds: int,
    coarse: dict[str, int],
    tile: dict[str, int],
    sigmas: dict[str, int] | None = None,
    penalties: tuple[float, float] = (0.01, 0.01),
    iterations: tuple[tuple[int, int], tuple[int, int]] = ((10, 200), (10, 200)),
    learn: tuple[str, ...] = (),
    **percentiles: float,
) -> DataFrame:
    """axes, j, v: densities above zero, from a coarse fit of all codes and a fine one, tile by tile, of those with promise.

    Decoys are codes with names of their own that nothing shows; they are fitted along. Per phase, iterations are of
    densities alone and then of all parameters; the fine ones learn densities, voxels' backgrounds and what `learn` names
    (gains, mixing, b). A tile of the second phase carries its own list of codes, and its halo of three blurs and one.
    """
    axes = list(sizes)
    sigmas = {a: (sigmas or {}).get(a, 0) for a in axes}
    factors = {a: coarse.get(a, 1) for a in axes}
    every = codes.select("n", "j", "c").unionByName(decoys.select("n", "j", "c"))
    small = grids.block_mean(stack, coarse, sizes)
    m = blurred_model.model(small, every, {a: -(-sizes[a] // factors[a]) for a in axes}, rounds, {a: s // factors[a] for a, s in sigmas.items()}, penalties[0])
    (first, rest), fine = iterations
    for what in ["F"] * first + ["gains", "mixing", "a", "b", "F"] * rest:
        m.update(what)
    tiled = cut(tiling.tiles(stack.sparkSession, sizes, tile, {a: 3 * s + 1 for a, s in sigmas.items()}))
    voxels = 1
    for n in m.frame.sizes:
        voxels *= n
    kept = cut(kept_codes(m.density(), decoys, tiled, factors, voxels, **percentiles))
    names, book = m.names, m.book
    plan = ["F"] * fine[0] + [*learn, "a", "F"] * fine[1]

    def fit(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        columns = [*axes, "j", "v"]
        if rows.empty or own.empty:
            return pd.DataFrame({c: [] for c in columns})
        place = {b: int(rows[b].iloc[0]) for b in rows.columns if b.startswith(("look_", "put_"))}
        held = np.sort(own["j"].to_numpy())
        which = [names.index(j) for j in held]
        start = np.array([place[f"look_start_{a}"] for a in axes])
        x = np.zeros((*[place[f"look_stop_{a}"] - place[f"look_start_{a}"] for a in axes], book.shape[0] * book.shape[1]))
        np.add.at(x, (*[rows[a].to_numpy() - s for a, s in zip(axes, start)], rows["n"].to_numpy()), rows["v"].to_numpy(float))
        f = blurred_model.fit_block(x, book[:, :, which], [sigmas[a] for a in axes], penalties[1], plan)
        put = tuple(slice(place[f"put_start_{a}"] - s, place[f"put_stop_{a}"] - s) for a, s in zip(axes, start))
        at = np.nonzero(f[put] > 0)
        out = {a: p + place[f"put_start_{a}"] for a, p in zip(axes, at)}
        return pd.DataFrame(out | {"j": held[at[-1]], "v": f[put][at]})[columns]

    inside = stack.where(" and ".join(f"{a} between 0 and {n - 1}" for a, n in sizes.items()) + " and v is not null")
    dealt = tiling.deal(inside.select("n", *axes, "v"), tiled, axes)
    schema = ", ".join(f"{a} int" for a in axes) + ", j int, v double"
    return dealt.groupBy("tile").cogroup(kept.groupBy("tile")).applyInPandas(fit, schema)


def accuracy(rolonies: DataFrame, found: DataFrame, radius: float, axes: list[str]) -> DataFrame:
    """One row: fn, fp, agreement and rates against annotated spots."""
    parts = pointclouds.match_rolonies(rolonies, found, radius, axes)
    one = None
    for name, df in parts.items():
        n = df.agg(F.count("*").alias(name))
        one = n if one is None else one.crossJoin(n)  # single rows
    good = rolonies.where(F.coalesce(F.col("status"), F.lit("good")) == "good").agg(F.count("*").alias("n_good"))
    return one.crossJoin(good).select("*", (1 - F.col("fn") / F.col("n_good")).alias("detection_rate"), (F.col("fp") / F.greatest(F.col("fp") + F.col("agreement"), F.lit(1))).alias("false_discovery_rate"))
