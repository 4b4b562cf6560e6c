"""Alpha shapes: tetrahedra of a point cloud whose empty circumsphere is smaller than a radius, and their surface.

A tetrahedron belongs to the Delaunay triangulation exactly if no point lies within its circumsphere. Those that a point
has with a radius below r are decided by the points within 2r of it, so space is cut into blocks, each block gets the
points within 2r of it, and a tetrahedron is kept by the block of its first point. There each point's cell - the places
nearer to it than to others - is cut out of a cube by the planes halfway to its neighbours, from near to far, until no
farther one reaches it; its corners are the centres of the point's tetrahedra. Many cells are cut side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenplex.operators.geometry import boundary_faces

AXES = ("x", "y", "z")

#: Neighbours of a cell found at first; further ones at a time; points of a leaf, and around it; cells side by side.
NEAR, MORE, LEAF, AROUND, CELLS = 96, 48, 128, 1500, 4096


def _square(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(-1)


def _far(lane: np.ndarray, v: np.ndarray, radius: float, n: int) -> np.ndarray:
    """Squared distance up to which neighbours can change the corners of each cell that are nearer than the radius."""
    most = np.zeros(n)
    np.maximum.at(most, lane, np.nan_to_num(_square(v), nan=np.inf))
    return 4 * np.minimum(most, radius**2) * (1 + 1e-9)


def _corners(every: np.ndarray, n: int, centre: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where the planes halfway to three points meet, from the centre. Points from n on are offsets already."""
    a, b, c = (every[ids[:, k]] - every[centre] * (ids[:, k] < n)[:, None] for k in range(3))
    bc, ca, ab = np.cross(b, c), np.cross(c, a), np.cross(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (_square(a)[:, None] * bc + _square(b)[:, None] * ca + _square(c)[:, None] * ab) / (2 * (a * bc).sum(1))[:, None]


def _cut(every: np.ndarray, n: int, centre: np.ndarray, cells: tuple, near: np.ndarray, radius: float) -> tuple:
    """Cells (lane, the corners' three planes, the corners) cut by the lists of neighbours near, -1 at their ends, nearest first."""
    lane, ids, v = cells
    done = []
    for k in range(near.shape[1]):
        there = near[:, k] >= 0
        q = every[near[:, k]] - every[centre]
        half = np.where(there, _square(q) / 2, np.inf)
        if k % 8 == 0:
            open_ = (2 * half <= _far(lane, v, radius, len(centre)))[lane]
            done.append((lane[~open_], ids[~open_], v[~open_]))
            lane, ids, v = lane[open_], ids[open_], v[open_]
            if not len(lane):
                break
        cut = (v * q[lane]).sum(1) > half[lane]
        if not cut.any():
            continue
        # Edges that only one of the corners cut off has are the rim of what is cut off: each gives a corner in the new plane.
        own, lost = lane[cut], ids[cut]
        pair = np.sort(np.concatenate((lost[:, [0, 1]], lost[:, [1, 2]], lost[:, [0, 2]])), axis=1)
        own = np.concatenate((own, own, own))
        order = np.argsort((own * (n + 6) + pair[:, 0]) * (n + 6) + pair[:, 1])
        own, pair = own[order], pair[order]
        same = (own[1:] == own[:-1]) & (pair[1:] == pair[:-1]).all(1)
        rim = ~(np.r_[False, same] | np.r_[same, False])
        own, new = own[rim], np.c_[pair[rim], near[own[rim], k]]
        lane, ids = np.concatenate((lane[~cut], own)), np.concatenate((ids[~cut], new))
        v = np.concatenate((v[~cut], _corners(every, n, centre[own], new)))
    return tuple(map(np.concatenate, zip(*done, (lane, ids, v))))


def _leaves(points: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Numbers of own points, in groups of LEAF at most, halved along the widest axis."""
    out, open_ = [], [own] if len(own) else []
    while open_:
        at = open_.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        axis = np.ptp(points[at], axis=0).argmax()
        at = at[np.argsort(points[at, axis], kind="stable")]
        open_ += [at[: len(at) // 2], at[len(at) // 2 :]]
    return out


def _nearest(points: np.ndarray, leaf: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Up to NEAR neighbours within reach of each point of a leaf, nearest first, -1 at the end; the squared distance up to which they are all."""
    low, high = points[leaf].min(0), points[leaf].max(0)
    off = _square(np.maximum(np.maximum(low - points, points - high), 0))
    k = min(len(leaf) + AROUND, len(points) - 1)
    h = min(np.partition(off, k)[k], reach**2)
    near = np.flatnonzero(off <= h)
    d = _square(points[near] - points[leaf][:, None])
    d[d > h] = np.inf
    d[leaf[:, None] == near] = np.inf
    first = np.argpartition(d, NEAR - 1, axis=1)[:, :NEAR] if d.shape[1] > NEAR else np.broadcast_to(np.arange(d.shape[1]), d.shape)
    own = np.take_along_axis(d, first, 1)
    order = np.argsort(own, axis=1)
    own, first = np.take_along_axis(own, order, 1), near[np.take_along_axis(first, order, 1)]
    whole = np.minimum(own[:, -1], h) if d.shape[1] > NEAR else np.full(len(leaf), h)
    out = np.full((len(leaf), NEAR), -1)
    out[:, : own.shape[1]] = np.where(np.isfinite(own), first, -1)
    return out, whole


def _farther(points: np.ndarray, centre: int, planes: np.ndarray, v: np.ndarray, beyond: float, far: float) -> tuple[np.ndarray, float]:
    """The nearest MORE neighbours from a squared distance up to far that cut a cell with the corners v; and up to where they are all."""
    q = points - points[centre]
    d = _square(q)
    at = np.flatnonzero((d >= beyond) & (d <= far))
    at = at[~np.isin(at, planes)]  # neighbours at the very distance may be missing, others are there already
    at = at[(q[at] @ v.T > d[at, None] / 2).any(1)]
    at = at[np.argsort(d[at])]
    return at[:MORE], d[at[MORE - 1]] if len(at) > MORE else np.inf


def tetrahedra(points: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Delaunay tetrahedra (numbers, ascending) with a circumradius below the radius whose first point is an own one, and their radii.

    points: in general position, all within twice the radius of the own ones, given by number.
    """
    n = len(points)
    every = np.concatenate((points, np.concatenate((np.eye(3), -np.eye(3))) * 2.02 * radius))  # the cube's planes
    cube = n + np.array([(x, y, z) for x in (0, 3) for y in (1, 4) for z in (2, 5)])
    found = [(np.empty((0, 4), int), np.empty(0))]
    leaves, at = _leaves(points, own), 0
    while at < len(leaves):
        some, size = [], 0
        while at < len(leaves) and size < CELLS:
            some.append(leaves[at])
            size, at = size + len(leaves[at]), at + 1
        centre = np.concatenate(some)
        lists = [_nearest(points, leaf, 2 * radius) for leaf in some]
        near, whole = (np.concatenate(x) for x in zip(*lists))
        lane, ids = np.repeat(np.arange(size), 8), np.tile(cube, (size, 1))
        cells = lane, ids, _corners(every, n, centre[lane], ids)
        while True:
            lane, ids, v = cells = _cut(every, n, centre, cells, near, radius)
            far = _far(lane, v, radius, size)
            left = np.flatnonzero((whole < far) & (whole < 4 * radius**2))
            if not len(left):
                break
            order = np.argsort(lane, kind="stable")
            lane, ids, v = cells = lane[order], ids[order], v[order]
            first = np.searchsorted(lane, np.arange(size + 1))
            near = np.full((size, MORE), -1)
            for k in left:
                more, whole[k] = _farther(points, centre[k], ids[first[k] : first[k + 1]], v[first[k] : first[k + 1]], whole[k], far[k])
                near[k, : len(more)] = more
        small = (ids < n).all(1) & (_square(v) < radius**2) & (centre[lane] < ids.min(1))
        found.append((np.c_[centre[lane[small]], np.sort(ids[small], axis=1)], np.sqrt(_square(v[small]))))
    return tuple(map(np.concatenate, zip(*found)))


def small_simplices(points: DataFrame, radius: float, width: float | None = None, jitter: float = 1e-10) -> DataFrame:
    """shape, p0..p3 (ascending pid) and circumradius of tetrahedra with an empty circumsphere smaller than the radius.

    points: shape, pid, x, y, z; of equal points the least pid counts. They are moved by `jitter` of the cloud's width at
    most, each by its own coordinates, so that no five lie on one sphere. width: of blocks, twice the radius at least;
    a task holds the points of one block and twice the radius around it, and its time grows about as they do.
    """
    width = max(width or 0.0, 2 * radius)
    once = points.groupBy("shape", *[F.col(x).cast("double").alias(x) for x in AXES]).agg(F.min("pid").alias("pid"))
    span = once.groupBy("shape").agg(F.greatest(*[F.max(x) - F.min(x) for x in AXES]).alias("__span"))
    moved = once.join(span, "shape")
    unit = lambda k: F.pmod(F.xxhash64(*AXES, F.lit(k)), F.lit(1 << 40)) / F.lit(float(1 << 40)) - 0.5
    moved = moved.select("shape", "pid", *[(F.col(x) + unit(k) * F.col("__span") * jitter).alias(x) for k, x in enumerate(AXES)])
    for x in AXES:
        near = F.sequence(F.floor((F.col(x) - 2 * radius) / width), F.floor((F.col(x) + 2 * radius) / width))
        moved = moved.withColumn(f"__b{x}", F.explode(near))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        p, block = pdf[list(AXES)].to_numpy(float), np.array([pdf[f"__b{x}"].iloc[0] for x in AXES])
        found, size = tetrahedra(p, np.flatnonzero((np.floor(p / width) == block).all(1)), radius)
        ids = pdf["pid"].to_numpy()[found]
        return pd.DataFrame({"shape": pdf["shape"].iloc[0]} | {f"p{k}": ids[:, k] for k in range(4)} | {"radius": size})

    kind = points.schema["shape"].dataType.simpleString()
    keys = ["shape", *[f"__b{x}" for x in AXES]]
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # so that Spark doesn't merge them: few bytes are much work
    return moved.repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, f"shape {kind}, p0 long, p1 long, p2 long, p3 long, radius double")


def alpha_surface(points: DataFrame, radius: float, width: float | None = None) -> DataFrame:
    """shape, a, b, c: faces that only one of the small tetrahedra has."""
    return boundary_faces(small_simplices(points, radius, width), ["shape"])
