"""Voxels of meshes and masks: what surfaces touch, and what they enclose.

Vertices: mesh, vid, x, y, z. Faces: mesh, fid, a, b, c. Voxels: mesh, i, j, k, in units of a pitch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = ("i", "j", "k")

#: Voxels that a task fills, or returns, together.
TOGETHER = 1 << 18


def face_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh, fid and the corners' coordinates a_x .. c_z of every face.

    The joins merge: either side may be made of arrays that Spark's estimate counts as one row, so it would be sent whole.
    """
    out = faces.select("mesh", "fid", "a", "b", "c")
    for corner in "abc":
        own = vertices.select("mesh", F.col("vid").alias(corner), *[F.col(x).cast("double").alias(f"{corner}_{x}") for x in "xyz"])
        out = out.join(own.hint("merge"), ["mesh", corner])
    return out.drop("a", "b", "c")


def divided(corners: DataFrame, longest: float) -> DataFrame:
    """mesh, x, y, z: the corners that faces have when they are cut in four until no edge is longer than `longest`.

    The parts of a face are all alike, so the number of cuts follows from its longest edge, and the corners are the
    points of a lattice over the face: i and j steps along two edges. Each face has at most as many as its lattice;
    equal points of different faces stay.
    """
    edge = lambda p, q: F.sqrt(sum(((F.col(f"{p}_{x}") - F.col(f"{q}_{x}")) ** 2 for x in "yz"), (F.col(f"{p}_x") - F.col(f"{q}_x")) ** 2))
    rows = corners.withColumn("__edge", F.greatest(edge("a", "b"), edge("b", "c"), edge("a", "c")))
    halves = F.greatest(F.ceil(F.log2(F.col("__edge") / longest)), F.lit(0))
    # The logarithm may be off by its rounding.
    fits = lambda n: F.col("__edge") <= longest * F.pow(F.lit(2.0), n)
    rows = rows.withColumn("__h", F.when(F.col("__edge") > 0, halves).otherwise(0))
    rows = rows.withColumn("__h", F.when(~fits(F.col("__h")), F.col("__h") + 1).when((F.col("__h") > 0) & fits(F.col("__h") - 1), F.col("__h") - 1).otherwise(F.col("__h")))
    rows = rows.withColumn("__n", F.pow(F.lit(2.0), F.col("__h")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("__n"))).alias("__i"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - F.col("__i"))).alias("__j"))
    at = [(F.col(f"a_{x}") + (F.col(f"b_{x}") - F.col(f"a_{x}")) * (F.col("__i") / F.col("__n")) + (F.col(f"c_{x}") - F.col(f"a_{x}")) * (F.col("__j") / F.col("__n"))).alias(x) for x in "xyz"]
    return rows.select("mesh", *at)


def boundary_voxels(vertices: DataFrame, faces: DataFrame, pitch: float, lows: tuple[float, ...] | None = None, highs: tuple[float, ...] | None = None) -> DataFrame:
    """mesh, i, j, k: distinct voxels that hold a corner of the faces cut down to half a pitch, coordinates cut off towards 0.

    With lows and highs, multiples of the pitch, voxels outside the box are left out and counted from its lower corner.
    """
    points = divided(face_corners(vertices, faces), pitch / 2)
    out = points.select("mesh", *[(F.col(x) / pitch).cast("int").alias(p) for x, p in zip("xyz", PLACES)]).distinct()
    if lows is not None:
        for p, lo, hi in zip(PLACES, lows, highs):
            first, last = int(np.floor(lo / pitch)), int(np.ceil(hi / pitch))
            out = out.where((F.col(p) >= first) & (F.col(p) < last)).withColumn(p, F.col(p) - first)
    return out


def enclosed(plane: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of open places that no path of open neighbours leads out of, in many planes at once.

    plane, x, y: voxels, sorted, each once. A run is a gap between two voxels of a row: it ends at voxel number `at` and
    goes from `start` to `stop`. A gap is out if a row beside its own is absent or doesn't span it, or if it touches one
    that is out.
    """
    if not len(x):
        return (np.empty(0, np.int64),) * 3
    fresh = np.r_[True, (plane[1:] != plane[:-1]) | (x[1:] != x[:-1])]
    first, row = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    last = np.r_[first[1:], len(x)] - 1
    at = np.flatnonzero(~fresh[1:] & (y[1:] - y[:-1] > 1)) + 1
    start, stop, row = y[at - 1] + 1, y[at], row[at]
    out, next_to = np.zeros(len(at), bool), None
    for step in (-1, 1):
        beside = np.clip(row + step, 0, len(first) - 1)
        there = first[beside]
        next_to = (plane[there] == plane[at]) & (x[there] == x[at] + step)
        out |= ~next_to | (start < y[there]) | (stop - 1 > y[last[beside]])
    low = y.min()
    wide = y.max() - low + 2
    own = np.flatnonzero(next_to)  # the row after theirs is beside it
    begin = np.searchsorted(row * wide + (stop - low), (row[own] + 1) * wide + (start[own] - low), "right")
    end = np.searchsorted(row * wide + (start - low), (row[own] + 1) * wide + (stop[own] - low), "left")
    times = end - begin
    a, b = np.repeat(own, times), _ranges(begin, times)
    source, target = np.r_[a, b], np.r_[b, a]
    order = np.argsort(source, kind="stable")
    target = target[order]
    here = np.searchsorted(source[order], np.arange(len(at) + 1))
    front = np.flatnonzero(out)
    while len(front):
        met = target[_ranges(here[front], here[front + 1] - here[front])]
        front = np.unique(met[~out[met]])
        out[front] = True
    return at[~out], start[~out], stop[~out]


def _ranges(begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    """begin, begin + 1 ..., so many times each, one after the other."""
    return np.arange(times.sum()) + np.repeat(begin - np.cumsum(times) + times, times)


def holes(filled: np.ndarray) -> np.ndarray:
    """Places of a plane that aren't filled and that no path of open neighbours leads out of."""
    x, y = np.nonzero(filled)
    at, start, stop = enclosed(np.zeros(len(x), np.int64), x, y)
    out = np.zeros(filled.shape, bool)
    out[np.repeat(x[at], stop - start), _ranges(start, stop - start)] = True
    return out


def filled_planes(voxels: DataFrame, across: str, together: int = TOGETHER) -> DataFrame:
    """Distinct voxels and what they enclose within each plane across an axis.

    A task reads its planes sorted and fills those that it has whole, `together` voxels at once or one plane if that has
    more; what it holds grows with the voxels of a plane, not with its width or with the task's rows.
    """
    u, v = (p for p in PLACES if p != across)
    columns = ["mesh", *PLACES]

    def fill(planes: pa.Table) -> Iterator[pa.RecordBatch]:
        mesh = planes["mesh"].combine_chunks()
        code = mesh.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        c, x, y = (planes[p].to_numpy().astype(np.int64) for p in (across, u, v))
        new = np.r_[True, (code[1:] != code[:-1]) | (c[1:] != c[:-1])]
        once = np.flatnonzero(new | np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        yield from planes.take(pa.array(once)).to_batches()
        at, start, stop = enclosed((np.cumsum(new) - 1)[once], x[once], y[once])
        at, upto = once[at], np.cumsum(stop - start)
        for k in range(0, int(upto[-1]) if len(upto) else 0, together):  # an inside may be far larger than its rim
            number = np.arange(k, min(k + together, int(upto[-1])))
            gap = np.searchsorted(upto, number, "right")
            places = {across: c[at[gap]], u: x[at[gap]], v: stop[gap] - upto[gap] + number}
            yield pa.RecordBatch.from_arrays([mesh.take(pa.array(at[gap])), *[pa.array(places[p].astype(np.int32)) for p in PLACES]], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, most = [], 0, together
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= most:
                planes = pa.Table.from_batches(held).combine_chunks()
                same = pc.and_(*[pc.fill_null(pc.equal(planes[p], planes[p][-1]), False) if planes[p][-1].is_valid else pc.is_null(planes[p]) for p in ("mesh", across)])
                whole = pc.index(same, True).as_py()  # all rows before the last plane's
                if whole:
                    yield from fill(planes.slice(0, whole))
                held, rows = planes.slice(whole).to_batches(), rows - whole
                most = max(together, 2 * rows)
        if rows:
            yield from fill(pa.Table.from_batches(held))

    kind = voxels.schema["mesh"].dataType.simpleString()
    dealt = voxels.select(*columns).repartition("mesh", across).sortWithinPartitions("mesh", across, u, v)
    return dealt.mapInArrow(run, f"mesh {kind}, i int, j int, k int")


def filled(voxels: DataFrame) -> DataFrame:
    """Voxels and their interiors: holes of planes across the first axis, then the second, then the third, each in what the one before gave."""
    for across in PLACES:
        voxels = filled_planes(voxels, across)
    return voxels


def interior_points(vertices: DataFrame, faces: DataFrame, pitch: float) -> DataFrame:
    """mesh, x, y, z: the lower corners of all voxels of a closed mesh and its inside."""
    found = filled(boundary_voxels(vertices, faces, pitch))
    return found.select("mesh", *[(F.col(p) * F.lit(float(pitch))).alias(x) for x, p in zip("xyz", PLACES)])
