"""Approximate nearest neighbours: multiprobe p-stable hashing, with exact reranking.

Nearness is the inner product. Vectors are scaled into the unit ball and one coordinate is appended that brings
each to the unit sphere, where a larger inner product is a smaller distance; queries are scaled to length 1 and
get a 0. The scale goes by ranges of norms, each within a factor of 2 (RANGES of them, the last takes all shorter
ones), so that a single long vector doesn't press the others together; a query visits its cells in every range
that has points. A table hashes a vector to the cells of K Gaussian projections of width WIDTH. A query visits cells
in order of their estimated success: its own, then perturbed ones by the expected sum of squared distances to the
borders that they cross, its own borders ranked from the nearest to the farthest.

K and the number of cells to visit are measured on the data. SAMPLE queries are answered exactly. For each K, the
least number of cells that finds TARGET of those neighbours is known from them, and the K that looks at the fewest
points is taken. Where vectors are close to their neighbours, cells are small and few are visited. Where hashing separates
little, cells are large and most are, so recall holds and the cost nears that of looking at all points.
Queries that end with too few rows are searched again with half the projections, down to none, where one cell holds
every point: each query ends with k rows or all others.

The first few projections name an area of cells. Areas are dealt into units of at most about UNIT_BYTES of vectors;
one of more than an eighth of that is split by id, and a query visits all its parts. A task holds one unit and scores,
cell by cell, all queries that visit the cell in one matrix product; of these only scores above a query's best so far
go on. Identical vectors count once as queries, and as points with their k + 1 least ids, which is all that any answer
can hold.

Odd input: vectors that are null, zero, hold a null or non-finite component, or differ in length from most others
take no part; without others a query has no rows; ties go to the smaller id; a null id takes no part; rows that
repeat an id and vector count once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenplex.llm.common import written

TABLES, WIDTH, RANGES = 2, 2.5, 16
SAMPLE, TARGET, MOST = 200, 0.93, 1024
#: A visit of a cell costs about as much as scoring so many points.
VISIT = 16
UNIT_BYTES = 8 << 20
#: Scores that a task holds at once.
SCORES = 2_000_000
SEED = 20240117


class Hasher:
    """Cells of TABLES tables of k projections; the first projections are the same for every k."""

    def __init__(self, dims: int, norm: float, k: int, lead: int, width: float = WIDTH):
        tables = TABLES if k else 1  # without projections all tables are one
        self.k, self.lead, self.tables, self.width, self.norm = k, min(lead, k), tables, width, norm
        rng = np.random.default_rng(SEED)
        every = rng.normal(size=(64, TABLES, dims + 1))[:k, :tables]
        self.axes = every.transpose(2, 1, 0).reshape(dims + 1, tables * k)
        self.shift = rng.uniform(0, width, size=(64, TABLES))[:k, :tables].T.reshape(-1)
        self.mix = rng.integers(1, 2**62, size=66, dtype=np.int64) | 1

    def ranges(self, x: np.ndarray) -> np.ndarray:
        """The range of each vector's norm: 0 reaches down to half of the largest norm, 1 to a quarter of it, ..."""
        with np.errstate(divide="ignore"):
            down = np.floor(-np.log2(np.linalg.norm(x / self.norm, axis=1)))
        return np.clip(down, 0, RANGES - 1).astype(np.int64)

    def moved(self, keys: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """The keys of range 0 as those of other ranges."""
        with np.errstate(over="ignore"):
            return keys + ranges * self.mix[-1]

    def _project(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.axes + self.shift) / self.width).reshape(len(x), self.tables, self.k)

    def keys(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit keys of areas and cells of (rows, table, ..., k), each table with its own."""
        with np.errstate(over="ignore"):
            h = np.arange(1, self.tables + 1, dtype=np.int64) * self.mix[-2]
            h = np.broadcast_to(h.reshape(-1, *[1] * (cells.ndim - 3)), cells.shape[:-1]).copy()
            area = h.copy()
            for i in range(self.k):
                h = (h ^ (h >> 29)) * self.mix[i] + cells[..., i].astype(np.int64)
                if i + 1 == self.lead:
                    area = h.copy()
            return area ^ (area >> 31), h ^ (h >> 31)

    def points(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of areas and cells (point, table)."""
        ranges = self.ranges(x)
        x = x / self.norm * 2.0 ** ranges[:, None]
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        return tuple(self.moved(h, ranges[:, None]) for h in self.keys(np.floor(self._project(np.c_[x, rest]))))

    def probes(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of areas and cells (query, table, probe) in range 0, in the order in which they are visited."""
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        at = self._project(np.c_[q, np.zeros(len(q))])
        base = np.floor(at)
        low = at - base
        order = np.argsort(np.minimum(low, 1 - low), axis=2, kind="stable")
        # Steps come by nearness of the border: -1 crosses the near one of a dimension, 1 the far one.
        steps = probe_order(self.k, min(n, 3**self.k))
        place = np.argsort(order, axis=2)
        side = np.where(low <= 0.5, 1.0, -1.0)
        cells = steps.T[place].transpose(0, 1, 3, 2) * side[:, :, None, :] + base[:, :, None, :]
        return self.keys(cells)


def probe_order(k: int, n: int) -> np.ndarray:
    """The first n steps in order of their expected cost, for k dimensions sorted by their nearest border."""
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    far = 1 - j / (k + 1) + j * (j + 1) / (4 * (k + 1) * (k + 2))
    return best_steps(np.concatenate((near, far)), k, n)


def best_steps(cost: np.ndarray, k: int, n: int) -> np.ndarray:
    """The n cheapest perturbations (-1, 0 or 1 by dimension), in order of their summed cost."""
    out = np.zeros((n, k))
    if not k:
        return out
    order = np.argsort(cost, kind="stable").tolist()
    c = cost[order].tolist()
    dim, step = [j % k for j in order], [-1 if j < k else 1 for j in order]
    heap, found, last = [(c[0], (0,))], 1, len(c) - 1
    while heap and found < n:
        s, chosen = heapq.heappop(heap)
        dims = [dim[j] for j in chosen]
        if len(set(dims)) == len(dims):
            for j in chosen:
                out[found, dim[j]] = step[j]
            found += 1
        j = chosen[-1]
        if j < last:
            heapq.heappush(heap, (s - c[j] + c[j + 1], (*chosen[:-1], j + 1)))
            heapq.heappush(heap, (s + c[j + 1], (*chosen, j + 1)))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _listed(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _keyed(hasher: Hasher, probes: int = 0, ranges: tuple[int, ...] = ()):
    """The areas and cells of points (no probes), or those that queries visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256 if probes else whole.num_rows or 1):
                b = whole.slice(a, 256) if probes else whole
                x = _matrix(b.column(1))
                keys = hasher.probes(x, probes) if probes else hasher.points(x)
                if probes:
                    keys = [np.concatenate([hasher.moved(h, np.int64(r)).reshape(len(x), -1) for r in ranges], axis=1) for h in keys]
                yield pa.RecordBatch.from_arrays([*b.columns, *map(_listed, keys)], ["id", "vec", "areas", "cells"])

    return run


class Best:
    """The k best points of each of n queries among all that were offered."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.parts, self.held = k, np.full(n, -np.inf), [], 0

    def offer(self, rows: np.ndarray, q: np.ndarray, vecs: np.ndarray, ids: np.ndarray) -> None:
        """Points vecs, ids for the queries in rows, whose vectors are q."""
        step = max(1, SCORES // len(ids))
        for a in range(0, len(rows), step):
            own, v = rows[a : a + step], q[a : a + step]
            rough = v @ vecs.T
            off = 1e-9 + 1e-13 * np.abs(rough).max()  # a product in one go rounds otherwise than row by row
            low = self.least[own]
            if len(ids) > self.k and np.isneginf(low).any():
                low = np.maximum(low, np.partition(rough, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero(rough >= (low - off)[:, None])
            if len(i):
                self.parts.append((own[i], ids[j], np.einsum("ij,ij->i", v[i], vecs[j])))
                self.held += len(i)
            if self.held > min(SCORES, 4 * self.k * len(self.least)):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query rows, ids and scores, the best first."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        rows, ids, scores = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        once = np.ones(len(rows), bool)  # tables share candidates
        once[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
        rows, ids, scores = rows[once], ids[once], scores[once]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        nth = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        full = nth == self.k - 1
        self.least[rows[full]] = scores[full]
        keep = nth < self.k
        out = rows[keep], ids[keep], scores[keep]
        self.parts, self.held = [out], 0  # what stays counts no more: a next sort comes after as many new ones
        return out


def _sampled(ids: np.ndarray, vecs: np.ndarray, k: int):
    """A task's k best points for each sampled query, with their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, x_of = Best(len(ids), k), {}
        for b in batches:
            if b.num_rows:
                points, x = b.column("id").to_numpy(), _matrix(b.column("vec"))
                best.offer(np.arange(len(ids)), vecs, x, points)
                rows, own, _ = best.settle()
                at = {p: i for i, p in enumerate(points.tolist())}
                x_of = {p: x[at[p]] if p in at else x_of[p] for p in own.tolist()}
        rows, own, scores = best.settle()
        if len(rows):
            near = _listed(np.stack([x_of[p] for p in own.tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(own), pa.array(scores), near], ["nth", "id", "score", "vec"])

    return run


def _ranged(hasher: Hasher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hasher.ranges(_matrix(b.column(0)))).astype(np.int32))], ["range"])

    return run


def measured(points: DataFrame, asked: DataFrame, about: dict, ranges: int, k: int) -> tuple[int, int]:
    """How many projections a table has, and how many of its cells to visit, so that TARGET of a sample's neighbours are found.

    Of the numbers that do it within MOST cells, the one that looks at the fewest different points.
    """
    order = F.xxhash64("id", F.lit(SEED))
    sample = asked.orderBy(order, "id").limit(SAMPLE).collect()
    if not sample:
        return 0, 1
    ids, vecs = np.array([r["id"] for r in sample]), np.array([r["vec"] for r in sample], float)
    near = points.mapInArrow(_sampled(ids, vecs, k + 1), "nth long, id long, score double, vec array<double>")
    best = F.row_number().over(Window.partitionBy("nth").orderBy(F.desc("score"), "id"))
    near = near.withColumn("rank", best).where(F.col("rank") <= k + 1).select("nth", "id", "vec").collect()  # SAMPLE * (k + 1) rows at most
    near = [r for r in near if r["id"] != ids[r["nth"]]]
    if not near:
        return 0, 1
    of, close = np.array([r["nth"] for r in near]), np.array([r["vec"] for r in near], float)
    some = np.array([r["vec"] for r in points.orderBy(order, "id").limit(10 * SAMPLE).select("vec").collect()], float)
    top = max(1, int(0.75 * np.log2(max(about["n"], 4))))
    costs = {}
    for dims in sorted({max(1, round(top * 0.8**i)) for i in range(12)}):
        hasher = Hasher(about["dims"], about["norm"], dims, 0)
        most = max(1, min(MOST // ranges, 3**dims))
        probes = hasher.probes(vecs, most)[1]
        keys, own = hasher.points(close)[1], hasher.ranges(close)
        needed = []  # the first visit, in any table, that meets the neighbour
        for q, key in zip(of, hasher.moved(keys, -own[:, None])):
            met = (probes[q] == key[:, None]).any(0)
            needed.append(int(met.argmax()) + 1 if met.any() else most + 1)
        enough = sorted(needed)[max(int(np.ceil(TARGET * len(needed))) - 1, 0)]
        if enough > most:
            continue
        held = hasher.moved(hasher.points(some)[1], -hasher.ranges(some)[:, None])
        met = [np.any([np.isin(held[:, t], probes[q, t, :enough]) for t in range(TABLES)], axis=0).mean() for q in range(min(len(vecs), 50))]
        costs[dims] = (about["n"] * float(np.mean(met)) + VISIT * TABLES * enough * ranges, enough)
    dims = min(costs, key=lambda d: (costs[d][0], d), default=0)
    return dims, costs[dims][1] if dims else 1


def _searched(k: int):
    """Rows come unit by unit, a unit's points first and by cell, then its queries with the cells that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, points = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            units, kinds = batch.column("unit").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(units)]
            for a, z in zip(cuts, cuts[1:]):
                part = batch.slice(a, z - a)
                if units[a] != unit:
                    unit, held, points = units[a], [], None
                if kinds[a] == 0:
                    held.append((part.column("cell").to_numpy(), part.column("id").to_numpy(), _matrix(part.column("vec"))))
                    continue
                if points is None and held:
                    cell, ids, vecs = (np.concatenate(c) for c in zip(*held))
                    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                    points, held = (cell[first], np.append(first, len(cell)), ids, vecs), []
                if points is None:
                    continue
                cells, ends, ids, vecs = points
                visits = part.column("cells")
                row, cell = np.repeat(np.arange(len(part)), visits.value_lengths().to_numpy()), visits.flatten().to_numpy()
                at = np.searchsorted(cells, cell)
                there = cells[np.minimum(at, len(cells) - 1)] == cell
                row, at = row[there], at[there]
                order = np.argsort(at, kind="stable")
                row, at = row[order], at[order]
                q, best = _matrix(part.column("vec")), Best(len(part), k)
                starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
                    c = at[s]
                    own = slice(ends[c], ends[c + 1])
                    best.offer(row[s:e], q[row[s:e]], vecs[own], ids[own])
                found, ids_found, scores = best.settle()
                yield pa.RecordBatch.from_arrays([pa.array(part.column("id").to_numpy()[found]), pa.array(ids_found), pa.array(scores)], ["query", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, vec (floats if they were, else doubles) and a hash of it, of the vectors that take part."""
    v = F.col(f"`{embedding}`")
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(f"`{vec_id}`").isNotNull() & v.isNotNull()).where(fine).select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.cast(kind).alias("vec"))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (length["n"] if length else 0)).withColumn("hash", F.xxhash64("vec"))


def hashed_search(points: DataFrame, asked: DataFrame, hasher: Hasher, n: int, probes: int, ranges: tuple[int, ...], k: int) -> DataFrame:
    """query, vec_id and score: the k best in every unit, among the points of the cells that a query visits. points and asked: id, vec."""
    kind = points.schema["vec"].dataType.simpleString()
    room = unit_rows(len(hasher.axes) - 1)
    units = int(n * hasher.tables // room) + 1
    schema = f"id long, vec {kind}, areas array<bigint>, cells array<bigint>"
    both_keys = F.explode(F.arrays_zip("areas", "cells")).alias("at")
    dealt = points.mapInArrow(_keyed(hasher), schema).select("id", "vec", both_keys).select("id", "vec", F.col("at.areas").alias("area"), F.col("at.cells").alias("cell"))
    areas = written(dealt.groupBy("area").agg(F.ceil(F.count("*") * 8 / F.lit(room)).alias("blocks")), "areas")
    unit = lambda block: F.pmod(F.xxhash64("area", block), F.lit(units))
    large = areas.where("blocks > 1").withColumnRenamed("area", "large")
    dealt = dealt.join(large, F.col("area") == F.col("large"), "left").withColumn("unit", unit(F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1)))))
    visiting = asked.mapInArrow(_keyed(hasher, probes, ranges), schema)
    visits = visiting.select("id", "vec", F.explode(F.array_distinct(F.arrays_zip("areas", "cells"))).alias("at"))
    visits = visits.groupBy("id", F.col("at.areas").alias("area")).agg(F.any_value("vec").alias("vec"), F.collect_list("at.cells").alias("cells"))
    visits = visits.join(areas, "area").select("id", "vec", "area", "cells", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    visits = visits.withColumn("unit", unit(F.col("block"))).groupBy("unit", "id").agg(F.any_value("vec").alias("vec"), F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells"))
    both = dealt.select("unit", F.lit(0).alias("kind"), "cell", "id", "vec", F.lit(None).cast("array<bigint>").alias("cells")).unionByName(
        visits.select("unit", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("cell"), "id", "vec", "cells")
    )
    return both.repartition("unit").sortWithinPartitions("unit", "kind", "cell").mapInArrow(_searched(k), "query long, vec_id long, score double")


def unit_rows(dims: int) -> int:
    return max(UNIT_BYTES // (8 * dims), 64)


def leading(n: int, dims: int) -> int:
    """How many projections name an area: as many as leave about an eighth of a unit's points in it."""
    return max(0, int(np.log(8 * n / unit_rows(dims)) / np.log(3)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: each query's k nearest found, itself left out. is_query is over `id`."""
    rows = usable(vectors, vec_id, embedding)
    queries = rows.where(is_query)
    same = Window.partitionBy("hash", "vec").orderBy("id")
    points = rows.distinct().withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).select("id", "vec")
    points = written(points, "points")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    about = points.agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("vec")).alias("dims")).first().asDict()
    schema = "query_id long, rank int, vec_id long, score double"
    if not about["n"]:
        return vectors.sparkSession.createDataFrame([], schema)
    n, lead = about["n"], leading(about["n"], about["dims"])
    hasher = Hasher(about["dims"], about["norm"], 0, 0)
    ranges = points.select("vec").mapInArrow(_ranged(hasher), "range int").distinct().collect()  # RANGES at most
    ranges = tuple(sorted(r["range"] for r in ranges))
    # Identical query vectors are searched once, under the least id.
    asked = written(queries.groupBy("hash", "vec").agg(F.min("id").alias("id")).select("id", "vec", "hash"), "asked")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    dims, probes = measured(points, asked, about, len(ranges), k)
    left, done = asked, []
    while True:
        hasher = Hasher(about["dims"], about["norm"], dims, lead)
        found = hashed_search(points, left.select("id", "vec"), hasher, n, probes, ranges, k + 1)
        found = written(found.distinct().withColumn("nth", best).where(F.col("nth") <= k + 1).drop("nth"), "found")
        if not dims:
            done.append(found)
            break
        full = found.groupBy("query").count().where(F.col("count") >= min(k + 1, n)).select("query")
        done.append(found.join(full, "query", "left_semi"))
        left = written(left.join(full, F.col("id") == F.col("query"), "left_anti"), "short")
        if left.isEmpty():
            break
        dims = dims // 2
        probes = min(probes, 3**dims)
    found = done[0]
    for other in done[1:]:
        found = found.unionByName(other)
    # Every query gets the answer for its vector, without itself.
    named = queries.select("hash", "vec", F.col("id").alias("query_id")).distinct().join(asked.select("hash", "vec", F.col("id").alias("query")), ["hash", "vec"]).select("query", "query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    answers = named.join(found, "query").where("query_id <> vec_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
