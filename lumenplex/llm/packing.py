"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing puts every piece, longest first, into the open sequence with the least room that still
takes it. Pieces of one length are alike, so the decisions need only how many pieces have each length: a table
of at most `capacity` rows, whatever the input. The driver runs best-fit over those counts, finding the tightest
room in a segment tree over remaining capacities, and gets runs of equal decisions; every piece then finds its
sequence and offset from its rank among pieces of its length. The packing is the global one; no task or driver
ever holds the pieces.

Odd input: a null text is empty and yields the end id alone; longer documents are cut every `capacity` ids;
repeated rows are packed each time; rows with a null id keep it; an empty table has no pieces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenplex.llm.pretokens import WordBpe, encoder

CAPACITY = 2048


class RoomTree:
    """A segment tree over remaining capacities: the smallest one in use that is at least a given room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.size)

    def put(self, room: int, used: bool) -> None:
        i = room + self.size
        self.used[i] = used
        while i > 1:
            i //= 2
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]

    def tightest(self, room: int) -> int | None:
        i = room + self.size
        if self.used[i]:
            return room
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.used[2 * i] else 2 * i + 1
        return i - self.size


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first sequence, pieces per sequence, first offset), and how many sequences."""
    tree, rooms, opened, runs = RoomTree(capacity), defaultdict(list), 0, []

    def push(room: int, first: int, n: int) -> None:
        if room and n:
            rooms[room].append((first, n))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = opened, -(-left // per)
                opened += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.put(room, False)
                per = room // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, first, per, capacity - room))
                push(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < n:
                runs.append((length, rank, first + full, left, capacity - room))
                push(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            push(room, first + full, n - full)
    return np.array(runs, np.int64).reshape(-1, 5), opened


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(WordBpe, path).encode_all, TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            if not b.num_rows:
                continue
            rows: list[tuple] = []
            named = iter(b.column(0).to_pylist())
            for ids, counts in encode(b.column(1), end_id):
                raw, ends = ids.tobytes(), np.cumsum(counts).tolist()
                for doc, count, stop in zip(islice(named, len(ends)), counts.tolist(), ends):
                    for k, a in enumerate(range(0, count, capacity)):
                        n = min(capacity, count - a)
                        at = 4 * (stop - count + a)
                        rows.append((doc, k, a, n, raw[at : at + 4 * n], part, seen[n]))
                        seen[n] += 1
            kinds = [b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit), and part and nth, which place() ranks by.

    part is the task, nth the count of pieces of the same length before it there. Write the pieces before they
    are placed, so that they are cut once.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_cut(tokenizer, end_id, capacity), f"doc_id {kind}, piece int, start long, length long, ids binary, part int, nth long")


#: Ranks below 2^44 beside lengths below 2^19 in one sortable number.
_RANKS = 1 << 44


def _placed(runs: np.ndarray, length_at: int, rank_at: int):
    keys = runs[:, 0] * _RANKS + runs[:, 1]
    order = np.argsort(keys)
    keys, runs = keys[order], runs[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (length_at, rank_at))
            own = runs[np.searchsorted(keys, length * _RANKS + rank, side="right") - 1]
            t = rank - own[:, 1]
            sequence, offset = own[:, 2] + t // own[:, 3], own[:, 4] + t % own[:, 3] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written pieces with sequence_id and offset instead of part and nth.

    Ranks need no shuffle of pieces by length: tasks count their lengths, a running sum over those counts says
    how many pieces of a length lie in the tasks before, and nth does the rest.
    """
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = best_fit(histogram, capacity)
    names = [c for c in pieces.columns if c not in ("part", "nth")]
    ranked = pieces.join(bases, ["length", "part"]).select(*names, (F.col("base") + F.col("nth")).alias("__rank"))
    at = {c: i for i, c in enumerate(ranked.columns)}
    fields = [f for f in ranked.schema.fields if f.name != "__rank"]
    schema = StructType(fields).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(_placed(runs, at["length"], at["__rank"]), schema)
