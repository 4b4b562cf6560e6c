"""Token-id files: Simple-8b blocks of token ids in ascending document order, and their reader.

A block holds whole documents, about BLOCK_IDS ids. Its payload is a sequence of little-endian 64-bit words:
the top 4 bits select how many ids of how many bits the other 60 hold; ESCAPE says that the next word is one
raw value. Each block names its documents, their id counts and the place of its first id within its shard,
so any block can be decoded alone, a selector at a time. Blocks are rows of a Parquet table in the shared
folder: Spark's commit makes each shard appear whole or not at all, on any file system that Spark writes.

Odd input: a null text is empty, and holds only the end id; documents with a null id come first; rows with
the same id are ordered by their text's hash and each kept; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenplex.llm.common import written
from lumenplex.llm.pretokens import WordBpe, encoder

BLOCK_IDS = 65_536
ESCAPE = 15
#: Selector: ids in a word, bits of each. Fixed values of the format.
PACKING = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))

BLOCK_SCHEMA = "shard int, block int, first_id long, n_ids long, doc_ids array<{kind}>, doc_n array<bigint>, payload binary"


def pack_words(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, "<u8")
    last = len(PACKING) - 1
    need = np.zeros(n + PACKING[0][0], np.int8)  # the first selector wide enough, last + 1: escape; none past the end
    for _, bits in PACKING:
        need[:n] += values >= np.uint64(1 << bits)
    best = np.where(need[:n] > last, ESCAPE, last).astype(np.int8)
    widest, span = need[:n].copy(), 1  # of the next `span` values
    for s in range(last - 1, -1, -1):
        for k in range(span, PACKING[s][0]):
            np.maximum(widest, need[k : k + n], out=widest)
        span = PACKING[s][0]
        best[widest <= s] = s
    counts = np.ones(16, np.uint8)
    counts[: len(PACKING)] = [c for c, _ in PACKING]
    step = counts[best].tobytes()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    chosen = best[at]
    place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(chosen == ESCAPE)[:-1]))
    out = np.zeros(len(at) + int((chosen == ESCAPE).sum()), np.uint64)
    padded = np.concatenate((values, np.zeros(PACKING[0][0], np.uint64)))
    for s, (count, bits) in enumerate(PACKING):
        if len(rows := np.flatnonzero(chosen == s)):
            word = np.full(len(rows), s << 60, np.uint64)
            for k in range(count):
                word |= padded[at[rows] + k] << np.uint64(k * bits)
            out[place[rows]] = word
    if len(rows := np.flatnonzero(chosen == ESCAPE)):
        out[place[rows]] = np.uint64(ESCAPE << 60)
        out[place[rows] + 1] = values[at[rows]]
    return out.astype("<u8")


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    """The first n values of Simple-8b words, a selector at a time."""
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int8)
    head = np.ones(len(words), bool)
    if (selector == ESCAPE).any():  # a raw word may look like any selector, so walk over the escapes
        for i in np.flatnonzero(selector == ESCAPE).tolist():
            if head[i]:
                head[i + 1] = False
    counts = np.ones(16, np.int64)
    counts[: len(PACKING)] = [c for c, _ in PACKING]
    own = np.where(head, counts[selector], 0)
    start = np.cumsum(own) - own
    out = np.zeros(int(own.sum()) if len(own) else 0, np.uint64)
    for s, (count, bits) in enumerate(PACKING):
        if len(rows := np.flatnonzero((selector == s) & head)):
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[start[rows] + k] = (words[rows] >> np.uint64(k * bits)) & mask
    if len(rows := np.flatnonzero((selector == ESCAPE) & head)):
        out[start[rows]] = words[rows + 1]
    return out[:n]


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(WordBpe, path).encode_all
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        kind = pa.int64()
        counts: list[int] = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "first_id": pa.array([first], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([docs], pa.list_(kind)),
                    "doc_n": pa.array([counts], pa.list_(pa.int64())),
                    "payload": pa.array([pack_words(ids).tobytes()], pa.binary()),
                }
            )

        held = 0
        for batch in batches:
            kind = batch.column(0).type
            named = iter(batch.column(0).to_pylist())
            for ids, n in encode(batch.column(1), end_id):
                ends = np.cumsum(n).tolist()
                for doc, k, stop in zip(islice(named, len(ends)), n.tolist(), ends):
                    docs.append(doc)
                    counts.append(k)
                    parts.append(ids[stop - k : stop])
                    held += k
                    if held >= BLOCK_IDS:
                        yield close()
                        block, first, held = block + 1, first + held, 0
                        docs, counts, parts = [], [], []
        if docs:
            yield close()

    return run


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts, append end_id to each, and write them as blocks in ascending id order."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("hash"))
    # The hash is a range key too: rows that share an id, or have none, are spread over tasks.
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(ordered.mapInArrow(_blocks(tokenizer, end_id), BLOCK_SCHEMA.format(kind=kind)), "token-blocks")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch.column("doc_ids").type.value_type
        for row in batch.to_pylist():
            ids = unpack_words(np.frombuffer(row["payload"], "<u8"), row["n_ids"]).astype("<u4")
            n = np.array(row["doc_n"], np.int64)
            ends = np.cumsum(n)
            raw = ids.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * len(n), pa.int32()),
                    pa.array(row["doc_ids"], kind),
                    pa.array(row["first_id"] + ends - n, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary()),
                ],
                ["shard", "doc_id", "within", "n_tokens", "ids"],
            )


def read_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit) of every document in the blocks.

    A shard's first id follows from the sums of the shards before it: one row per shard is gathered, and shards
    are as many as the writing job had tasks. They are a written table, so Spark knows its size when it chooses the join.
    """
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    shards = written(shards, "shards")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    docs = blocks.mapInArrow(_decoded, f"shard int, doc_id {kind}, within long, n_tokens long, ids binary")
    return docs.join(shards, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")
