"""Document fingerprints: quartile bucket digests and their bounded difference.

A window of five bytes moves over the text's UTF-8 bytes, four zero bytes behind them. The byte at its end makes six
triplets with the pairs of the four before it; each triplet's hash counts in one of 128 buckets. The digest says for
each bucket in which quarter of the counts it lies, and beside that how the quartiles relate and, coarsely, how long
the text is. Differences are sums over buckets of how far the quarters lie apart, and of the header's differences, up
to a bound, about what independent digests differ by; the likeness is 1 less the difference's share of it.

A digest in hexadecimal: length code (4 digits: eight times the number of bits of the length, and its next three bits),
first and second quartile in fifteenths of the third (1 digit each), 64 digits of two buckets each, two bits a bucket.

Odd input: a null text is empty; an empty text has the digest of no counts; equal texts have equal digests, whatever
their length; a long text is counted in pieces, whole; repeated rows each have a row, those that share an id ordered
by their text's hash; null ids come first; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenplex.llm.common import written

BUCKETS, WINDOW, FACTOR, PIECE = 128, 5, 1_640_531_527, 1 << 20
#: Pairs of places before the window's last byte; with it each makes a triplet.
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
#: What quarters that lie apart count for, by their distance; bounds of the lengths' difference and of the whole.
APART, LONGEST_APART = (0, 1, 2, 6), 24
#: Quarters of independent digests count (6 x 1 + 4 x 2 + 2 x 6) / 16 a bucket; their headers about 16.
MOST = BUCKETS * 26 // 16 + 16


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """(number of the text, bytes with four more behind, windows), gathered to about PIECE bytes; long texts are cut."""
    which, parts, sizes, held = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t), PIECE):
            n = min(PIECE, len(t) - a)
            which.append(i)
            parts.append(t[a : a + n + WINDOW - 1].ljust(n + WINDOW - 1, b"\0"))
            sizes.append(n)
            held += n
            if held >= PIECE:
                yield which, parts, sizes
                which, parts, sizes, held = [], [], [], 0
    if which:
        yield which, parts, sizes


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed triplets, a row of BUCKETS for each text."""
    out = np.zeros(len(texts) * BUCKETS, np.int64)
    for which, parts, sizes in _pieces(texts):
        n = np.array(sizes)
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        first = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)
        base = np.repeat(np.arange(len(n)), n)  # rows of this gathering
        at = np.arange(len(base)) + (first - (np.cumsum(n) - n))[base]
        byte = [data[at + k] for k in range(WINDOW)]
        row = base * BUCKETS
        total = np.zeros(len(n) * BUCKETS, np.int64)
        for salt, (i, j) in enumerate(PAIRS):
            key = byte[4] | byte[i] << np.uint32(8) | byte[j] << np.uint32(16) | np.uint32(salt << 24)
            total += np.bincount(row + (key * np.uint32(FACTOR) >> np.uint32(25)), minlength=len(total))
        np.add.at(out.reshape(-1, BUCKETS), np.array(which), total.reshape(-1, BUCKETS))
    return out.reshape(-1, BUCKETS)


def length_code(n: int) -> int:
    """Eight times the number of bits of n and, as the rest, its three bits behind the first."""
    bits = n.bit_length()
    return 8 * bits + ((n << 3 >> bits - 1) & 7 if n else 0)


def digests(texts: list[bytes]) -> list[str]:
    """The digest of each text in hexadecimal."""
    counts = bucket_counts(texts)
    order = np.sort(counts, axis=1)
    q = [order[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    quarter = sum((counts > x[:, None]).astype(np.uint8) for x in q)
    body = quarter[:, 0::2] << 2 | quarter[:, 1::2]
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[body]
    third = np.maximum(q[2], 1)
    head = zip((15 * q[0] // third).tolist(), (15 * q[1] // third).tolist())
    return [f"{length_code(len(t)):04x}{a:x}{b:x}{row.tobytes().decode()}" for t, (a, b), row in zip(texts, head, digits)]


def _read(shown: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([int(s[:4], 16) for s in shown], np.int64)
    value = np.zeros(256, np.int64)
    value[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)
    digits = value[np.frombuffer("".join(s[4:] for s in shown).encode(), np.uint8)].reshape(len(shown), -1)
    return length, digits[:, :2], np.stack((digits[:, 2:] >> 2, digits[:, 2:] & 3), axis=2).reshape(len(shown), -1)


def differences(a: list[str], b: list[str]) -> np.ndarray:
    """How far each digest of a lies from that of b: 0 to MOST."""
    if not a:
        return np.empty(0, np.int64)
    (la, qa, xa), (lb, qb, xb) = _read(a), _read(b)
    return np.minimum(MOST, np.minimum(abs(la - lb), LONGEST_APART) + abs(qa - qb).sum(1) + np.array(APART)[abs(xa - xb)].sum(1))


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal digests, 0 for those no more alike than independent ones."""
    return (MOST - differences(a, b)) / MOST


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shown = digests([t.as_py().encode() for t in b.column(1)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shown, pa.string())], ["key", "fingerprint"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row's whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints, f"key {kind}, fingerprint string").withColumnRenamed("key", doc_id)


_FOUND = (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))
_FOUND_SQL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """text, its second half replaced by as many code points of what follows, or all of these."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(texts: list[str], after: list[str], shown: list[str], shown_after: list[str]) -> list[pa.Array]:
    changed = [edited(t, x).encode() for t, x in zip(texts, after)]
    fp = digests(changed)
    out = [[len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in changed], shown, fp, likeness(shown, fp), likeness(shown, shown_after)]
    return [pa.array(x, kind) for x, (_, kind) in zip(out, _FOUND)]


_EDGE = [("part", pa.int32()), ("edge", pa.string())]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each text of a sorted part with the next one; the part's first and last texts go out too, as its edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [n for n, _ in _EDGE] + ["doc_id", "text"] + [n for n, _ in _FOUND]

    def edge(which: str, ids: pa.Array, text: str) -> pa.RecordBatch:
        own = [pa.array([part], pa.int32()), pa.array([which]), ids, pa.array([text], pa.string())]
        return pa.RecordBatch.from_arrays(own + [pa.nulls(1, kind) for _, kind in _FOUND], names)

    last = None  # the id, text and digest that wait for what comes next
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        shown = digests([t.encode() for t in texts])
        if last is None:
            yield edge("first", ids.slice(0, 1), texts[0])
        else:
            ids = pa.concat_arrays([last[0], ids])
            texts, shown = [last[1], *texts], [last[2], *shown]
        n = len(texts) - 1
        if n:
            found = _compared(texts[:n], texts[1:], shown[:n], shown[1:])
            own = [pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), ids.slice(0, n), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays(own + found, names)
        last = (ids.slice(n, 1), texts[n], shown[n])
    if last is not None:
        yield edge("last", last[0], last[1])


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, after = b.column(1).to_pylist(), b.column(2).to_pylist()
        shown = [digests([t.encode() for t in x]) for x in (texts, after)]
        yield pa.RecordBatch.from_arrays([b.column(0), *_compared(texts, after, *shown)], ["doc_id"] + [n for n, _ in _FOUND])


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next row is that of the next id, the first row's after the last. Texts are shuffled once, into ascending parts;
    only a part's first and last texts are met across parts.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("hash"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = written(ordered.mapInArrow(_in_order, f"part int, edge string, doc_id {kind}, text string, {_FOUND_SQL}"), "digests")
    columns = ["doc_id", *[n for n, _ in _FOUND]]
    first, last = (found.where(F.col("edge") == e).select("part", "doc_id", "text") for e in ("first", "last"))
    # A row a part, without texts: which part comes next; the first one after the last.
    parts = last.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.lit(-1)).alias("next"))
    least = first.select(F.min("part").alias("least"))
    parts = parts.crossJoin(F.broadcast(least)).select("part", F.when(F.col("next") < 0, F.col("least")).otherwise(F.col("next")).alias("next"))
    pairs = last.join(parts, "part").join(first.select(F.col("part").alias("next"), F.col("text").alias("after")), "next")
    met = pairs.select("doc_id", "text", "after").mapInArrow(_at_edges, f"doc_id {kind}, {_FOUND_SQL}")
    out = found.where("edge is null").select(*columns).unionByName(met.select(*columns))
    return out.withColumnRenamed("doc_id", doc_id)
