"""Phrase collocation mining: frequent phrases by Rabin-Karp fingerprints, ranked by how far they exceed chance.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and these into words. Prefix polynomials
modulo 2^64 over bytes give every word's hash, prefix polynomials over those the fingerprint of every run of words, all
as columns. Tasks add up equal fingerprints, with a pointer to an occurrence (document, place of its first word), and
Spark sums them; those met often enough are frequent.

Passes over the texts: words; pairs of frequent words; runs of three words and more all of whose pairs are frequent. A
phrase can't be more frequent than its parts, so nothing frequent is left out. A pass knows the frequent fingerprints
of the one before as a Bloom filter of at most FILTER_BITS bits: whatever it lets through too much is counted and
dropped, so its bound costs work where there are very many, never a phrase.

The last pass verifies against text: runs of words with a frequent fingerprint are compared word by word with the
first of their fingerprint in the task's share, which alone is made into a string, and strings are counted by Spark. A
collision can thus add work, but no wrong count.

Odd input: a null text is empty and has no words; a null language is `und`; repeated rows count each time; a null id is
a pointer like any; a long text is cut at the end of a piece, whole otherwise; other columns are ignored; an empty
table gives no phrases.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenplex.llm.common import written

LEAST, LONGEST, TOP = 100, 5, 2000
FILTER_BITS, FILTER_KEY_BITS = 1 << 28, 16
#: Bytes of text looked at together; fingerprints that a task adds up before it hands them on.
CHUNK, HELD = 1 << 20, 1 << 21
#: Tasks that rank a language's phrases before the last one, which sees TOP of each.
SALTS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(_BREAKS)] = 2
#: Bits of a fingerprint: fewer bytes to shuffle; what collides is told apart by its text.
FINGERPRINT_BITS = 48
_BASE, _STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return (x ^ x >> np.uint64(29)) * _MIX


@functools.lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and those of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _sums(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial of values, and the inverse powers that take a difference back to place 0."""
    size = max(1 << int(len(values)).bit_length(), 1 << 16)
    up, down = _powers(size, int(base))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out, down


@functools.lru_cache(maxsize=4096)
def _of_language(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of some texts: where they stand, their pieces and documents, their hashes."""

    def __init__(self, texts: list[bytes], langs: list[str], firsts: list[int]):
        """firsts: the number of words before each text in its document, where a long one was cut."""
        joined = b"\n".join(texts)
        data = np.frombuffer(joined, np.uint8)
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = low.tobytes()
        kind = _KIND[data]
        inside = np.concatenate(([False], kind == 0, [False]))
        self.start = np.flatnonzero(inside[1:] & ~inside[:-1])
        self.end = np.flatnonzero(inside[:-1] & ~inside[1:])
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.start] if len(self.start) else np.empty(0, np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size + 1) - (size + 1)
        self.doc = np.searchsorted(begin, self.start, side="right") - 1
        own = np.searchsorted(self.doc, np.arange(len(texts)))  # each text's first word
        self.nth = np.arange(len(self.start)) - own[self.doc] + np.array(firsts, np.int64)[self.doc]
        total, down = _sums(low.astype(np.uint64) + np.uint64(1), _BASE)
        self.hash = _mixed((total[self.end] - total[self.start]) * down[self.start])
        self.total, self.down = _sums(self.hash, _STEP)
        self.langs = langs
        self.lang = np.array([_of_language(x) for x in langs], np.uint64)

    def fingerprints(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of k words within a piece, and the runs' fingerprints."""
        at = np.arange(max(len(self.start) - k + 1, 0))
        at = at[self.piece[at] == self.piece[at + k - 1]]
        return at, self.of(at, k)

    def of(self, at: np.ndarray, k: int) -> np.ndarray:
        whole = _mixed(((self.total[at + k] - self.total[at]) * self.down[at]) ^ self.lang[self.doc[at]] + np.uint64(k))
        return whole >> np.uint64(64 - FINGERPRINT_BITS)

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join(self.data[self.start[at] : self.end[at + k - 1]].split())

    def same(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Whether the k words from each of a are those from each of b, byte by byte."""
        good = self.lang[self.doc[a]] == self.lang[self.doc[b]]
        data = np.frombuffer(self.data, np.uint8)
        for i in range(k):
            size = self.end[a + i] - self.start[a + i]
            good &= size == self.end[b + i] - self.start[b + i]
            rows = np.flatnonzero(good)
            n = size[rows]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            differ = data[np.repeat(self.start[a[rows] + i], n) + inner] != data[np.repeat(self.start[b[rows] + i], n) + inner]
            good[rows[np.repeat(np.arange(len(rows)), n)[differ]]] = False
        return good


def _cut(text: bytes) -> Iterator[bytes]:
    """The text in parts of about CHUNK bytes, each up to the end of a piece."""
    a = 0
    while len(text) - a > CHUNK:
        b = max(text.rfind(c, a, a + CHUNK) for c in (_BREAKS[i : i + 1] for i in range(len(_BREAKS))))
        if b < 0:
            later = [p for p in (text.find(_BREAKS[i : i + 1], a + CHUNK) for i in range(len(_BREAKS))) if p >= 0]
            if not later:
                break
            b = min(later)
        yield text[a : b + 1]
        a = b + 1
    yield text[a:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    """The words of texts gathered to about CHUNK bytes, and the documents' ids."""
    for b in batches:
        ids, langs = b.column("doc_id"), b.column("lang").to_pylist()
        rows, texts, firsts, held = [], [], [], 0
        for i, t in enumerate(b.column("text")):
            before = 0
            parts = list(_cut(t.as_py().encode()))
            for part in parts:
                rows.append(i)
                texts.append(part)
                firsts.append(before)
                held += len(part)
                if len(parts) > 1:
                    before += len(Words([part], ["und"], [0]).start)
                if held >= CHUNK:
                    yield Words(texts, [langs[r] for r in rows], firsts), ids.take(pa.array(rows))
                    rows, texts, firsts, held = [], [], [], 0
        if rows:
            yield Words(texts, [langs[r] for r in rows], firsts), ids.take(pa.array(rows))


class Filter:
    """Two bits for each fingerprint among a power of two of bits."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.low, self.high = bits, np.uint64(size - 1), np.uint64(FINGERPRINT_BITS + 1 - size.bit_length())

    def holds(self, fp: np.ndarray) -> np.ndarray:
        a, b = fp & self.low, fp >> self.high
        six, rest = np.uint64(6), np.uint64(63)
        return (self.bits[a >> six] >> (a & rest) & self.bits[b >> six] >> (b & rest) & np.uint64(1)).astype(bool)


def filter_of(frequent: DataFrame) -> Filter:
    """The Bloom filter of a written table's fingerprints: FILTER_KEY_BITS a key, FILTER_BITS at most, summed up by Spark."""
    size = 1 << max(16, min(FILTER_BITS.bit_length() - 1, (FILTER_KEY_BITS * frequent.count()).bit_length()))
    spots = F.array(F.col("fp").bitwiseAND(size - 1), F.shiftrightunsigned("fp", FINGERPRINT_BITS + 1 - size.bit_length()))
    words = frequent.select(F.explode(spots).alias("spot")).groupBy(F.shiftrightunsigned("spot", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return Filter(bits, size)


def _counted(sizes: tuple[int, ...], known: Callable[[], Filter | None], k_known: int):
    """Sums of fingerprints of runs of `sizes` words all of whose runs of `k_known` words are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, kind = known(), None
        fps, counts, docs, at = [], [], [], []
        held = 0

        def summed() -> tuple:
            fp, n, d, a = (np.concatenate(x) for x in (fps, counts, docs, at))
            order = np.argsort(fp, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], fp[order[1:]] != fp[order[:-1]])))
            return fp[order[first]], np.add.reduceat(n[order], first), d[order[first]], a[order[first]]

        names: list[pa.Array] = []  # ids of the documents pointed to, by number
        base = 0

        def handed(fp, n, d, a) -> pa.RecordBatch:
            ids = pa.concat_arrays(names).take(pa.array(d))
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(n), ids, pa.array(a)], ["fp", "n", "doc_id", "at"])

        for words, ids in _chunks(batches):
            kind = ids.type
            good = None
            if filter_ is not None:
                good = np.zeros(len(words.start) + 1, bool)
                where, fp = words.fingerprints(k_known)
                good[where] = filter_.holds(fp)
            for k in sizes:
                where = np.arange(max(len(words.start) - k + 1, 0))
                where = where[words.piece[where] == words.piece[where + k - 1]]
                if good is not None:
                    for i in range(k - k_known + 1):
                        where = where[good[where + i]]
                if not len(where):
                    continue
                fp, first, n = np.unique(words.of(where, k), return_index=True, return_counts=True)
                fps.append(fp)
                counts.append(n)
                docs.append(base + words.doc[where[first]])
                at.append(words.nth[where[first]])
                held += len(fp)
            names.append(ids)
            base += len(ids)
            if held >= HELD:
                found = summed()
                if len(found[0]) * 2 > HELD:
                    yield handed(*found)
                    fps, counts, docs, at, names, base, held = [], [], [], [], [], 0, 0
                else:
                    fps, counts, docs, at = ([x] for x in found)
                    held = len(found[0])
        if held:
            yield handed(*summed())

    return run


def _verified(filters: Callable[[], list[Filter]]):
    """lang, phrase, k, fp, n of the runs of words that the filters (by number of words, from 1) let through."""
    names = ["lang", "phrase", "k", "fp", "n"]

    def rows(langs: list, phrases: list, k: int, fp: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        own = [pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array([k] * len(langs), pa.int32()), pa.array(fp.view(np.int64)), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(own, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters()
        for words, _ in _chunks(batches):
            n = np.bincount(words.doc, minlength=len(words.langs))
            yield rows(words.langs, [None] * len(n), 0, np.zeros(len(n), np.uint64), n)
            for k, filter_ in enumerate(known, 1):
                where, fp = words.fingerprints(k)
                good = filter_.holds(fp)
                where, fp = where[good], fp[good]
                while len(where):  # once, but for collisions
                    one, first, group, n = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
                    lead = where[first]
                    alike = words.same(where, lead[group], k)
                    n = np.bincount(group[alike], minlength=len(one))
                    shown = [words.phrase(a, k).decode() for a in lead.tolist()]
                    yield rows([words.langs[d] for d in words.doc[lead].tolist()], shown, k, one, n)
                    where, fp = where[~alike], fp[~alike]

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f, doc_id, at of every phrase of 1 to `longest` words met `least` times; lang, n: all words), written."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"))
    schema = f"fp long, n long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, at long"
    levels, filters, pointers = [(1,), (2,), tuple(range(3, longest + 1))], [], []
    for level, sizes in enumerate(x for x in levels if x and x[0] <= longest):
        before = filters[-1] if filters else None
        run = _counted(sizes, (lambda b=before: b.value) if before else (lambda: None), level)
        sums = rows.mapInArrow(run, schema).groupBy("fp").agg(F.sum("n").alias("n"), F.first("doc_id").alias("doc_id"), F.first("at").alias("at"))
        often = written(sums.where(F.col("n") >= least), "frequent-fingerprints")
        pointers.append(often)
        filters.append(context.broadcast(filter_of(often)))
    by_size = filters[:2] + [filters[-1]] * (longest - 2)
    counted = rows.mapInArrow(_verified(lambda: [f.value for f in by_size[:longest]]), "lang string, phrase string, k int, fp long, n long")
    sums = written(counted.groupBy("lang", "phrase", "k", "fp").agg(F.sum("n").alias("f")).where(f"k = 0 or f >= {least}"), "frequent-phrases")
    places = functools.reduce(DataFrame.unionByName, pointers).select("fp", "doc_id", "at")
    phrases = sums.where("k > 0").join(places, "fp").drop("fp")
    # A table of its own: a row a language, so small that Spark can tell.
    return written(phrases, "phrases"), written(sums.where("k = 0").select("lang", F.col("f").alias("n")), "languages")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases, and the place of an occurrence (doc_id, at).

    The score is floor(1000 a n / (l r)) of the cut where it is least, as exact decimals.
    """
    phrases, totals = frequent_phrases(docs, least, longest, doc_id, text, lang)
    f = phrases.select("lang", "phrase", "f")
    longer = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), "doc_id", "at", F.split("phrase", " ", -1).alias("words"))
    part = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    cuts = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k")).alias("right"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    score = F.expr("cast(1000 as decimal(4, 0)) * cast(a as decimal(16, 0)) * cast(n as decimal(16, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    least_cut = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "n")).alias("best"))
    # Contiguous parts of 2 words and more that are met no more often than a longer phrase around them.
    inner = longer.where("k > 2").select("lang", "words", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("from"))
    inner = inner.groupBy("lang", part(F.col("from"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around"))
    kept = longer.join(inner, ["lang", "phrase"], "left").where("around is null or around < a").join(least_cut, ["lang", "phrase"])
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score", "doc_id", "at")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("doc_id").alias(doc_id), "at")
