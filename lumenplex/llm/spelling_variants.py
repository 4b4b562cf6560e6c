"""Spelling variant grouping: words one code point apart, found by a bit-sliced position index.

Words are counted by Spark. Two words one edit apart agree on one half of the shorter one, so each word is dealt to
the groups of its halves: as an indexed word of its own length, and as a query for words one shorter. A group that is
still large is halved again, with the same argument, until it is small or a single place is left open, where the
alphabet bounds it; so no task holds an unbounded group and no pair of words is lost.

Within a group the index holds, for each lane of 64 words, each position and each letter, the 64-bit set of the words
with that letter there. A query walks over the positions and keeps two sets a lane: words met without an error so far,
and words met with one; the second is fed by the first, at the same position for a replaced code point and one position
on for a dropped one. Many queries are walked at once, as columns of words.

A pair may meet in several groups. It counts in the one that is reached by taking the first half wherever both match.

Odd input: null and empty texts have no words; a null id counts as an empty one; repeated rows count each time; other
columns are ignored; an empty table gives no words; words of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenplex.llm.common import written

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: A group of more rows is halved again; a walk takes so many queries and lanes, a block so many letters.
LARGE, WALK, BLOCK = 4096, 1 << 16, 1 << 22

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def marked_runs(docs: DataFrame, least: int = LEAST_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word: every run of letters of `least` code points or more, one in 31 with a code point dropped by its checksum."""
    lower = F.translate(F.col(f"`{text}`"), _UPPER, _LOWER)
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    # A shorter run can't become a word, so the pattern leaves it out.
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    mark = F.crc32(F.concat("key", F.lit(":"), "run"))
    at = (F.col("mark") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("mark") % 31 == 0, cut).otherwise(F.col("run"))
    return runs.withColumn("mark", mark).select(word.alias("word")).where(F.length("word") >= least)


def vocabulary(runs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word and n, of words with at least `least` occurrences."""
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _halves(rows: DataFrame, halve: Column) -> DataFrame:
    """rows where `halve` dealt to both halves of what is open: the first one agrees, or the second one does."""
    first = F.floor(F.col("open") / 2).cast("int")
    same = F.struct("at", "open")
    both = F.array(F.struct((F.col("at") + first).alias("at"), (F.col("open") - first).alias("open")), F.struct("at", first.alias("open")))
    return rows.select("word", "n", "length", F.explode(F.when(halve, both).otherwise(F.array(same))).alias("part")).select("word", "n", "length", "part.at", "part.open")


def _keyed(rows: DataFrame) -> DataFrame:
    """key: what is agreed on, before and behind the open places, and where these are."""
    rest = F.col("at") + F.col("open") + F.length("word") - F.col("length") + 1
    key = F.xxhash64("length", "at", "open", F.substring("word", F.lit(1), F.col("at")), F.substring("word", rest, F.length("word")))
    return rows.withColumn("key", key)


def dealt(words: DataFrame, large: int = LARGE) -> DataFrame:
    """word, n, length (of the indexed words), at, open, key: every word in each group where it may meet a near one."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length")).where("length > 0")
    rows = rows.select("word", "n", "length", F.lit(0).alias("at"), F.col("length").alias("open"))
    rows = _keyed(_halves(rows, F.lit(True)))
    while True:
        sizes = rows.where("open > 1").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > large).select("key")
        sizes = written(sizes, "large-groups")
        if sizes.isEmpty():
            return rows
        marked = rows.join(sizes.withColumn("halve", F.lit(True)), "key", "left")
        rows = written(_keyed(_halves(marked, F.col("halve") & (F.col("open") > 1))), "groups")


class PositionIndex:
    """Words of one length, in lanes of 64: a 64-bit set of words for each lane, position and letter."""

    def __init__(self, letters: np.ndarray, lane: np.ndarray, bit: np.ndarray, lanes: int, alphabet: int):
        self.length, self.alphabet = letters.shape[1], alphabet
        self.sets = np.zeros(lanes * self.length * alphabet, np.uint64)
        self.held = np.zeros(lanes, np.uint64)
        place = (lane[:, None] * self.length + np.arange(self.length)) * alphabet + letters
        for b in range(64):  # a lane has one word a bit
            own = bit == b
            self.sets[place[own]] |= np.uint64(1) << np.uint64(b)
            self.held[lane[own]] |= np.uint64(1) << np.uint64(b)

    def _with(self, base: np.ndarray, position: int, letter: np.ndarray) -> np.ndarray:
        return self.sets[base + (position * self.alphabet + letter)]

    def replaced(self, queries: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """Per query (as long as the words) and lane the words that differ from it in exactly one position."""
        base = lane * (self.length * self.alphabet)
        none, one = self.held[lane], np.zeros(len(lane), np.uint64)
        for j in range(self.length):
            with_letter = self._with(base, j, queries[:, j])
            one = (one & with_letter) | (none & ~with_letter)
            none = none & with_letter
        return one

    def shortened(self, queries: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """Per query (one longer than the words) and lane the words that it becomes without one of its letters."""
        base = lane * (self.length * self.alphabet)
        none = self.held[lane]
        one = none.copy()  # the query's first letter left out
        for j in range(self.length):
            none = none & self._with(base, j, queries[:, j])
            one = (one & self._with(base, j, queries[:, j + 1])) | none
        return one


def _bits(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of the bits that are set."""
    rows, bits = [], []
    row = np.flatnonzero(sets)
    left = sets[row]
    while len(row):
        low = left & (~left + np.uint64(1))
        rows.append(row)
        bits.append(np.log2(low.astype(np.float64)).astype(np.int64))
        left = left ^ low
        row, left = row[left != 0], left[left != 0]
    return (np.concatenate(rows), np.concatenate(bits)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def near_pairs(words: list[str], length: int, group: np.ndarray, at: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query, indexed) of near words that count here. words: `length` long, or one longer; group: ascending numbers."""
    own = np.fromiter((len(w) == length for w in words), bool, len(words))
    held = np.bincount(group[own], minlength=int(group[-1]) + 1)
    own &= (np.bincount(group) > 1)[group]
    indexed, longer = np.flatnonzero(own), np.flatnonzero(~own & (held[group] > 0) & np.fromiter((len(w) == length + 1 for w in words), bool, len(words)))
    if not len(indexed):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    held = np.bincount(group[indexed], minlength=len(held))
    lanes = -(-held // 64)
    first_lane, first_word = np.cumsum(lanes) - lanes, np.cumsum(held) - held
    raw = _letters([words[i] for i in indexed.tolist()])
    known, letters = np.unique(raw, return_inverse=True)
    letters = letters.reshape(raw.shape)
    nth = np.arange(len(indexed)) - first_word[group[indexed]]
    lane, bit = first_lane[group[indexed]] + nth // 64, nth % 64
    of_lane = np.empty((int(lanes.sum()), 64), np.int64)
    of_lane[lane, bit] = indexed
    index = PositionIndex(letters, lane, bit, int(lanes.sum()), len(known) + 1)
    queries, partners = [], []
    for rows, walk in ((indexed, index.replaced), (longer, index.shortened)):
        if not len(rows):
            continue
        shown = letters
        own_raw = raw
        if walk == index.shortened:
            own_raw = _letters([words[i] for i in rows.tolist()])
            shown = np.searchsorted(known, own_raw)
            shown[known[np.minimum(shown, len(known) - 1)] != own_raw] = len(known)  # a letter of no indexed word
        times = lanes[group[rows]]
        query = np.repeat(np.arange(len(rows)), times)
        which = np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times) + first_lane[group[rows]][query]
        for k in range(0, len(query), WALK):
            item, bits = _bits(walk(shown[query[k : k + WALK]], which[k : k + WALK]))
            item += k
            q, w = query[item], of_lane[which[item], bits]
            theirs = raw[np.searchsorted(indexed, w)]
            head = own_raw[q][:, :length] != theirs
            tail = own_raw[q][:, own_raw.shape[1] - length :] != theirs
            ahead = np.where(head.any(1), head.argmax(1), length)
            behind = np.where(tail.any(1), tail[:, ::-1].argmax(1), length)
            end = at[w] + open_[w]
            good = (ahead >= at[w]) & (behind >= length - end) & ((ahead < end) | (end == length))
            queries.append(rows[q[good]])
            partners.append(w[good])
    return np.concatenate(queries), np.concatenate(partners)


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def _summed(words: list[str], n: np.ndarray, query: np.ndarray, partner: np.ndarray) -> pa.RecordBatch:
    """Per word of some pair its number of partners and the one of largest n, the first in code-point order among equals."""
    involved = np.unique(np.concatenate((query, partner)))
    rank = np.empty(len(words), np.int64)
    rank[involved[sorted(range(len(involved)), key=lambda i: words[involved[i]])]] = np.arange(len(involved))
    order = np.lexsort((rank[partner], -n[partner], query))
    query, partner = query[order], partner[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    best = partner[first]
    out = [[words[i] for i in query[first].tolist()], np.diff(np.append(first, len(query))), n[best], [words[i] for i in best.tolist()]]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _NEAR)], schema=_NEAR)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of every word's near words, from rows sorted by length and key."""

    def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        words = t.column("word").to_pylist()
        length, key, n, at, open_ = (t.column(c).to_numpy() for c in ("length", "key", "n", "at", "open"))
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (length[1:] != length[:-1]))))
        ends = np.append(starts[1:], len(key))
        a = 0
        while a < len(starts):  # whole groups of one length, as many as a block may hold letters
            b = a + 1
            while b < len(starts) and length[starts[b]] == length[starts[a]] and (ends[b] - starts[a]) * (int(length[starts[a]]) + 1) <= BLOCK:
                b += 1
            s = slice(int(starts[a]), int(ends[b - 1]))
            if b - a < s.stop - s.start:
                group = np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
                q, w = near_pairs(words[s], int(length[s.start]), group, at[s], open_[s])
                if len(q):
                    own = words[s]
                    back = np.fromiter((len(own[i]) for i in q.tolist()), np.int64, len(q)) > int(length[s.start])
                    yield _summed(own, n[s], np.concatenate((q, w[back])), np.concatenate((w, q[back])))
            a = b

    kept = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if kept is None else pa.concat_tables([kept, t])
        if not t.num_rows:
            continue
        length, key = t.column("length").to_numpy(), t.column("key").to_numpy()
        other = np.flatnonzero((key != key[-1]) | (length != length[-1]))
        whole = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if whole:
            yield from block(t.slice(0, whole))
        kept = t.slice(whole)
    if kept is not None and kept.num_rows:
        yield from block(kept)


def near_words(words: DataFrame, large: int = LARGE) -> DataFrame:
    """word, n, n_near, near_n and near (the near word of largest n, the first in code-point order among equals)."""
    ordered = dealt(words, large).repartition("key").sortWithinPartitions("length", "key").select("length", "key", "word", "n", "at", "open")
    found = ordered.mapInArrow(_found, "word string, n_near long, near_n long, near string")
    best = F.struct((-F.col("near_n")).alias("less"), "near")
    parts = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(parts.schema["best"].dataType).alias("best"))
    sums = alone.unionByName(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return sums.select("word", "n", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def with_roots(forms: DataFrame) -> DataFrame:
    """root beside word and form: forms followed to the last, twice as far each round; a form's n is a multiple, so it ends."""
    forms = written(forms, "forms")
    jumps = forms.where("form is not null").select(F.col("word").alias("__from"), F.col("form").alias("__to"))
    while True:
        jumps = written(jumps, "jumps")
        on = jumps.select(F.col("__from").alias("__to"), F.col("__to").alias("__next"))
        longer = jumps.join(on, "__to", "left")
        if longer.where("__next is not null").isEmpty():
            break
        jumps = longer.select("__from", F.coalesce("__next", "__to").alias("__to"))
    found = forms.join(jumps, forms["word"] == jumps["__from"], "left")
    return found.select(*[forms[c] for c in forms.columns], F.coalesce("__to", "word").alias("root"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", large: int = LARGE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs."""
    words = written(vocabulary(marked_runs(docs, doc_id=doc_id, text=text)), "words")
    found = near_words(words, large)
    chosen = F.col("near_n") >= TIMES * F.col("n")
    forms = found.select("word", F.when(chosen, F.col("near")).alias("form"), "n", "n_near", F.when(chosen, F.col("near_n")).alias("form_n"))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
