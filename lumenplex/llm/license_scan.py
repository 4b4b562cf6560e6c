"""License scans: a positional index of licence words, looked up by the rarest ones.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` of the text with A-Z lower-cased, counted from 0. The index maps
each licence word to its postings, (template, relative position). How many documents hold a licence word is counted
over all documents, in the pass that also reads each text's licence words and their places; a second pass works on
these alone, for the texts that hold all words of some phrase.

Names of licences are found at all of their places: the places of a phrase's words, the rarest first, each less its
relative position, are intersected; what is left are the places where all words stand consecutively.

Licence texts: a template's rarest words, by inverse document frequency, are those without which the rest can't reach
the share that is asked for, even with AGREE - 1 of them (so their number is the template's own, whatever else a text
holds). A text that holds AGREE of them is looked at: where the mandatory phrases stand, every word's places less its
postings' relative positions propose where a copy would start, and starts that AGREE different words propose are
candidates. One is accepted where all mandatory phrases stand word for word within its reach and the words met, by
weight, are LEAST of the template's: a word counts where it stands within SLACK words of its place. What else a text
holds can thus add copies, never hide one. The score is the largest share met, of an accepted template or of a name's sentence.

A name that lies within a longer name gives way to it, unless it is a base phrase. A copy gives way to one of a longer
template that has all its words in order (a third clause added), where that one covers half of it.

Odd input: a text that is null or empty has no words, no places, empty labels and the score 0; rows are scanned
each time they occur; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenplex.llm.common import written
from lumenplex.llm.license_texts import PHRASES, TEMPLATES, Phrase, Template

AGREE, SLACK, LEAST = 3, 24, 0.6

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_ASCII_LOWER))


def vocabulary(phrases: tuple[Phrase, ...], templates: tuple[Template, ...]) -> list[str]:
    """Every word of a licence's name, sentence or text, in order."""
    return sorted({w for p in phrases for w in p.line.split()} | {w for t in templates for w in t.text.split()})


class Index:
    """Postings of licence words and their weights."""

    def __init__(self, frequency: dict[str, int], n_docs: int, phrases: tuple[Phrase, ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES):
        self.phrases, self.templates = phrases, templates
        self.weight = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) + 0.01 for w in vocabulary(phrases, templates)}
        self.keys = [p.key.split() for p in phrases]
        self.lines = [p.line.split() for p in phrases]
        self.texts = [t.text.split() for t in templates]
        self.needs = [[k.split() for k in t.keys] for t in templates]
        self.postings: list[dict[str, np.ndarray]] = []
        for own in self.texts:
            at = defaultdict(list)
            for i, w in enumerate(own):
                at[w].append(i)
            self.postings.append({w: np.array(x) for w, x in at.items()})
        self.rare = [self._rarest(t) for t in range(len(self.texts))]
        self.longer = [[u for u, other in enumerate(self.texts) if len(other) > len(own) and self._in_order(own, other)] for own in self.texts]

    def _rarest(self, t: int) -> list[str]:
        """The fewest rarest words of which a copy that meets LEAST of the weight must hold AGREE."""
        held = {w: self.weight[w] * len(at) for w, at in self.postings[t].items()}
        order = sorted(held, key=lambda w: (-self.weight[w], w))
        rest = total = sum(held.values())
        for n, w in enumerate(order, 1):
            rest -= held[w]
            if rest + sum(sorted((held[x] for x in order[:n]), reverse=True)[: AGREE - 1]) < LEAST * total and n >= AGREE:
                return order[:n]
        return order

    @staticmethod
    def _in_order(own: list[str], other: list[str]) -> bool:
        left = iter(other)
        return all(w in left for w in own)

    def together(self, where: dict[str, np.ndarray], key: list[str]) -> np.ndarray:
        """Where the words of a key stand consecutively, by intersecting their places less their relative positions."""
        if not all(w in where for w in key):
            return np.empty(0, np.int64)
        out = None
        for i in sorted(range(len(key)), key=lambda i: (-self.weight[key[i]], i)):
            starts = where[key[i]] - i
            out = starts if out is None else np.intersect1d(out, starts, assume_unique=True)
            if not len(out):
                break
        return out[out >= 0]

    def shares(self, where: dict[str, np.ndarray], own: list[str], starts: np.ndarray, slack: int) -> np.ndarray:
        """For each start the share, by weight, of a word sequence whose words stand within `slack` of their places."""
        total, got = 0.0, np.zeros(len(starts))
        for i, w in enumerate(own):
            total += self.weight[w]
            if w in where:
                got += self.weight[w] * self._within(where[w], starts + i - slack, starts + i + slack)
        return got / total

    @staticmethod
    def _within(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a place lies from low to high, for each of these."""
        k = np.searchsorted(at, low)
        return (k < len(at)) & (at[np.minimum(k, len(at) - 1)] <= high)

    def copies(self, where: dict[str, np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates for the start of a copy of template t, and their shares."""
        none = np.empty(0, np.int64), np.empty(0)
        if sum(w in where for w in self.rare[t]) < AGREE:
            return none
        needs = [self.together(where, k) for k in self.needs[t]]
        if not all(map(len, needs)):
            return none
        size, proposed = len(self.texts[t]), []
        for w, at in self.postings[t].items():
            if w in where:
                p = where[w]
                p = p[self._within(needs[0], p - size - SLACK, p + size + SLACK)]
                starts = np.unique((p[:, None] - at).ravel())
                for need in needs:
                    starts = starts[self._within(need, starts - SLACK, starts + size + SLACK)]
                proposed.append(starts)
        starts, n = np.unique(np.concatenate(proposed), return_counts=True)
        starts = starts[n >= AGREE]
        return starts, self.shares(where, self.texts[t], starts, SLACK)

    def scan(self, where: dict[str, np.ndarray]) -> tuple[list[tuple[str, bool, int, int]], float]:
        """(label, base, first word, number of words) of what the places of a text's licence words show, and the score."""
        names, found, best = [], set(), 0.0
        for phrase, key, line in zip(self.phrases, self.keys, self.lines):
            starts = self.together(where, key)
            if len(starts):
                ahead = next(i for i in range(len(line)) if line[i : i + len(key)] == key)
                names += [(phrase.label, phrase.base, start, len(key)) for start in starts.tolist()]
                best = max(best, float(self.shares(where, line, starts - ahead, 0).max()))
        # Longer names first where two start alike: a name ends within one that began before it or is hidden by none.
        names.sort(key=lambda n: (n[2], -n[3]))
        reach = (-1, -1)
        for label, base, start, size in names:
            if base or reach[1] < start + size or reach == (start, start + size):
                found.add((label, base, start, size))
            if start + size > reach[1]:
                reach = (start, start + size)
        accepted = {}
        for t in range(len(self.texts)):
            starts, share = self.copies(where, t)
            if (share >= LEAST).any():
                best = max(best, float(share.max()))
                accepted[t] = starts[share >= LEAST], share[share >= LEAST]
        for t, (starts, share) in accepted.items():
            size = len(self.texts[t])
            for u in self.longer[t]:  # covered by half: the longer one's start lies so far before and behind
                if u in accepted:
                    shown = ~self._within(accepted[u][0], starts + (size + 1) // 2 - len(self.texts[u]), starts + size // 2)
                    starts, share = starts[shown], share[shown]
            # Starts that lie within SLACK of each other are one copy: the best of them, the first among equals.
            groups = np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > SLACK) + 1) if len(starts) else []
            found |= {(self.templates[t].label, False, max(int(starts[g[share[g].argmax()]]), 0), size) for g in groups}
        return sorted(found, key=lambda s: (s[2], s[3], s[0], s[1])), min(best, 1.0)


_POSTED = "n_words long, word array<int>, at array<int>, held array<long>"


def _posted(phrases: tuple[Phrase, ...], templates: tuple[Template, ...]):
    """Per text its number of words and, if it holds all words of some key, the places of its licence words; then a row of counts."""
    names = vocabulary(phrases, templates)
    number = {w: i for i, w in enumerate(names)}
    known = frozenset(names)
    keys = {frozenset(k.split()) for k in [p.key for p in phrases] + [k for t in templates for k in t.keys]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(len(names) + 1, np.int64), None
        ints = pa.list_(pa.int32())
        for b in batches:
            kind, n, word, at = b.column(0).type, [], [], []
            for t in b.column(1):
                own = words(t.as_py())
                held = known.intersection(own)
                counts[[number[w] for w in held]] += 1
                n.append(len(own))
                places = [(number[w], p) for p, w in enumerate(own) if w in known] if any(k <= held for k in keys) else None
                word.append(places and [w for w, _ in places])
                at.append(places and [p for _, p in places])
            counts[-1] += len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(word, ints), pa.array(at, ints), pa.nulls(len(n), pa.list_(pa.int64()))], ["key", "n_words", "word", "at", "held"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([None], pa.int64()), pa.nulls(1, ints), pa.nulls(1, ints), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["key", "n_words", "word", "at", "held"])

    return run


def _scanned(index: Index):
    names = sorted(index.weight)
    span = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, scores = [], []
            for word, at in zip(b.column("word"), b.column("at")):
                found, score = [], 0.0
                if word.is_valid:
                    w, p = word.values.to_numpy(), at.values.to_numpy().astype(np.int64)
                    order = np.argsort(w, kind="stable")
                    w, p = w[order], p[order]
                    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                    found, score = index.scan(dict(zip([names[i] for i in w[first].tolist()], np.split(p, first[1:]))))
                spans.append([dict(zip(("label", "base", "word", "words"), s)) for s in found])
                scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_words"), pa.array(spans, span), pa.array(scores, pa.float64())], ["key", "n_words", "spans", "score"])

    return run


def scan_licenses(docs: DataFrame, phrases: tuple[Phrase, ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (label, base, first word, number of words) and score of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("key"), F.col(f"`{text}`").alias("text"))
    posted = written(rows.mapInArrow(_posted(phrases, templates), f"key {kind}, {_POSTED}"), "license-postings")
    names = vocabulary(phrases, templates)
    counts = posted.where("held is not null").select(F.posexplode("held").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    held = {r["i"]: r["n"] for r in counts.collect()}  # a row per licence word
    index = Index({w: held.get(i, 0) for i, w in enumerate(names)}, held.get(len(names), 0), phrases, templates)
    spans = "array<struct<label:string,base:boolean,word:bigint,words:int>>"
    found = posted.where("held is null").select("key", "n_words", "word", "at").mapInArrow(_scanned(index), f"key {kind}, n_words long, spans {spans}, score double")
    return found.withColumnRenamed("key", doc_id)
