"""Encoders that look whole pre-tokens up and leave the rest to the tokenizers' own libraries.

A pre-token's ids don't depend on its neighbours, so each distinct one is merged once per worker and kept in
a bounded table; of many texts together, each distinct one is looked up once. Characters for which the pre-token pattern here isn't proven equal to the library's (all beyond
ASCII and the Latin-1 letters), and a special token's opening, go to the library with what stands around them up to
the next single spaces between printable ASCII characters: no pre-token of any of these tokenizers crosses such a
space, and neither does Unicode normalisation. The rest of the text is looked up.
"""

from __future__ import annotations

import json
import os
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pre-tokens kept at once in one worker; the table restarts when it is full.
TABLE_LIMIT = 400_000

#: Bytes of the texts whose words are looked up together, with one text more at most. More share more words; a task holds several arrays as long.
RUN_BYTES = 2 << 20

_BEYOND = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")
_UNUSUAL = re.compile(_BEYOND.pattern + r"|<\|")
#: A space that no pre-token crosses; one begins with it or after it.
_SEAM = re.compile(r"(?<=[!-~]) (?=[!-~])")


def stretches(text: str, odd: re.Pattern) -> list[tuple[bool, str]]:
    """The text cut at seams into stretches that hold something odd (True) and stretches that don't, each with its leading space."""
    found = [m.start() for m in odd.finditer(text)]
    if not found:
        return [(False, text)]
    cuts = [0, *(m.start() for m in _SEAM.finditer(text)), len(text)]
    out, done = [], 0
    for p in found:
        if p < done:
            continue
        k = bisect_right(cuts, p)
        start, stop = cuts[k - 1], cuts[min(k, len(cuts) - 1)]
        if start > done:
            out.append((False, text[done:start]))
        if out and out[-1][0]:
            out[-1] = (True, out[-1][1] + text[start:stop])
        else:
            out.append((True, text[start:stop]))
        done = stop
    if done < len(text):
        out.append((False, text[done:]))
    return out


#: What the library may segment otherwise than word by word.
_ODD_PIECES = re.compile(_UNUSUAL.pattern + "|<|^ | $|  ")
_UPPER, _LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"

#: What word_bpe tokenizers do before merging, as their file states it: fixed values.
_WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LOWER}]+|[0-9]|[^\s{_LOWER}0-9]+")
_LETTERS = _UPPER + _LOWER
_BYTE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_file(path), json.load(f)


def _spelling() -> dict[int, str]:
    """Characters as byte-level models spell them, asked of the library."""
    from tokenizers import pre_tokenizers

    spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: spell.pre_tokenize_str(chr(c))[0][0] for c in (*range(9, 14), *range(32, 127), *range(0xC0, 0x100))}


_ID = attrgetter("id")


class _Merged(dict):
    """Words to their ids as bytes; a word that isn't there yet is merged. A full table starts again."""

    def __init__(self, merge, limit: int):
        super().__init__()
        self.merge, self.limit, self.spelling = merge, limit, _spelling()

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
        ids = [*map(_ID, self.merge(word if word.isascii() else word.translate(self.spelling)))]
        self[word] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found


def _by_byte(pattern: str) -> np.ndarray:
    """Which of the 256 bytes, as Latin-1 characters, are in the pattern's set."""
    return np.array([bool(re.fullmatch(pattern, chr(c), re.DOTALL)) for c in range(256)])


#: Bytes of UTF-8: those of characters that the word pattern here knows (C3 opens À to ÿ), and their kinds. Letters beyond ASCII are C3 and what follows it.
_KNOWN = _by_byte(r"[\t-\r -~\x80-\xbf\xc3]")
_KIND = (_by_byte(r"[a-z\x80-\xbf\xc3]") + 2 * _by_byte("[0-9]") + 3 * _by_byte(r"[!-/:-@\[-`{-~]")).astype(np.int8)
_SMALL = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _joined(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a line end after each, some more at the end, and where texts begin, and the last one's end."""
    first = np.cumsum([0, *(len(x) + 1 for x in data)])
    return np.frombuffer(b"\n".join([*data, b"\n\n\n"]), np.uint8), first


def _unusual_texts(data: list[bytes]) -> list[int]:
    """The texts that hold what _UNUSUAL finds."""
    b, first = _joined(data)
    odd = ~_KNOWN[b]
    odd[:-1] |= (b[:-1] == 0x3C) & (b[1:] == 0x7C)  # <|
    odd[:-1] |= (b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7))  # the signs for times and divided by
    return np.unique(np.searchsorted(first, np.flatnonzero(odd), side="right") - 1).tolist()


def _cut_words(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts without anything unusual in small letters, joined; where each begins; where words, and white space between them, are cut as by _WORD."""
    b, first = _joined(data)
    opens = b == 0xC3
    b = _SMALL[b]
    b[1:] += (opens[:-1] & (b[1:] < 0x9F)).view(np.uint8) << 5
    kind = _KIND[b]
    cut = kind == 2  # a digit is a word
    cut[0] = True
    cut[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(b == 0x27)
    at = at[cut[at]]  # a quote that is not within other signs
    one, two = b[at + 1], b[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
    cut[at[short | long] + 1] = False
    cut[at[short] + 2] = True
    cut[at[long] + 3] = True
    return b, first, np.append(np.flatnonzero(cut), len(b)).astype(np.int32)


class WordBpe:
    """ids of whole texts as little-endian 32-bit bytes, for lower-casing BPE with word ends."""

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        self.library, spec = _load(path)
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.known = spec["normalizer"] == _WORD_STEPS["normalizer"] and split[0].get("pattern") == {"Regex": _WORD_STEPS["split"]}
        self.table = _Merged(self.library.model.tokenize, limit)

    def encode(self, text: str) -> bytes:
        if not self.known:
            return self._whole(text)
        if "<|" in text or _BEYOND.search(text):
            return b"".join(self._whole(x) if odd else self._looked_up(x) for odd, x in stretches(text, _UNUSUAL))
        return self._looked_up(text)

    def encode_all(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of whole texts in their order: the ids of a run's texts, each with end_id after it, and how many ids each has."""
        upto = np.cumsum([0, *pc.fill_null(pc.binary_length(texts), 0).to_pylist()])
        at = 0
        while at < len(texts):
            stop = int(np.searchsorted(upto, upto[at] + RUN_BYTES))
            ids, n = self._run([x or b"" for x in texts[at:stop].cast(pa.binary()).to_pylist()])
            yield np.insert(ids, np.cumsum(n), end_id), n + 1
            at = stop

    def _run(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        aside = {i: self.encode(data[i].decode()) for i in (_unusual_texts(data) if self.known else range(len(data)))}
        if aside:
            data = [b"" if i in aside else x for i, x in enumerate(data)]
        lowered, first, cuts = _cut_words(data)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(lowered)).dictionary_encode()
        table = self.table
        found = [b"" if w.isspace() else table[w] for w in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        n = np.array([*map(len, found)], np.int32) // 4
        place, which = np.cumsum(n, dtype=np.int32) - n, pieces.indices.to_numpy()
        each = n[which]
        ends = np.cumsum(each, dtype=np.int32)
        ids = np.frombuffer(b"".join(found), "<u4")[np.arange(ends[-1], dtype=np.int32) + np.repeat(place[which] - ends + each, each)]
        # White space has no ids, so it doesn't matter that a text's own may go with the sign before the text.
        starts = np.append(0, ends)[np.searchsorted(cuts, first)]
        if not aside:
            return ids, np.diff(starts)
        raw, bounds = ids.tobytes(), (4 * starts).tolist()
        parts = [aside[i] if i in aside else raw[bounds[i] : bounds[i + 1]] for i in range(len(data))]
        return np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts])

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _looked_up(self, text: str) -> bytes:
        return b"".join(map(self.table.__getitem__, _WORD.findall(text.lower())))


class ByteBpe:
    """Token counts of whole texts for byte-level BPE.

    Vocabulary strings that the model encodes alone as one token are proven so when the encoder is built;
    a pre-token among them counts one, and only the others are merged.
    """

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        self.library, spec = _load(path)
        pre = spec["pre_tokenizer"] or {}
        self.known = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and bool(pre.get("use_regex"))
        self.spelling, self.limit = _spelling(), limit
        self.whole = self.prove() if self.known else {}
        self.counts = dict(self.whole)

    def prove(self) -> dict[str, int]:
        """Raw strings that encode alone as one token, each with the count 1."""
        raw = {s: chr(c) for c, s in self.spelling.items() if len(s) == 1}
        back = {ord(k): v for k, v in raw.items()}
        pairs = {s: chr(c) for c, s in self.spelling.items() if len(s) == 2}
        lead = {s[0] for s in pairs}
        out = {}
        for spelled, i in self.library.get_vocab(with_added_tokens=False).items():
            text = spelled
            if any(c in text for c in lead):
                for s, c in pairs.items():
                    text = text.replace(s, "\0" + c)
            plain = "".join(c if p == "\0" else back.get(ord(c), "\1") for p, c in zip(" " + text, text) if c != "\0")
            if "\1" in plain or plain.translate(self.spelling) != spelled:
                continue  # bytes that are no whole characters of the proven kind
            merged = self.library.model.tokenize(spelled)
            if len(merged) == 1 and merged[0].id == i:
                out[plain] = 1
        return out

    def count(self, text: str) -> int:
        if not self.known:
            return self._whole(text)
        if _UNUSUAL.search(text):
            return sum(self._whole(x) if odd else self._looked_up(x) for odd, x in stretches(text, _UNUSUAL))
        return self._looked_up(text)

    def _whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _looked_up(self, text: str) -> int:
        words = _BYTE.findall(text)
        try:
            return sum(map(self.counts.__getitem__, words))
        except KeyError:
            if len(self.counts) > self.limit + len(self.whole):
                self.counts = dict(self.whole)
            merge, spelling, counts = self.library.model.tokenize, self.spelling, self.counts
            for w in set(words):
                if w not in counts:
                    counts[w] = len(merge(w.translate(spelling)))
            return sum(map(counts.__getitem__, words))


class Pieces:
    """SentencePiece ids by distinct marked words.

    No piece of the model holds a marker after another character (checked when built), so merges never cross
    from one word into the next word's marker: each distinct marked word is segmented once, and the ids are
    joined back by position.
    """

    MARK = "▁"

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.vocab_size()))
        self.known = not any(self.MARK in p.lstrip(self.MARK) for p in pieces) and self.library.encode_as_pieces("a a")[1:] == [self.MARK + "a"]
        self.limit, self.ids, self.shown = limit, {}, {}

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same in decimal, joined by commas."""
        if not text:
            return [], ""
        if not self.known:
            return self._whole(text)
        if _ODD_PIECES.search(text):
            # A stretch's marker is its first word's own, which the library adds: the space at the seam goes.
            parts = [(self._whole if odd else self._looked_up)(x[1:] if i else x) for i, (odd, x) in enumerate(stretches(text, _ODD_PIECES))]
            return [i for ids, _ in parts for i in ids], ",".join(shown for _, shown in parts if shown)
        return self._looked_up(text)

    def _whole(self, text: str) -> tuple[list[int], str]:
        ids = self.library.encode(text, num_threads=1)
        return ids, ",".join(map(str, ids))

    def _looked_up(self, text: str) -> tuple[list[int], str]:
        words = text.split(" ")
        if not self.ids.keys() >= (distinct := set(words)):
            if len(self.ids) > self.limit:
                self.ids.clear()
                self.shown.clear()
            new = [w for w in distinct if w not in self.ids]
            for w, ids in zip(new, self.library.encode(new, num_threads=1)):
                self.ids[w] = ids
                self.shown[w] = ",".join(map(str, ids))
        out: list[int] = []
        for ids in map(self.ids.__getitem__, words):
            out += ids
        return out, ",".join(map(self.shown.__getitem__, words))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=4)
def encoder(kind: type, path: str):
    """One encoder of each kind and file in a worker, kept over tasks."""
    return kind(path)
