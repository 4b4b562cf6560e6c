"""Spelling variants, digests and collocations against brute force on small and odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenplex.llm import collocations, spelling_variants, text_digests

LOWER = {c: c + 32 for c in range(65, 91)}


def documents(spark, texts, langs=("en",)):
    rows = [(i, t, langs[i % len(langs)], -1, "x", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, word string, key int, part int")


# Spelling variants


def marked(texts):
    out = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = crc32(f"{i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(n):
    out = {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, n[w], len(own))
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return sorted((w, f, root(w), k, m, f and n[f]) for w, (f, k, m) in out.items())


def odd_words():
    rng = random.Random(4)
    base = ["".join(rng.choice("abeé") for _ in range(rng.randint(7, 10))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "x" * 3000, "x" * 2999 + "y"]
    words = []
    for k, w in enumerate(base):
        words += [w] * rng.choice((2, 3, 30, 400))
        for _ in range(4):
            i = rng.randrange(len(w))
            words += [w[:i] + rng.choice(["", "ÿ", w[i] + "a"]) + w[i + 1 :]] * rng.choice((2, 2, 25))
    return words + ["chainaaa"] * 2000 + ["chainaab"] * 100 + ["chainabb"] * 4


def test_variants_equal_brute_force(spark):
    words = odd_words()
    random.Random(5).shuffle(words)
    texts = [None, "", "Short Ones 123 ÀÉ", *(" ".join(words[i::40]).replace("abe", "ABe") for i in range(40)), "x" * 20_000]
    got = sorted((tuple(r) for r in spelling_variants.variants(documents(spark, texts)).collect()), key=lambda r: r[0])
    want = variants_by_hand(marked(texts))
    assert got == want and any(r[2] != r[0] and r[2] != r[1] for r in want) and sum(r[4] for r in want) > 40


@pytest.mark.parametrize("large", [1, 7])
def test_halving_large_groups_loses_no_pair(spark, large):
    n = {w: 2 + i for i, w in enumerate(sorted(set(odd_words()) | {f"prefixes{a}{b}" for a in "abcdefgh" for b in "abcdefgh"}))}
    words = spark.createDataFrame([(w, k) for w, k in n.items()], "word string, n long")
    got = {r.word: (r.n_near, r.near) for r in spelling_variants.near_words(words, large).collect()}
    for w in n:
        own = [x for x in n if near(w, x)]
        assert got[w] == (len(own), min(own, key=lambda x: (-n[x], x), default=None)), w


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=7, max_size=8), min_size=2, max_size=150, unique=True))
def test_index_finds_near_words(words):
    own = [w for w in words if len(w) == 7]
    if own:
        at, open_ = np.zeros(len(words), np.int64), np.full(len(words), 7)
        q, w = spelling_variants.near_pairs(words, 7, np.zeros(len(words), np.int64), at, open_)
        want = {(a, b) for a in words for b in own if near(a, b)}
        assert sorted(zip([words[i] for i in q], [words[i] for i in w])) == sorted(want)


def test_chains_of_forms_end_at_their_root(spark):
    rows = [(f"w{i}", f"w{i + 1}" if i < 9 else None) for i in range(10)] + [("alone", None)]
    got = {r.word: r.root for r in spelling_variants.with_roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {f"w{i}": "w9" for i in range(10)} | {"alone": "alone"}


def test_variants_of_nothing(spark):
    for docs in (documents(spark, [None, "", "tiny"]), documents(spark, ["x"]).limit(0)):
        assert spelling_variants.variants(docs).collect() == []


# Digests


def digest_by_hand(data):
    counts = [0] * 128
    padded = data + bytes(4)
    for i in range(len(data)):
        w = padded[i : i + 5]
        for salt, (a, b) in enumerate([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]):
            key = w[4] + (w[a] << 8) + (w[b] << 16) + (salt << 24)
            counts[key * 1640531527 % 2**32 >> 25] += 1
    q = sorted(counts)[31::32][:3]
    body = [sum(c > x for x in q) for c in counts]
    code = 8 * len(data).bit_length() + (int((f"{len(data):b}" + "000")[1:4], 2) if data else 0)
    head = [15 * x // max(q[2], 1) for x in q[:2]]
    return f"{code:04x}{head[0]:x}{head[1]:x}" + "".join(f"{4 * x + y:x}" for x, y in zip(body[::2], body[1::2])), (code, *head), body


def likeness_by_hand(a, b):
    (_, x, own), (_, y, other) = digest_by_hand(a), digest_by_hand(b)
    far = min(24, abs(x[0] - y[0])) + abs(x[1] - y[1]) + abs(x[2] - y[2]) + sum((0, 1, 2, 6)[abs(p - q)] for p, q in zip(own, other))
    return 1 - min(far, 224) / 224


ODD = [None, "", "a", "abcd", "abcde", "é😀ß", "plain words of a text " * 30, "plain words of a text " * 30, "x" * 5000, "\n\t", "other words in another text, longer than the first " * 9]


def test_digests_equal_brute_force(spark):
    got = {r.doc_id: r.fingerprint for r in text_digests.fingerprints(documents(spark, ODD)).collect()}
    assert got == {i: digest_by_hand((t or "").encode())[0] for i, t in enumerate(ODD)}


@pytest.mark.parametrize("parts", [1, 4, 11])
def test_comparison_with_next_equals_brute_force(spark, parts):
    docs = documents(spark, ODD)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = text_digests.compare_with_next(docs.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.doc_id for r in rows) == list(range(len(ODD)))
    texts = [t or "" for t in ODD]
    for r in rows:
        t, following = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == digest_by_hand(t.encode())[0] and r.edited_fingerprint == digest_by_hand(changed.encode())[0]
        assert r.near_edited == pytest.approx(likeness_by_hand(t.encode(), changed.encode())) and r.near_next == pytest.approx(likeness_by_hand(t.encode(), following.encode()))


def test_comparison_of_repeated_ids_one_row_and_none(spark):
    rows = [(None, "null id"), (None, "null id"), (7, "same id"), (7, "other text of the same id"), (7, "same id")]
    got = text_digests.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is not None, r.n_chars) for r in got) == [(False, 7), (False, 7), (True, 7), (True, 7), (True, 25)]
    one = text_digests.compare_with_next(documents(spark, ["only one"])).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(8, 1.0)]
    assert text_digests.compare_with_next(documents(spark, ["x"]).limit(0)).collect() == []


def test_long_texts_are_counted_whole(monkeypatch):
    text = "".join(random.Random(1).choices("abcdefg ", k=5000)).encode()
    monkeypatch.setattr(text_digests, "PIECE", 64)
    assert text_digests.digests([b"", text, b"x", text[:63]]) == [digest_by_hand(t)[0] for t in (b"", text, b"x", text[:63])]


def test_edited_texts_are_likelier_than_others():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 600))) for _ in range(200)]
    shown = text_digests.digests([t.encode() for t in texts])
    changed = text_digests.digests([text_digests.edited(t, x).encode() for t, x in zip(texts, texts[1:] + texts[:1])])
    assert (text_digests.likeness(shown, changed) > text_digests.likeness(shown, shown[1:] + shown[:1])).mean() > 0.99


# Collocations


def collocations_by_hand(texts, langs, least, top):
    n, f = Counter(), defaultdict(Counter)
    for t, lang in zip(texts, langs):
        lang = lang or "und"
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if a >= least and " " in p}
        rows = []
        for p, a in often.items():
            w = p.split(" ")
            if any(f" {p} " in f" {q} " and q != p and own[q] >= a for q in often):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (own[" ".join(w[:c])] * own[" ".join(w[c:])]), c, own[" ".join(w[:c])], own[" ".join(w[c:])]) for c in range(1, len(w)))
            rows.append((-score, -a, p.encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrases():
    rng = random.Random(3)
    words = ["of", "The", "new", "york", "city", "é", "ß", "long" * 30, "a", "b"]
    texts = [None, "", " \t", "...", "One"]
    for _ in range(120):
        t = ""
        for _ in range(rng.randint(1, 40)):
            t += rng.choice(["new york city of the", "of  the\tnew", "a a a", *words]) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "! "])
        texts.append(t)
    return texts


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (20, 7)])
def test_collocations_equal_brute_force(spark, least, top):
    texts = phrases()
    langs = ["en", None, "fr"]
    got = collocations.collocations(documents(spark, texts, langs).repartition(3), least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id", "at"]
    rows = got.collect()
    want = collocations_by_hand(texts, [langs[i % 3] for i in range(len(texts))], least, top)
    assert sorted(tuple(r)[:8] for r in rows) == want and len(want) > 10
    for r in rows:  # the place named holds the phrase
        w = [x for p in re.split(r"[.,;:!?\x0A-\x0D]", texts[r.doc_id].translate(LOWER)) for x in re.findall(r"[^\x20\x09]+", p)]
        assert w[r["at"] :][: len(r.phrase.split(" "))] == r.phrase.split(" ")


def test_long_texts_are_cut_between_pieces(monkeypatch):
    text = ". ".join(t for t in phrases() if t)
    monkeypatch.setattr(collocations, "CHUNK", 50)
    parts = list(collocations._cut(text.encode()))
    assert b"".join(parts) == text.encode() and len(parts) > 20
    whole = collocations.Words([text.encode()], ["en"], [0])
    cut = collocations.Words(parts, ["en"] * len(parts), [0] * len(parts))
    for k in range(1, 6):
        assert Counter(whole.fingerprints(k)[1].tolist()) == Counter(cut.fingerprints(k)[1].tolist())


def test_collisions_do_not_change_counts():
    """With two bits of fingerprint nearly all collide; the strings' counts stay right."""
    texts = [t for t in phrases() if t]

    class Colliding(collocations.Words):
        def of(self, at, k):
            return super().of(at, k) & np.uint64(3)

    w = Colliding([t.encode() for t in texts], ["en"] * len(texts), [0] * len(texts))
    for k in (1, 2, 3):
        where, fp = w.fingerprints(k)
        counts = Counter()
        while len(where):
            one, first, group = np.unique(fp, return_index=True, return_inverse=True)
            alike = w.same(where, where[first][group], k)
            for i, m in zip(where[first].tolist(), np.bincount(group[alike], minlength=len(one)).tolist()):
                counts[w.phrase(i, k)] += m
            where, fp = where[~alike], fp[~alike]
        want = Counter()
        for t in texts:
            for p in re.split(r"[.,;:!?\x0A-\x0D]", t.translate(LOWER)):
                own = re.findall(r"[^\x20\x09]+", p)
                want.update(" ".join(own[i : i + k]).encode() for i in range(len(own) - k + 1))
        assert counts == want


def test_filter_holds_all_its_fingerprints(spark):
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**48, 5000)
    held = collocations.filter_of(spark.createDataFrame([(int(x),) for x in fp], "fp long"))
    assert held.holds(fp.astype(np.uint64)).all() and held.holds(rng.integers(0, 2**48, 20_000).astype(np.uint64)).mean() < 0.05


def test_collocations_of_nothing(spark):
    for docs in (documents(spark, [None, "", "one two"]), documents(spark, ["x"]).limit(0)):
        assert collocations.collocations(docs).collect() == []


def test_ids_of_any_kind(spark):
    texts = ["words and words. " * 3, "words and words", None]
    docs = spark.createDataFrame([(f"d{i}", t, None) for i, t in enumerate(texts)], "doc_id string, text string, lang string")
    rows = collocations.collocations(docs, least=3).collect()
    assert {(r.lang, r.phrase, r.a) for r in rows} == {("und", "words and words", 4)} and rows[0].doc_id in ("d0", "d1")
    assert sorted(r.doc_id for r in text_digests.compare_with_next(docs).collect()) == ["d0", "d1", "d2"]
    assert spelling_variants.variants(docs).collect() == []
