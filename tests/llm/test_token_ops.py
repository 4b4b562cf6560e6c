"""Token operators against the tokenizers' own libraries on whole texts, and exact round trips."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenplex.llm import near_dedup, packing, piece_codec, pretokens, queries, token_counts, token_files
from lumenplex.llm.common import written
from lumenplex.llm.pretokens import ByteBpe, Pieces, WordBpe, stretches

DATA = "/root/testdata/sf0.001"
ODD = [
    None,
    "",
    " ",
    "\n",
    "a",
    "Hello,  world!  ",
    " leading and trailing ",
    "it's we'll I'M THEY'RE 'sit",
    "tabs\tand\r\nlines\n\n\nend\n",
    "no break   space   x",
    "日本語のテキスト and русский текст",
    "é vs é, ÀÉÎ ß ÿ × ÷ ª º ² ½ µ",
    "<|endoftext|> a <|startoftext|> b <s> </s> <unk>",
    "▁marker▁inside ▁",
    "x\x00y\x1cz\x85w",
    "🙂🙃 emoji 👩‍👩‍👧",
    "12345 6.7.8 a1b2 ###!!! --- ...",
    "word " * 3000 + "end",
    "q" * 20000,
    "İstanbul ǅ ŉ ŸŽ",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "n", "c") for i, t in enumerate(ODD)] + [(3, "again", "n", "c"), (3, "again", "n", "c"), (None, "no id", "n", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string")


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    return (
        Tokenizer.from_file(p.path("word_bpe_49k.json")),
        Tokenizer.from_file(p.path("byte_bpe_50k.json")),
        sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model")),
    )


@pytest.fixture(scope="module")
def encoders():
    return WordBpe(queries.tokenizer("word_bpe_49k.json")), ByteBpe(queries.tokenizer("byte_bpe_50k.json")), Pieces(queries.tokenizer("piece_bpe_32k.model"))


def same(text, libraries, encoders):
    (word, byte, piece), (w, b, p) = libraries, encoders
    assert np.frombuffer(w.encode(text), "<u4").tolist() == word.encode(text, add_special_tokens=False).ids
    assert b.count(text) == len(byte.encode(text, add_special_tokens=False).ids)
    ids, shown = p.encode(text)
    assert ids == piece.encode(text) and shown == ",".join(map(str, ids)) and p.decode(ids) == piece.decode(piece.encode(text))


@pytest.mark.parametrize("text", [t or "" for t in ODD])
def test_encoders_equal_the_libraries(text, libraries, encoders):
    assert all(e.known for e in encoders)
    same(text, libraries, encoders)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcXYZéÀßñ'srtvemld  \n\t.,!?#|<0123_-"), max_size=60))
def test_encoders_equal_the_libraries_on_any_text(libraries, encoders, text):
    same(text, libraries, encoders)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["word", "It's", "x", "’", "don’t", "“quoted”", "—", "日本", "a日", "e\u0301", "\u0301", "<|endoftext|>", "<s>", "<", "...", "…", "🙂", "\u3000", "\u200b", "Straße", " ", "", "\n", "\t", "7", "ǅ"]), max_size=14))
def test_encoders_equal_the_libraries_around_odd_signs(libraries, encoders, parts):
    same(" ".join(parts), libraries, encoders)
    same("plain words before " + " ".join(parts) + " and plain words after", libraries, encoders)


def together(encoder, texts):
    """The ids of each text, without the end id, as encode_all gives them."""
    out = []
    for ids, n in encoder.encode_all(pa.array(texts, pa.string()), 7):
        assert ids.dtype == np.uint32 and n.sum() == len(ids)
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert [x.pop() for x in out] == [7] * len(texts)
    return out


@pytest.mark.parametrize("size", [1, 200, 8 << 20])
def test_texts_encoded_together_equal_the_library(libraries, encoders, monkeypatch, size):
    monkeypatch.setattr(pretokens, "RUN_BYTES", size)
    texts = [*ODD, *reversed(ODD), "'s", "s", "'", "t'", "x'S'T'", "''s '", " ", "\n\n", "ÿ", "À", "'l", "l", "'r", "e", "a×b", "a÷b", "<", "|", "end\r"]
    assert together(encoders[0], texts) == [libraries[0].encode(t or "", add_special_tokens=False).ids for t in texts]
    assert together(WordBpe(queries.tokenizer("word_bpe_49k.json"), 3), texts) == together(encoders[0], texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcXYZéÀßÞ×'srtvemld  \n\t.,!?<|0123_-’日"), max_size=30), max_size=8))
def test_any_texts_encoded_together_equal_the_library(libraries, encoders, texts):
    assert together(encoders[0], texts) == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_looked_up_once_for_many_texts():
    w = WordBpe(queries.tokenizer("word_bpe_49k.json"))

    class Counted(type(w.table)):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    w.table = Counted(w.library.model.tokenize, 100)
    assert len(together(w, ["Three little words", "little words, three"] * 500)) == 1000
    assert Counted.asked == 4  # the comma is the fourth


def test_only_what_is_around_an_odd_sign_goes_to_the_library():
    text = "one two three’s four five <| six seven"
    parts = stretches(text, re.compile(r"’|<\|"))
    assert parts == [(False, "one two"), (True, " three’s"), (False, " four five"), (True, " <|"), (False, " six seven")]


def test_proven_tokens_are_single(libraries, encoders):
    whole = encoders[1].whole
    assert len(whole) > 30000
    for w in list(whole)[::500]:
        assert len(libraries[1].encode(w, add_special_tokens=False).ids) == 1


def test_small_tables_give_the_same(libraries):
    w, b, p = (k(queries.tokenizer(f), 3) for k, f in ((WordBpe, "word_bpe_49k.json"), (ByteBpe, "byte_bpe_50k.json"), (Pieces, "piece_bpe_32k.model")))
    for text in ("one two three four five six", "seven eight one two nine", "ten one"):
        same(text, libraries, (w, b, p))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    x = np.array(values, np.uint64)
    assert token_files.unpack_words(token_files.pack_words(x), len(x)).tolist() == values


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=200))
def test_simple8b_takes_as_many_as_fit(values):
    want, i = [], 0
    while i < len(values):
        s = next((s for s, (n, bits) in enumerate(token_files.PACKING) if all(v < 1 << bits for v in values[i : i + n])), token_files.ESCAPE)
        if s == token_files.ESCAPE:
            want += [s << 60, values[i]]
            i += 1
        else:
            n, bits = token_files.PACKING[s]
            want.append(s << 60 | sum(v << k * bits for k, v in enumerate(values[i : i + n])))
            i += n
    assert token_files.pack_words(np.array(values, np.uint64)).tolist() == want


def test_simple8b_packs_small_ids_densely():
    assert len(token_files.pack_words(np.ones(600, np.uint64))) == 10


def test_token_files(spark, odd, libraries):
    blocks = token_files.write_blocks(odd, queries.tokenizer("word_bpe_49k.json"), 1)
    got = token_files.read_blocks(blocks).orderBy("start").collect()
    hashed = odd.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text or ""))
    start = 0
    assert len(got) == len(order)
    for g, r in zip(got, order):
        ids = libraries[0].encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, start, len(ids)) and np.frombuffer(g.ids, "<u4").tolist() == ids
        start += len(ids)


def test_token_files_of_nothing(spark, odd):
    blocks = token_files.write_blocks(odd.limit(0), queries.tokenizer("word_bpe_49k.json"), 1)
    assert token_files.read_blocks(blocks).count() == 0


def test_counts_keep_columns(spark, odd, libraries):
    got = token_counts.count_tokens(odd, queries.tokenizer("byte_bpe_50k.json"), keep=["doc_id", "ids"]).collect()
    assert len(got) == odd.count() and {r.ids for r in got} == {"c"}
    want = sorted(((r.doc_id is not None, r.doc_id or 0), len((r.text or "").encode()), len(libraries[1].encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in got) == want


def test_codec(spark, odd, libraries):
    got = {r.doc_id: r for r in piece_codec.encode_decode(odd, queries.tokenizer("piece_bpe_32k.model")).collect() if r.doc_id not in (3, None)}
    for i, t in enumerate(ODD):
        if i != 3:
            ids = libraries[2].encode(t or "")
            assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(ids), ",".join(map(str, ids)), libraries[2].decode(ids) if ids else "")


def brute_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_equals_one_by_one(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, n = packing.best_fit(counts, 30)
    room = [30] * n
    for length, rank, first, per, offset in runs.tolist():
        until = min([r[1] for r in runs.tolist() if r[0] == length and r[1] > rank], default=counts[length])
        for k in range(until - rank):
            i = first + k // per
            assert room[i] == 30 - (offset + k % per * length)
            room[i] -= length
    assert sorted(room) == brute_best_fit(lengths, 30)


def test_packing_is_whole_and_gapless(spark, odd):
    pieces = queries.written(packing.cut_pieces(odd, queries.tokenizer("word_bpe_49k.json"), 0, 64), "pieces")
    rows = packing.place(pieces, 64).collect()
    assert len(rows) == pieces.count() and len({r.doc_id for r in rows}) == len(ODD) + 1
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 64
    assert packing.place(pieces.limit(0), 64).count() == 0


def test_registered_queries(spark, libraries):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    encoded = [libraries[0].encode(t, add_special_tokens=False).ids for _, t in docs]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = {r.doc_id: r for r in queries.op3_token_files(spark, DATA).collect()}
    start = 0
    for (i, _), ids in zip(docs, encoded):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids) + 1, crc(ids + [1]))
        start += len(ids) + 1
    rows = queries.op9_best_fit_packing(spark, DATA).collect()
    want = {(i, k): (a, min(2048, len(x) + 1 - a), crc((x + [0])[a : a + 2048])) for (i, _), x in zip(docs, encoded) for k, a in enumerate(range(0, len(x) + 1, 2048))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len({r.sequence_id for r in rows}) <= 1.03 * sum(w[1] for w in want.values()) / 2048 + 1
    counts = queries.op6_token_counts(spark, DATA)
    assert counts.where(F.col("over_limit") != (F.col("n_tokens") > 512)).isEmpty() and counts.count() == len(docs)


def test_ids_of_any_kind(spark):
    rows = [(f"doc-{i:02d}", t) for i, t in enumerate(["one two", "three", None, "four five six", "one two"])]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    path = queries.tokenizer("word_bpe_49k.json")
    read = token_files.read_blocks(token_files.write_blocks(docs, path, 1)).orderBy("start").collect()
    assert [r.doc_id for r in read] == [i for i, _ in rows]
    placed = packing.place(written(packing.cut_pieces(docs, path, 0), "pieces")).collect()
    assert sorted(r.doc_id for r in placed) == [i for i, _ in rows]
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    assert groups == {"doc-00": "doc-00", "doc-01": "doc-01", "doc-02": "doc-02", "doc-03": "doc-03", "doc-04": "doc-00"}
    assert sorted(r.doc_id for r in near_dedup.keep_first(docs).collect()) == ["doc-00", "doc-01", "doc-02", "doc-03"]
