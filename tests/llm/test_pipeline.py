"""The pipeline's stages, each against its own input."""

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenplex.llm import compression_classifier, near_dedup, quality_rules
from lumenplex.llm.common import BATCH_BOUND, BATCH_BYTES, ROW, table
from lumenplex.llm.queries import tokenizer

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in left.collect()}
        left = corpus_pipeline.written(stage(spark, left, DATA), name)
        after = {r.doc_id for r in left.collect()}
        assert left.columns == docs.columns and after <= before, name
        assert after != before or name == "quality_classifier", name  # the rules leave it little here
    groups = near_dedup.near_groups(left, 80)
    assert groups.where("not kept").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, left, DATA).collect()
    assert {r.doc_id for r in packed} == after
    filled = Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(texts) > len(after)


def test_run_equals_its_stages(spark):
    """The documents that brute force keeps, cut and packed as the library and one-by-one best fit do it."""
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = table(spark, DATA, "documents")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        left = corpus_pipeline.written(stage(spark, left, DATA), name)
    good = quality_rules.apply_rules(docs).where("kept").select(f"{ROW}.*")
    labels = compression_classifier.training_rows(table(spark, DATA, "labels"))
    score = compression_classifier.fit(docs, labels).scorer()
    texts = {r.doc_id: r.text for r in good.collect() if score(r.text) >= 0.3}
    assert {r.doc_id: r.text for r in left.collect()} == texts
    kept = kept_by_brute_force([(i, t or "") for i, t in texts.items()], 80)

    encode = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = {}
    for i, text in kept:
        ids = [*encode.encode(text, add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[i, piece] = (start, len(part), crc32(np.array(part, "<u4").tobytes()))
    found = rows.collect()
    assert len(found) == len(want) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want
    room = []  # best fit decreasing, one by one
    for n in sorted((n for _, n, _ in want.values()), reverse=True):
        fits = [k for k, x in enumerate(room) if x >= n]
        k = min(fits, key=lambda k: room[k], default=None)
        if k is None:
            room.append(2048 - n)
        else:
            room[k] -= n
    filled = {}
    for r in found:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(filled) == len(room)
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def kept_by_brute_force(rows, percent):
    """Of each group of rows (id, text) linked by the exact similarity of their sets of five words, the least id."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min(r for r, h, s in zip(rows, group, sets) if h == g) for g in sorted(set(group))]


def test_dedup_stage_equals_brute_force(spark):
    docs = table(spark, DATA, "documents").where("text is not null")
    want = kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()], 80)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup(spark, docs, DATA).collect()) == sorted(i for i, _ in want)


def test_dedup_stage_keeps_unique_rows_of_repeated_ids(spark):
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, line(0)), (2, line(0)), (2, line(1)), (2, line(2)), (3, line(3)), (3, line(3)), (3, line(2)), (4, line(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.dedup(spark, docs, DATA).collect()))
    assert got == sorted(kept_by_brute_force(rows, 80)) == [(1, line(0)), (2, line(1)), (2, line(2)), (3, line(3)), (4, line(4))]


def test_dedup_stage_keeps_rows_that_differ_in_a_map(spark):
    docs = spark.sql("select 1L as doc_id, '' as text, map('a', 1) as m union all select 1L, '', map('a', 2) union all select 2L, 'x y', map('b', 1) union all select 2L, 'x y', map('b', 2)")
    got = sorted((r.doc_id, r.text, str(r.m)) for r in corpus_pipeline.dedup(spark, docs, DATA).collect())
    assert [g[:2] for g in got] == [(1, ""), (1, ""), (2, "x y")] and got[0][2] != got[1][2]


@pytest.mark.parametrize("stage", ["quality_classifier", "minhash_near_dedup", "best_fit_packing"])
def test_stages_hand_bounded_batches_to_python(spark, stage):
    """Tasks hold a few megabytes of rows beside their heap, however long the texts are; a session's own bound stays."""

    def batch_bytes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))  # 20 MB in one task
    docs = table(spark, DATA, "documents").limit(20)
    largest = lambda: max(r.n for r in texts.mapInArrow(batch_bytes, "n long").collect())
    spark.conf.unset(BATCH_BOUND)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, docs, DATA)
        assert largest() <= BATCH_BYTES + 10_000
        spark.conf.set(BATCH_BOUND, str(BATCH_BYTES // 4))
        dict(corpus_pipeline.STAGES)[stage](spark, docs, DATA)
        assert largest() <= BATCH_BYTES // 4 + 10_000
    finally:
        spark.conf.unset(BATCH_BOUND)


def test_classifier_stage_sends_texts_alone_to_python(spark):
    """Rows wait in Spark for their texts' scores: null texts and columns of any name and type stay as they are."""
    docs = spark.sql("select 1L as doc_id, cast(null as string) as text, map('a', 1) as m, 2 as score, 3 as `__score`, 4 as `a.b` union all select 2L, 'of the good', map('b', 2), 5, 6, 7")
    model = compression_classifier.Model(b"of the good words" * 9, b"$ | # % bad" * 9, -1.0, 0.0)
    left = compression_classifier.keep_good(docs, model)
    assert left.columns == docs.columns and {r.doc_id: (r.m, r.score, r["__score"], r["a.b"]) for r in left.collect()} == {1: ({"a": 1}, 2, 3, 4), 2: ({"b": 2}, 5, 6, 7)}
    assert {r.doc_id for r in compression_classifier.keep_good(docs, model, threshold=0.5001).collect()} == {2}
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
