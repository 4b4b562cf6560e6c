"""From raw documents to packed training sequences, in four stages.

Each stage works on all rows that the one before it kept, which it reads from a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenplex.llm import compression_classifier, near_dedup, packing, quality_rules
from lumenplex.llm.common import bound_batches, table, written
from lumenplex.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores as good.

    It learns from the training labels and the documents as they came: the stage before has taken bad ones away.
    """
    bound_batches(spark)
    labels = compression_classifier.training_rows(table(spark, sf_dir, "labels"))
    model = compression_classifier.fit(table(spark, sf_dir, "documents"), labels)
    return compression_classifier.keep_good(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at a similarity of 0.8 or more."""
    bound_batches(spark)
    return near_dedup.keep_first(docs, 80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces with their places in sequences of 2048 tokens."""
    bound_batches(spark)
    pieces = packing.cut_pieces(docs, tokenizer("word_bpe_49k.json"), 0)
    named = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return packing.place(written(named, "pieces"))


STAGES = [("quality_rules", quality), ("quality_classifier", classifier), ("minhash_near_dedup", dedup), ("best_fit_packing", pack)]

#: Compression, hashing and merging are no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
