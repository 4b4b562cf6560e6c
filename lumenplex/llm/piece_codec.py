"""SentencePiece encoding and decoding of whole texts, by a table of distinct marked words.

Odd input: a null text is empty, with no ids and an empty decoded text; repeated rows are encoded each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenplex.llm.pretokens import Pieces, encoder


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(Pieces, path)
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column(1):
                own, shown = codec.encode(t.as_py())
                n.append(len(own))
                ids.append(shown)
                back.append(codec.decode(own) if own else "")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["key", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (decimal, joined by commas) and decoded, the text that the ids decode to."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_coded(model), f"key {kind}, n_tokens long, ids string, decoded string").withColumnRenamed("key", key)
