"""Token counts of whole texts, by the whole-token shortcut.

Odd input: a null text is empty and has no bytes and no tokens; other columns pass through; repeated rows are
counted each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenplex.llm.pretokens import ByteBpe, encoder


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(ByteBpe, path).count
        for b in batches:
            n = [count(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "__n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, out: str = "n_tokens") -> DataFrame:
    """The columns in keep (all but the text, if None), n_bytes and n_tokens of each row."""
    kept = [c for c in docs.columns if c != text] if keep is None else keep
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Columns travel by place, so none of the caller's names can clash.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.octet_length(body).cast("long").alias("__n_bytes"), body.alias("__text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("__n_tokens", LongType())])
    done = rows.mapInArrow(_counted(tokenizer), schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("__n_bytes").alias("n_bytes"), F.col("__n_tokens").alias(out))
