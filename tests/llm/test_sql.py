"""The subpackage's queries that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from lumenplex.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    theirs = con.sql(queries.oracle_sql()[name]).df()
    ours = queries.queries()[name](spark, DATA).toPandas()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    rows = lambda df: df[cols].convert_dtypes().sort_values(cols).reset_index(drop=True).astype(str)  # noqa: E731, nullable longs alike
    assert rows(ours).equals(rows(theirs))
