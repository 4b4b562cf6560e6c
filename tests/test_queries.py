"""Every registered query that has SQL gives the rows that DuckDB gives."""

import duckdb
import numpy as np
import pytest

from lumenplex.jobs import dataset_queries, model_queries  # noqa: F401  register their queries
from lumenplex.jobs.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def frame(df):
    cols = sorted(df.columns)
    return df[cols].sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    ours, theirs = frame(QUERIES[name](spark, DATA).toPandas()), frame(db.sql(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for c in ours.columns:
        if ours[c].dtype.kind == "f":
            np.testing.assert_allclose(ours[c].to_numpy(float), theirs[c].to_numpy(float), rtol=0, atol=2e-6)
        else:
            assert (ours[c].astype(str) == theirs[c].astype(str)).all(), c


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
