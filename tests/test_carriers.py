"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from strataspark.plans import audits, carriers, files, shapes  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def rows(df, columns):
    return sorted(str(tuple(None if v != v else float(v) if isinstance(v, int) else v for v in r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(carriers.ORACLE))
def test_matches_duckdb(spark, data, duck, name):
    ours = carriers.QUERIES[name](spark, data).toPandas()
    theirs = duck.sql(carriers.ORACLE[name]).df()
    assert sorted(ours) == sorted(theirs)
    columns = sorted(ours)
    assert len(ours) == len(theirs)
    assert rows(ours, columns) == rows(theirs, columns)
