"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

import datetime
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")

duckdb = pytest.importorskip("duckdb")


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def _names():
    from silverleaf.queries import QUERIES

    return sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    if not SF.exists():
        pytest.skip("no test tables here")
    made = duckdb.connect()
    for p in SF.glob("*.parquet"):
        made.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return made


@pytest.mark.parametrize("name", _names())
def test_query_agrees_with_sql(spark, con, name):
    from silverleaf.queries import ORACLE_SQL, QUERIES

    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert rows == sorted((tuple(_plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
