"""Queries of text operators that SQL can express, against DuckDB."""

import pytest
from silverleaf.llm import queries

from .data import SF

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    if not SF.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, str(SF))
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in at) for r in rel.fetchall())


def test_hashes_in_sql_are_the_librarys():
    import struct

    import xxhash
    from silverleaf.llm import xxh64_sql

    texts = sorted({("ab cé日𝄞x" * 20)[k : k + n] for n in range(100) for k in range(3)})
    con = duckdb.connect()
    con.execute("CREATE TABLE src AS SELECT unnest(?::VARCHAR[]) AS s", [texts])
    got = dict(con.sql(f"WITH {xxh64_sql.strings('made', 'src')} SELECT s, h::UBIGINT FROM made").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t.encode(), xxh64_sql.SEED) for t in texts}
    numbers = [0, 1, 5, (1 << 63) + 9, (1 << 64) - 1]
    con.execute(f"CREATE TABLE n AS SELECT unnest(?::UBIGINT[])::UHUGEINT AS x, {xxh64_sql.SEED}::UHUGEINT AS seed", [numbers])
    got = dict(con.sql(f"WITH {xxh64_sql.longs('made', 'n', 'x', 'x', 'seed')} SELECT x::UBIGINT, h::UBIGINT FROM made").fetchall())
    assert got == {x: xxhash.xxh64_intdigest(struct.pack("<Q", x), xxh64_sql.SEED) for x in numbers}
