import duckdb
import pytest

from quillbase import queries, queries_index

NAMES = sorted(n for n in queries.ORACLE_SQL if n in vars(queries_index))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("documents", "labels", "pages", "conversations", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    rows = _rows(got.columns, [tuple(r) for r in got.collect()])
    assert rows[1]
    assert rows == _rows(want.columns, want.fetchall())
