import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TEXT = [q for q in entry.text.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "nation", "region", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", TEXT)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
