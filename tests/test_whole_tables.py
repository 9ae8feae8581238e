"""Queries that take every row of a table, on a table where a range of ids holds only part of them."""

from pathlib import Path

import duckdb
import pytest
from test_queries import rows

from millrace import queries

FOLDER = "/root/testdata/sf0.01"
COMBINERS = [f"{kind}_{op}" for kind in ("group", "reduce") for op in ("sum", "product", "min", "max", "and", "or")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def same(spark, duck, name):
    df = queries.queries()[name](spark, FOLDER)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", COMBINERS)
def test_combiners_take_every_line(spark, duck, name):
    assert "WHERE" not in queries.oracle_sql()[name]
    same(spark, duck, name)


def test_bag_build_takes_every_part(spark, duck):
    same(spark, duck, "join_bag_build")
    held = duck.sql("SELECT count(*) FROM lineitem JOIN part ON l_partkey // 40 = p_partkey // 40 AND l_linenumber = p_size WHERE p_partkey >= 40").fetchall()[0][0]
    repeated = duck.sql("SELECT count(*) FROM (SELECT p_partkey // 40, p_size FROM part GROUP BY ALL HAVING count(*) > 1)").fetchall()[0][0]
    assert held > 0 and repeated > 0
