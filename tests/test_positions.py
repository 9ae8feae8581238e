"""Positions at scale: ranges of any order, slices nobody looks at, and what empty slices give."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import storage
from millrace.functions import int_pow
from millrace.operators import aggregate as agg
from millrace.operators import partition, rows
from millrace.operators.relation import number, relation
from millrace.types import AlgebraError

N = 4_000


@pytest.mark.parametrize("a,b", [("cast(id % 7 as string)", "-id"), ("1", "id"), ("id % 3 = 0", "unhex(lpad(hex(id), 8, '0'))"), ("id % 13", "-id"), ("if(id % 5 > 0, null, id)", "id")])
def test_no_range_is_a_large_part_of_the_table(spark, monkeypatch, a, b):
    monkeypatch.setattr("millrace.operators.relation.ranges_of", lambda df: 20)
    df = spark.range(N).select("id", F.expr(a).alias("a"), F.expr(b).alias("b"))
    held = number(df, ["a", "b"], "p")
    sizes = Counter(r[0] for r in spark.read.parquet(*set(held.inputFiles())).select(F.input_file_name()).collect())
    assert max(sizes.values()) < 4 * N / 20
    got = [r["id"] for r in held.orderBy("p").collect()]
    assert [r["p"] for r in held.orderBy("p").collect()] == list(range(N))
    assert got == [r["id"] for r in df.orderBy(F.col("a").asc_nulls_first(), "b").collect()]


def test_slices_nobody_looks_at_cost_nothing(spark, monkeypatch):
    monkeypatch.setattr("millrace.operators.rows.positioned", lambda rel: pytest.fail("positions were asked for"))
    cut = rows.split(relation(spark.range(100).withColumn("k", F.col("id") % 3), "id"), 7)
    kept = rows.filter_rows(rows.mask(rows.project(cut, id="id", k="k"), F.col("k") > 0), F.col("id") < 50)
    assert agg.two_phase(kept, ["k"], n=("sum", "id")).count() == 2 and kept.to_df().count() == 33
    assert rows.flatten(kept).to_df().count() == 33 and agg.count(kept).first()["n"] == 33


def test_empty_and_masked_slices(spark):
    ten = relation(spark.range(10), "id")
    cut = rows.split(ten, 20, "s")
    assert [r["n"] for r in agg.reduce_slices(cut, "sum", "id", "n").orderBy("s").collect()] == [45] + [0] * 19
    assert [r["n"] for r in agg.reduce_slices(cut, "sum", "id", "n", init=None).orderBy("s").collect()] == [45] + [None] * 19
    assert rows.last_array(cut).to_df().count() == 0
    fives = rows.mask(rows.split(ten, 5, "s"), F.col("id") >= 8)
    assert [r["n"] for r in agg.reduce_slices(fives, "max", "id", "n").orderBy("s").collect()] == [None] * 4 + [9]
    nested = rows.split(rows.split(ten, 2, "a"), 8, "b")
    got = agg.reduce_slices(nested, "sum", "id", "n").orderBy("a", "b").collect()
    assert [r["n"] for r in got] == [10] + [0] * 7 + [35] + [0] * 7
    packed, hist = partition.compact_slices(fives, padding=2)
    assert [r["count"] for r in hist.df.orderBy("bucket").collect()] == [0, 0, 0, 0, 2]
    assert [r["place"] for r in packed.df.orderBy("id").collect()] == [8, 9]
    with pytest.raises(AlgebraError, match="slice levels"):
        partition.compact_slices(nested)


def test_positions_after_a_partition_are_the_new_ones(spark):
    r = rows.rename(rows.positioned(relation(spark.range(20), "id")), True, bucket=F.col("id") % 3)
    placed, _ = partition.partition(r, "bucket", partition.offsets(partition.histogram(r, "bucket", 4)))
    assert all(x["place"] == x["position"] for x in rows.with_position(placed).df.collect())
    apart, _ = partition.partition(r, "bucket", partition.offsets(partition.histogram(r, "bucket", 4)), disjoint=True)
    assert all(x["place"] == x["id"] // 3 for x in apart.df.collect())


def test_powers_are_exact(spark):
    df = spark.createDataFrame([(3, 35), (3, 0), (-2, 63), (0, 0), (10, 18), (None, 2), (2, None)], "a long, b int")
    got = [r["p"] for r in df.select(int_pow(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [3**35, 1, -(2**63), 1, 10**18, None, None]
    with pytest.raises(Exception, match="OVERFLOW"):
        df.limit(1).select(int_pow(F.col("a"), F.col("b") + 10)).collect()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn", "getConf": lambda self: Conf()})()  # noqa: N815

    with pytest.raises(RuntimeError, match="share"):
        storage.shared_dir(Session())


def test_clean_deletes_what_was_written(spark, tmp_path):
    held = storage.materialise(spark.range(5), "x")
    where = held.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert os.path.isdir(where)
    storage.discard(held)
    assert not os.path.exists(where)
