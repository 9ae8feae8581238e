"""Keys that hold a large part of all rows: dealt to several places, with the same results."""

from collections import Counter

from pyspark.sql import functions as F
from test_pairs import roots

from millrace.llm.common import materialise, running_total, salted_join, sampled
from millrace.llm.components import connected_components


def test_salted_joins_give_what_joins_give(spark):
    rows = spark.range(6_000).withColumn("k", F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 40))
    values = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("k <> 5")
    for how in ("inner", "left"):
        want = sorted((r["id"], r["least"]) for r in rows.join(values, "k", how).collect())
        joined = salted_join(rows, values, "k", ["id"], how=how)
        assert joined.columns == ["k", "id", "least"] and sorted((r["id"], r["least"]) for r in joined.collect()) == sorted(want)
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        at = salted_join(rows, values, "k", ["id"]).select(F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(Counter(r["p"] for r in at).values()) < 600


def test_components_of_hubs(spark):
    """A node with many smaller neighbours, one with many greater ones, and a path between them."""
    links = [(5_000, k) for k in range(1_000, 1_400)] + [(1, k) for k in range(2_000, 2_400)] + [(5_000, 6_000), (6_000, 900), (900, 2_000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots({x for p in links for x in p}, links) and set(got.values()) == {1}


def test_samples_are_bounded_whatever_repeats(spark):
    one = spark.range(5_000).select(F.lit(None).cast("long").alias("id"), F.lit("same").alias("text"))
    nulls = spark.range(3_000).select(F.lit(None).cast("long").alias("id"), F.col("id").cast("string").alias("text"))
    repeated = spark.range(3_000).select(F.lit(9).cast("long").alias("id"), F.concat(F.lit("x"), "id").alias("text"))
    for rows in (one, nulls, repeated, one.union(nulls).union(repeated)):
        assert sampled(rows, 100, ["id", "text"]).count() <= 150
    assert 20 <= sampled(nulls, 100, ["id", "text"]).count() and sampled(one, 9_000, ["id", "text"]).count() == 1


def test_running_totals_of_one_value(spark):
    """Rows of one order value, or of none, lie in many ranges."""
    for key in (F.lit(5).cast("long"), F.lit(None).cast("long"), F.col("id") % 3):
        rows = materialise(spark.range(3_000).select(key.alias("k"), (1 + F.col("id") % 7).alias("v")), "rows")
        got = running_total(rows, "k", "v", "t").orderBy("t").collect()
        assert len(got) == 3_000 and got[0]["t"] == 0
        assert all(a["t"] + a["v"] == b["t"] for a, b in zip(got, got[1:], strict=False))
        assert [r["k"] for r in got] == sorted((r["k"] for r in got), key=lambda k: (k is not None, k or 0))
