"""Connected components of a link graph by alternating large and small stars.

Each round is two joins on node ids and distinct pairs; a table in the shared folder holds the
state. Minima are combined before the shuffle; in the joins the rows of a node with many links are
dealt to several places. Links are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise, salted_join


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b): links in either direction, loops and repeats allowed. Returns node, component.

    component is the smallest node that links reach; nodes without a link to another have no row.
    """
    now = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars"
    )
    state = _state(now)
    n = F.count(F.lit(1)).alias("n")
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), n).select(F.col("u").alias("b"), F.least("u", "m").alias("m"), "n")
        # Each round has as many pairs as the one before at most.
        large = salted_join(now, least, "b", ["a"], 2 * state[0]).select("a", F.col("m").alias("b"))
        roots = large.groupBy("a").agg(F.min("b").alias("m"), n)
        small = salted_join(large, roots, "a", ["b"], state[0]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = materialise(small.union(roots.select("a", F.col("m").alias("b"))).distinct(), "stars")
        before, state = state, _state(then)
        discard(now)
        now = then
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    """Two numbers that stay the same only when the pairs do."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
