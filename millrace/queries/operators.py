"""One query for each operator, or each way an operator can be used."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import bit_range, cast_to, hash64, host_function, int_div, int_pow, log2_up, not_equal, pow2, prefix_sum, rotate_left, rotate_right
from millrace.operators import aggregate as agg
from millrace.operators import join, partition, rows
from millrace.operators.join import JoinConfig
from millrace.operators.partition import HashConfig
from millrace.operators.relation import Relation
from millrace.plans import Program, Query
from millrace.queries import query
from millrace.sources.tables import FORMATS, from_rows, generate, read, table, write
from millrace.storage import own_dir
from millrace.types import AlgebraError

LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
LINE = f"(SELECT *, row_number() OVER (ORDER BY {LINE_ORDER}) - 1 AS pos, count(*) OVER () AS n FROM lineitem)"
KEYS = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey"}


def lines(spark: SparkSession, folder: str) -> Relation:
    return table(spark, folder, "lineitem")


def sliced(position: str, rows_: str, n: int) -> str:
    first = f"({rows_} // {n} + {rows_} % {n})"
    return f"(CASE WHEN {position} < {first} THEN 0 ELSE 1 + ({position} - {first}) // greatest({rows_} // {n}, 1) END)::INTEGER"


# --- scans and expressions -------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey < 50")
def scan_param(spark: SparkSession, folder: str) -> DataFrame:
    k_upper = F.lit(50)
    return rows.project(rows.collect(rows.mask(lines(spark, folder), F.col("l_partkey") < k_upper)), l_orderkey="l_orderkey", l_partkey="l_partkey").to_df()


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey < 50")
def scan_param_sliced(spark: SparkSession, folder: str) -> DataFrame:
    cut = rows.split(lines(spark, folder), 16)
    return rows.project(rows.collect(rows.mask(cut, F.col("l_partkey") < 50)), l_orderkey="l_orderkey", l_partkey="l_partkey").to_df()


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_custkey < 40")
def scan_key_value(spark: SparkSession, folder: str) -> DataFrame:
    masked = rows.mask(table(spark, folder, "orders"), F.col("o_custkey") < 40)
    return rows.collect(rows.project(masked, key="o_orderkey", value="o_custkey")).to_df()


@query("SELECT l_orderkey + 2 * l_linenumber - 1 AS a, -l_partkey AS b, (l_partkey <> 7 AND NOT l_linenumber >= 4) OR l_suppkey = 3 AS c FROM lineitem")
def eval_arith(spark: SparkSession, folder: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    chosen = (not_equal(F.col("l_partkey"), 7) & ~(n >= 4)) | (F.col("l_suppkey") == 3)
    return rows.project(lines(spark, folder), a=k + 2 * n - 1, b=-F.col("l_partkey"), c=chosen).to_df()


@query("SELECT l_partkey // 7 AS q, -l_partkey // 7 AS m, (l_orderkey - 50) // l_linenumber AS d FROM lineitem")
def int_div_trunc(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("l_partkey")
    return rows.project(lines(spark, folder), q=int_div(k, 7), m=int_div(-k, 7), d=int_div(F.col("l_orderkey") - 50, F.col("l_linenumber"))).to_df()


@query("SELECT trunc(l_extendedprice)::INTEGER AS i, trunc(-l_quantity / 4)::INTEGER AS t, l_linenumber::DOUBLE AS d, l_orderkey::DOUBLE / 3 AS f, l_linenumber::SMALLINT AS u FROM lineitem")
def cast_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rows.project(
        lines(spark, folder), i=cast_to(F.col("l_extendedprice"), "int"), t=cast_to(-F.col("l_quantity") / 4, "int"), d=cast_to(F.col("l_linenumber"), "double"),
        f=cast_to(F.col("l_orderkey"), "double") / 3, u=cast_to(F.col("l_linenumber"), "uint8"),
    ).to_df()


@query("SELECT l_orderkey & 7 AS low, (l_orderkey >> 3) & 31 AS mid FROM lineitem", "bit_range")
def bit_range_(spark: SparkSession, folder: str) -> DataFrame:
    return rows.project(lines(spark, folder), low=bit_range(F.col("l_orderkey"), 2, 0), mid=bit_range(F.col("l_orderkey"), 7, 3)).to_df()


@query("SELECT 1::BIGINT << l_linenumber AS p, ceil(log2(l_linenumber))::INTEGER AS l, (l_linenumber * l_linenumber)::BIGINT AS s FROM lineitem")
def pow2_log2(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("l_linenumber")
    return rows.project(lines(spark, folder), p=pow2(n), l=log2_up(n), s=int_pow(n, 2)).to_df()


@query("SELECT *, r_regionkey + 1 AS next FROM region")
def rename_append(spark: SparkSession, folder: str) -> DataFrame:
    return Query(table(spark, folder, "region")).append(next=F.col("r_regionkey") + 1).to_df()


@query("SELECT l_linenumber, (l_linenumber::HUGEINT * l_linenumber * l_linenumber * l_linenumber * l_linenumber * l_linenumber * l_linenumber)::BIGINT AS seventh, 50031545098999707::BIGINT + l_linenumber - l_linenumber AS odd FROM lineitem")
def pow_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Powers in integers; 3 to the 35th is beyond what a double holds exactly."""
    n = F.col("l_linenumber")
    return rows.project(lines(spark, folder), l_linenumber="l_linenumber", seventh=int_pow(n, 7), odd=int_pow(3, n - n + 35)).to_df()


@query("SELECT l_orderkey, l_linenumber, l_partkey, 2 * l_linenumber + 1 AS twice FROM lineitem")
def host_function_rows(spark: SparkSession, folder: str) -> DataFrame:
    twice = host_function(lambda x: 2 * x + 1, "int32")
    return rows.project(lines(spark, folder), **KEYS, twice=twice(F.col("l_linenumber"))).to_df()


@query("SELECT l_orderkey, l_extendedprice * 2 AS double_price FROM lineitem WHERE l_quantity < 10")
def prune_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that later steps drop again are not read."""
    q = Query(lines(spark, folder)).append(double_price=F.col("l_extendedprice") * 2, unused=F.col("l_tax") + F.col("l_discount"))
    return q.filter(F.col("l_quantity") < 10).rename(l_orderkey="l_orderkey", double_price="double_price").to_df()


@query("SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, NULL, -2.0), (3, 'c', NULL)) t(k, name, x)")
def host_rows(spark: SparkSession, folder: str) -> DataFrame:
    return from_rows(spark, [(1, "a", 1.5), (2, None, -2.0), (3, "c", None)], "k int, name string, x double", "k").to_df()


@query("SELECT * FROM nation")
def sink_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A table written in each format, each time from the one before, and read back."""
    df = table(spark, folder, "nation").df
    for fmt in FORMATS:
        path = f"{own_dir(spark)}/sink-{uuid.uuid4().hex}"
        write(df, path, fmt)
        df = read(spark, path, fmt, df.schema)
    return df


@query("SELECT 200::BIGINT AS parts, 1500::BIGINT AS orders, 1500::BIGINT AS whole_orders, true AS in_domain")
def generated(spark: SparkSession, folder: str) -> DataFrame:
    """The generator's tables at scale 0.001: lines are numbered from 1 in every order, and every line's part is there."""
    made = generate(spark, 0.001)
    per_order = made["lineitem"].join(made["part"], F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("z"), F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"))
    whole = per_order.agg(F.count_if((F.col("a") == 1) & (F.col("z") == F.col("n"))).alias("whole_orders"), F.bool_and((F.col("n") <= 7) & (F.col("q") <= 50)).alias("in_domain"))
    counts = [made[t].agg(F.count(F.lit(1)).alias(name)) for t, name in (("part", "parts"), ("orders", "orders"))]
    return counts[0].crossJoin(counts[1]).crossJoin(whole)  # one row each


@query("SELECT r_regionkey + 1 AS next, r_name AS label, * FROM region")
def rename_prepend(spark: SparkSession, folder: str) -> DataFrame:
    return Query(table(spark, folder, "region")).prepend(next=F.col("r_regionkey") + 1, label=F.col("r_name")).to_df()


@query("SELECT l_partkey, l_extendedprice, l_quantity FROM lineitem")
def zip_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Columns computed apart and put side by side again."""
    placed = rows.positioned(lines(spark, folder))
    a, b = (rows.project(placed, **{c: c for c in names}) for names in (["l_partkey"], ["l_extendedprice", "l_quantity"]))
    return rows.zip_rows(a, b).to_df()


@query("SELECT [3, 4, 5, 1, 2] AS l, [5, 1, 2, 3, 4] AS r, [0, 1, 3, 6, 10]::BIGINT[] AS p, r_regionkey FROM region")
def array_operations(spark: SparkSession, folder: str) -> DataFrame:
    a = F.array(*[F.lit(i) for i in range(1, 6)])
    return rows.project(table(spark, folder, "region"), l=rotate_left(a, 2), r=rotate_right(a, 1), p=prefix_sum(a.cast("array<bigint>")), r_regionkey="r_regionkey").to_df()


# --- masks -----------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity < 10")
def mask_then_count(spark: SparkSession, folder: str) -> DataFrame:
    return agg.count(rows.mask(lines(spark, folder), F.col("l_quantity") < 10))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.03 AND l_linenumber = 1")
def mask_chain(spark: SparkSession, folder: str) -> DataFrame:
    r = lines(spark, folder)
    for c in (F.col("l_quantity") < 10, F.col("l_discount") > 0.03, F.col("l_linenumber") == 1):
        r = rows.mask(r, c)
    return rows.project(r, **KEYS).to_df()


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < 3")
def collect(spark: SparkSession, folder: str) -> DataFrame:
    return rows.project(rows.collect(rows.mask(lines(spark, folder), F.col("l_quantity") < 3)), **KEYS).to_df()


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < 3")
def compact(spark: SparkSession, folder: str) -> DataFrame:
    return Query(lines(spark, folder)).mask(F.col("l_quantity") < 3).compact().rename(**KEYS).to_df()


# --- aggregation -----------------------------------------------------------------------------


@query("SELECT DISTINCT l_quantity, l_linenumber FROM lineitem")
def distinct_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rows.distinct(rows.project(lines(spark, folder), l_quantity="l_quantity", l_linenumber="l_linenumber")).to_df()


@query("SELECT DISTINCT l_quantity + 1 AS q FROM lineitem")
def distinct_computed(spark: SparkSession, folder: str) -> DataFrame:
    return Query(lines(spark, folder)).rename(q=F.col("l_quantity") + 1).group_by("q").aggregates().to_df()


#: Combiner: (the column, its SQL, the type of the result). The product is of signs: exact in any order, and within range at any size.
COMBINED: dict[str, tuple[Callable[[], Column], str, str]] = {
    "sum": (lambda: F.col("l_quantity").cast("decimal(12,2)"), "coalesce(sum(l_quantity::DECIMAL(12,2)), 0)", "double"),
    "product": (lambda: F.when(F.col("l_linenumber") % 2 == 1, -1).otherwise(1).cast("double"), "product(CASE WHEN l_linenumber % 2 = 1 THEN -1 ELSE 1 END)", "double"),
    "min": (lambda: F.col("l_extendedprice"), "min(l_extendedprice)", "double"),
    "max": (lambda: F.col("l_extendedprice"), "max(l_extendedprice)", "double"),
    "and": (lambda: F.col("l_quantity") > 1, "bool_and(l_quantity > 1)", "boolean"),
    "or": (lambda: F.col("l_discount") > 0.09, "bool_or(l_discount > 0.09)", "boolean"),
}


def _combiners() -> None:
    """The combiners over every row of lineitem."""
    for op, (column, sql, kind) in COMBINED.items():

        def grouped(spark: SparkSession, folder: str, op: str = op, column: Callable[[], Column] = column, kind: str = kind) -> DataFrame:
            return agg.aggregate(lines(spark, folder), ["l_returnflag", "l_suppkey"], value=(op, column())).withColumn("value", F.col("value").cast(kind))

        def reduced(spark: SparkSession, folder: str, op: str = op, column: Callable[[], Column] = column, kind: str = kind) -> DataFrame:
            return agg.aggregate(lines(spark, folder), value=(op, column())).select(F.col("value").cast(kind))

        query(f"SELECT ({sql})::{kind} AS value, l_returnflag, l_suppkey FROM lineitem GROUP BY l_returnflag, l_suppkey", f"group_{op}")(grouped)
        query(f"SELECT ({sql})::{kind} AS value FROM lineitem", f"reduce_{op}")(reduced)


_combiners()


@query("SELECT coalesce(sum(l_linenumber), 0)::BIGINT AS s, min(l_linenumber) AS m, count(*) AS n FROM lineitem WHERE l_quantity > 1000")
def sum_empty_is_zero(spark: SparkSession, folder: str) -> DataFrame:
    none = rows.mask(lines(spark, folder), F.col("l_quantity") > 1000)
    return agg.aggregate(none, s=("sum", "l_linenumber"), m=("min", "l_linenumber"), n=("sum", F.lit(1).cast("long")))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY l_returnflag")
def count_valid(spark: SparkSession, folder: str) -> DataFrame:
    return agg.aggregate(rows.mask(lines(spark, folder), F.col("l_quantity") < 10), ["l_returnflag"], n=("sum", F.lit(1).cast("long")))


@query("SELECT l_partkey, round(sum(l_quantity::DECIMAL(12,2))::DOUBLE / count(*), 6) AS mean FROM lineitem GROUP BY l_partkey")
def avg_idiom(spark: SparkSession, folder: str) -> DataFrame:
    sums = agg.aggregate(lines(spark, folder), ["l_partkey"], s=("sum", F.col("l_quantity").cast("decimal(12,2)")), n=("sum", F.lit(1).cast("long")))
    return sums.select("l_partkey", F.round(F.col("s").cast("double") / F.col("n"), 6).alias("mean"))


@query("SELECT l_suppkey, sum(l_linenumber)::BIGINT AS s, max(l_quantity) AS m FROM lineitem GROUP BY l_suppkey")
def two_phase_agg(spark: SparkSession, folder: str) -> DataFrame:
    return agg.two_phase(rows.split(lines(spark, folder), 8), ["l_suppkey"], s=("sum", "l_linenumber"), m=("max", "l_quantity"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE l_quantity > (SELECT round(avg(l_quantity), 6) FROM lineitem x WHERE x.l_suppkey = l.l_suppkey)")
def correlated_mean(spark: SparkSession, folder: str) -> DataFrame:
    means = Query(lines(spark, folder)).rename(key=F.col("l_suppkey"), q=F.col("l_quantity").cast("decimal(12,2)"), one=F.lit(1).cast("long")).group_by("key").aggregates(q=("sum", "q"), one=("sum", "one"))
    means = means.rename(key="key", mean=F.round(F.col("q").cast("double") / F.col("one"), 6))
    kept = Query(lines(spark, folder)).equi_join(means, "l_suppkey", "key").filter(F.col("l_quantity") > F.col("mean"))
    return kept.rename(l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_quantity="l_quantity").to_df()


# --- joins -----------------------------------------------------------------------------------


def line_part(spark: SparkSession, folder: str) -> tuple[Relation, Relation]:
    left = rows.project(lines(spark, folder), l_orderkey="l_orderkey", l_partkey="l_partkey", l_extendedprice="l_extendedprice")
    return left, rows.project(table(spark, folder, "part"), p_partkey="p_partkey", p_retailprice="p_retailprice")


JOINED = "SELECT l_orderkey, l_partkey, l_extendedprice, p_partkey, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(JOINED)
def join_inner(spark: SparkSession, folder: str) -> DataFrame:
    return join.equi_join(*line_part(spark, folder), "l_partkey", "p_partkey").to_df()


@query(f"{JOINED} AND l_extendedprice > 20 * p_retailprice")
def join_residual(spark: SparkSession, folder: str) -> DataFrame:
    return join.equi_join(*line_part(spark, folder), "l_partkey", "p_partkey", F.col("l_extendedprice") > 20 * F.col("p_retailprice")).to_df()


@query(JOINED)
def join_sliced(spark: SparkSession, folder: str) -> DataFrame:
    left, right = line_part(spark, folder)
    return join.equi_join(rows.split(left, 4), right, "l_partkey", "p_partkey").to_df()


@query("SELECT l_orderkey, l_partkey, brand, size FROM (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem) JOIN (SELECT DISTINCT p_brand AS brand, p_size AS size FROM part) ON l_linenumber = size")
def join_dedup_build(spark: SparkSession, folder: str) -> DataFrame:
    left = rows.project(lines(spark, folder), l_orderkey="l_orderkey", l_partkey="l_partkey", l_linenumber="l_linenumber")
    right = rows.project(table(spark, folder, "part"), brand="p_brand", size="p_size")
    out = join.equi_join(left, right, "l_linenumber", "size", config=JoinConfig(dedup=True))
    return rows.project(out, l_orderkey="l_orderkey", l_partkey="l_partkey", brand="brand", size="size").to_df()


@query("SELECT l_orderkey, l_partkey, brand, size FROM lineitem JOIN (SELECT p_partkey, p_brand AS brand, p_size AS size FROM part) ON l_partkey // 40 = p_partkey // 40 AND l_linenumber = size")
def join_bag_build(spark: SparkSession, folder: str) -> DataFrame:
    """Every part is on the build side; two columns as one key, which several parts share."""
    key = lambda group, size: int_div(F.col(group), 40) * 64 + F.col(size)  # noqa: E731  sizes are 1 to 50
    left = rows.project(lines(spark, folder), l_orderkey="l_orderkey", l_partkey="l_partkey", left_key=key("l_partkey", "l_linenumber"))
    right = rows.project(table(spark, folder, "part"), brand="p_brand", size="p_size", right_key=key("p_partkey", "p_size"))
    out = join.equi_join(left, right, "left_key", "right_key")
    return rows.project(out, l_orderkey="l_orderkey", l_partkey="l_partkey", brand="brand", size="size").to_df()


@query("""
    SELECT p_partkey, s AS quantity, p_retailprice, o_custkey FROM (SELECT l_partkey, l_orderkey, sum(l_quantity) AS s FROM lineitem GROUP BY ALL)
    JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
""")
def join_multi(spark: SparkSession, folder: str) -> DataFrame:
    sums = Query(lines(spark, folder)).group_by("l_partkey", "l_orderkey").aggregates(quantity=("sum", "l_quantity"))
    parts, orders = Query(table(spark, folder, "part")), Query(table(spark, folder, "orders"))
    out = sums.equi_join(parts, "l_partkey", "p_partkey").equi_join(orders, "l_orderkey", "o_orderkey")
    return out.rename(p_partkey="p_partkey", quantity="quantity", p_retailprice="p_retailprice", o_custkey="o_custkey").to_df()


@query(JOINED)
def join_array_direct(spark: SparkSession, folder: str) -> DataFrame:
    """Keys as bucket numbers of their own: equal keys share a bucket, and so does nothing else within 2**bits."""
    left, right = line_part(spark, folder)
    config = HashConfig(width=0, bits=20)
    a = rows.rename(left, True, left_bucket=config.bucket(F.col("l_partkey")))
    b = rows.rename(right, True, right_bucket=config.bucket(F.col("p_partkey")))
    out = join.equi_join(a, b, "left_bucket", "right_bucket", F.col("l_partkey") == F.col("p_partkey"))
    return out.to_df().drop("left_bucket", "right_bucket")


@query("SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 5)")
def join_semi(spark: SparkSession, folder: str) -> DataFrame:
    small = rows.filter_rows(table(spark, folder, "part"), F.col("p_size") < 5)
    return join.semi_join(line_part(spark, folder)[0], small, "l_partkey", "p_partkey").to_df()


@query("SELECT n_nationkey, r_name FROM nation CROSS JOIN region")
def join_cross(spark: SparkSession, folder: str) -> DataFrame:
    return rows.project(join.cross(table(spark, folder, "nation"), table(spark, folder, "region")), n_nationkey="n_nationkey", r_name="r_name").to_df()


@query("SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON n_nationkey < s_nationkey")
def join_theta(spark: SparkSession, folder: str) -> DataFrame:
    out = join.theta_join(table(spark, folder, "nation"), table(spark, folder, "supplier"), F.col("n_nationkey") < F.col("s_nationkey"))
    return rows.project(out, n_nationkey="n_nationkey", s_suppkey="s_suppkey").to_df()


# --- order and slices ------------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, pos AS position FROM {LINE}")
def position_abs(spark: SparkSession, folder: str) -> DataFrame:
    return rows.project(rows.with_position(lines(spark, folder)), **KEYS, position="position").to_df()


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, s AS slice, row_number() OVER (PARTITION BY s ORDER BY pos) - 1 AS position FROM (SELECT *, {sliced('pos', 'n', 16)} AS s FROM {LINE})")
def position_rel(spark: SparkSession, folder: str) -> DataFrame:
    cut = rows.slice_column(rows.split(lines(spark, folder), 16))
    return rows.project(rows.with_position(cut, relative=True), **KEYS, slice="slice", position="position").to_df()


@query("SELECT l_orderkey, idx, name FROM (SELECT l_orderkey, l_orderkey % 200 AS idx FROM lineitem) JOIN (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name AS name FROM part) ON idx = pos")
def gather(spark: SparkSession, folder: str) -> DataFrame:
    index = rows.project(lines(spark, folder), l_orderkey="l_orderkey", idx=F.col("l_orderkey") % 200)
    return rows.gather(index, "idx", rows.project(rows.positioned(table(spark, folder, "part")), name="p_name")).to_df()


@query(f"SELECT {sliced('pos', 'n', 7)} AS slice, count(*) AS n FROM {LINE} GROUP BY 1")
def split_par_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return rows.slice_column(rows.split(lines(spark, folder), 7)).df.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT s AS outer_slice, {sliced('i', 'm', 3)} AS inner_slice, count(*) AS n FROM (SELECT s, row_number() OVER (PARTITION BY s ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY s) AS m FROM (SELECT pos, {sliced('pos', 'n', 4)} AS s FROM {LINE})) GROUP BY 1, 2")
def split_nested(spark: SparkSession, folder: str) -> DataFrame:
    cut = rows.split(rows.split(lines(spark, folder), 4, "outer_slice"), 3, "inner_slice")
    return cut.df.groupBy("outer_slice", "inner_slice").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {sliced('pos', 'n', 7)} AS slice, sum(l_linenumber)::BIGINT AS s FROM {LINE} GROUP BY 1")
def split_reduce(spark: SparkSession, folder: str) -> DataFrame:
    return agg.reduce_slices(rows.split(lines(spark, folder), 7, "slice"), "sum", "l_linenumber", "s")


@query(f"""
    SELECT place, sum(l_linenumber)::BIGINT AS s FROM (
        SELECT row_number() OVER (PARTITION BY s ORDER BY pos) - 1 AS place, l_linenumber FROM (SELECT *, {sliced('pos', 'n', 7)} AS s FROM {LINE}))
    GROUP BY place
""")
def nested_reduce(spark: SparkSession, folder: str) -> DataFrame:
    return agg.nested_reduce(rows.split(lines(spark, folder), 7), "sum", "l_linenumber", "s")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {sliced('pos', 'n', 4)} AS slice FROM {LINE}")
def flatten(spark: SparkSession, folder: str) -> DataFrame:
    cut = rows.flatten(rows.split(rows.split(lines(spark, folder), 4), 3))
    return rows.project(rows.slice_column(cut), **KEYS, slice="slice").to_df()


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM {LINE} WHERE {sliced('pos', 'n', 5)} = 4")
def last_array(spark: SparkSession, folder: str) -> DataFrame:
    return rows.project(rows.last_array(rows.split(lines(spark, folder), 5)), **KEYS).to_df()


NATIONS = "(SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, count(*) OVER () AS n FROM nation)"


@query(f"""
    SELECT g.s::INTEGER AS slice, coalesce(sum(n_regionkey), 0)::BIGINT AS total, max(n_nationkey) AS top
    FROM generate_series(0, 39) g(s) LEFT JOIN (SELECT *, {sliced('pos', 'n', 40)} AS place FROM {NATIONS}) ON place = g.s GROUP BY g.s
""")
def reduce_empty_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Forty slices of twenty-five rows: the empty ones give 0, or null without a value for nothing."""
    cut = rows.split(table(spark, folder, "nation"), 40, "slice")
    return agg.reduce_slices(cut, "sum", "n_regionkey", "total").join(agg.reduce_slices(cut, "max", "n_nationkey", "top"), "slice")


@query(f"""
    SELECT s AS slice, coalesce(sum(l_linenumber) FILTER (kept), -1)::BIGINT AS s FROM (SELECT l_linenumber, {sliced('pos', 'n', 9)} AS s, pos >= n - n // 3 AS kept FROM {LINE}) GROUP BY s
""")
def reduce_masked_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Slices of which most are wholly masked; those give what the reduction begins with."""
    cut = rows.with_position(rows.split(lines(spark, folder), 9, "slice"))
    total = rows.length(cut)
    masked = rows.mask(rows.zip_scalar(cut, total), F.col("position") >= F.col("length") - int_div(F.col("length"), 3))
    return agg.reduce_slices(masked, "sum", "l_linenumber", "s", init=-1)


@query("SELECT n_nationkey FROM nation WHERE 1 = 0")
def last_array_empty(spark: SparkSession, folder: str) -> DataFrame:
    """The last of forty slices of twenty-five rows is empty."""
    return rows.project(rows.last_array(rows.split(table(spark, folder, "nation"), 40)), n_nationkey="n_nationkey").to_df()


@query("SELECT sum(l_linenumber)::BIGINT AS l_linenumber FROM lineitem")
def nested_sum(spark: SparkSession, folder: str) -> DataFrame:
    """The sum over what seven slices gave."""
    return Query(lines(spark, folder)).split(7).reduce("sum", "l_linenumber").flatten().nested_sum("l_linenumber").to_df()


@query("SELECT 0 AS slice, sum(l_linenumber)::BIGINT AS s FROM lineitem")
def shell(spark: SparkSession, folder: str) -> DataFrame:
    return agg.reduce_slices(rows.shell(lines(spark, folder), "slice"), "sum", "l_linenumber", "s")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_returnflag, l_quantity, {LINE_ORDER.replace(', l_quantity', '')}) - 1 AS rank FROM lineitem")
def sort_multi_key(spark: SparkSession, folder: str) -> DataFrame:
    """The sort's order as a number."""
    return rows.project(rows.with_position(rows.sort(lines(spark, folder), "l_returnflag", "l_quantity"), "rank"), **KEYS, rank="rank").to_df()


@query(f"SELECT l_suppkey, l_quantity, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_suppkey, l_quantity, {LINE_ORDER.replace(', l_suppkey, l_quantity', '')}) - 1 AS rank FROM lineitem")
def sort_by_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """Columns by ordinal, from 0, among those there are."""
    chosen = rows.project(lines(spark, folder), **{c: c for c in ("l_suppkey", "l_quantity", "l_orderkey", "l_linenumber")})
    return rows.with_position(rows.sort(chosen, 0, 1), "rank").to_df()


@query("SELECT max(l_orderkey) AS top, l_suppkey, l_linenumber FROM lineitem GROUP BY l_suppkey, l_linenumber")
def group_by_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    chosen = rows.project(lines(spark, folder), **{c: c for c in ("l_suppkey", "l_linenumber", "l_orderkey")})
    return agg.aggregate(chosen, [0, 1], top=("max", 2))


@query("SELECT count(*) AS length FROM lineitem")
def length(spark: SparkSession, folder: str) -> DataFrame:
    return rows.length(rows.mask(lines(spark, folder), F.col("l_quantity") < 3))


# --- hashes and partitions -------------------------------------------------------------------

Z, WORD = "6542915301859449791::HUGEINT", "18446744073709551616::HUGEINT"


@query(f"SELECT l_partkey, ((l_partkey::HUGEINT * {Z}) % {WORD} // {1 << 52}::HUGEINT)::INTEGER AS bucket FROM lineitem")
def hash64_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return rows.project(lines(spark, folder), l_partkey="l_partkey", bucket=hash64([(F.col("l_partkey"), 32)], 12)).to_df()


@query(f"""
    SELECT l_orderkey, l_partkey, l_linenumber, ((((((l_orderkey::HUGEINT * 4294967296 + l_partkey) % {WORD}) * {Z}) % {WORD}) % 72057594037927936::HUGEINT * 256 + l_linenumber) % {WORD} * {Z} % {WORD}
        // {1 << 44}::HUGEINT)::BIGINT AS bucket FROM lineitem
""")
def hash64_multi(spark: SparkSession, folder: str) -> DataFrame:
    """Two 32-bit fields fill the word, so it is multiplied before the third."""
    fields = [(F.col("l_orderkey"), 32), (F.col("l_partkey"), 32), (F.col("l_linenumber"), 8)]
    return rows.project(lines(spark, folder), l_orderkey="l_orderkey", l_partkey="l_partkey", l_linenumber="l_linenumber", bucket=hash64(fields, 20)).to_df()


def bucketed(spark: SparkSession, folder: str) -> Relation:
    return rows.rename(lines(spark, folder), True, bucket=F.col("l_partkey") % 13)


COUNTED = "SELECT b AS bucket, count(l_partkey) AS count FROM generate_series(0, 15) g(b) LEFT JOIN lineitem ON l_partkey % 13 = b GROUP BY b"


@query(COUNTED)
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return partition.histogram(bucketed(spark, folder), "bucket", 16).df


@query(f"SELECT bucket, coalesce(sum(count) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM ({COUNTED} UNION ALL SELECT 16, 0)")
def offsets(spark: SparkSession, folder: str) -> DataFrame:
    return partition.offsets(partition.histogram(bucketed(spark, folder), "bucket", 16)).df


SLICED = f"SELECT *, l_partkey % 13 AS b, {sliced('pos', 'n', 4)} AS s FROM {LINE}"


@query(f"""
    WITH r AS ({SLICED}), c AS (SELECT s, b, count(*) AS n FROM r GROUP BY s, b),
        f AS (SELECT x.s, g.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT s FROM r) x CROSS JOIN generate_series(0, 15) g(b) LEFT JOIN c ON c.s = x.s AND c.b = g.b)
    SELECT s AS slice, b AS bucket, coalesce(sum(n) OVER (ORDER BY b, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM f
    UNION ALL SELECT NULL, 16, count(*) FROM r
""")
def offsets_by_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Histograms of four slices, interleaved bucket by bucket."""
    cut = rows.split(bucketed(spark, folder), 4, "slice")
    return partition.offsets(partition.histogram(cut, "bucket", 16)).df


@query(f"""
    WITH r AS ({SLICED}), c AS (SELECT s, b, count(*) AS n FROM r GROUP BY s, b),
        f AS (SELECT x.s, g.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT s FROM r) x CROSS JOIN generate_series(0, 15) g(b) LEFT JOIN c ON c.s = x.s AND c.b = g.b)
    SELECT s AS slice, b AS bucket, coalesce(sum(n) OVER (PARTITION BY s ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM f
    UNION ALL SELECT s, 16, count(*) FROM r GROUP BY s
""")
def offsets_disjoint(spark: SparkSession, folder: str) -> DataFrame:
    cut = rows.split(bucketed(spark, folder), 4, "slice")
    return partition.offsets(partition.histogram(cut, "bucket", 16), disjoint=True).df


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 13 AS bucket, row_number() OVER (ORDER BY l_partkey % 13, pos) - 1 AS place FROM {LINE}")
def partition_stable(spark: SparkSession, folder: str) -> DataFrame:
    r = bucketed(spark, folder)
    placed, _ = partition.partition(r, "bucket", partition.offsets(partition.histogram(r, "bucket", 16)))
    return rows.project(placed, **KEYS, bucket="bucket", place="place").to_df()


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_partkey % 13, pos) - 1 AS place FROM {LINE}")
def partition_sliced(spark: SparkSession, folder: str) -> DataFrame:
    """Slices partitioned together give the same order as the whole."""
    cut = rows.split(bucketed(spark, folder), 16)
    placed, _ = partition.partition(cut, "bucket", partition.offsets(partition.histogram(cut, "bucket", 16)))
    return rows.project(placed, **KEYS, place="place").to_df()


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey >> 2) & 7 AS bucket, row_number() OVER (ORDER BY (l_partkey >> 2) & 7, pos) - 1 AS place FROM {LINE}")
def radix_part(spark: SparkSession, folder: str) -> DataFrame:
    placed, _ = partition.radix_partition(lines(spark, folder), "l_partkey", 4, 2)
    return rows.project(placed, **KEYS, bucket="bucket", place="place").to_df()


HASHED = f"((l_partkey::HUGEINT * {Z}) % {WORD} // {1 << 52}::HUGEINT)::BIGINT"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, ({HASHED} >> 4) & 7 AS bucket, row_number() OVER (ORDER BY ({HASHED} >> 4) & 7, pos) - 1 AS place FROM {LINE}")
def radix_part_hashed(spark: SparkSession, folder: str) -> DataFrame:
    """By bits of a hash of the key, over four slices."""
    placed, _ = partition.radix_partition(lines(spark, folder), "l_partkey", 6, 4, hash=lambda k: hash64([(k, 32)], 12), slices=4)
    return rows.project(placed, **KEYS, bucket="bucket", place="place").to_df()


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey % 13 AS bucket, row_number() OVER (PARTITION BY l_partkey % 13 ORDER BY pos) - 1 AS place FROM {LINE}")
def partition_disjoint(spark: SparkSession, folder: str) -> DataFrame:
    """Keys in one relation, values in another, and a buffer for each bucket."""
    r = bucketed(spark, folder)
    values = rows.project(lines(spark, folder), l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_extendedprice="l_extendedprice")
    hist = partition.offsets(partition.histogram(r, "bucket", 16))
    placed, _ = partition.partition(rows.project(r, bucket="bucket"), "bucket", hist, values=values, disjoint=True)
    return rows.project(placed, l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_extendedprice="l_extendedprice", bucket="bucket", place="place").to_df()


KEPT = f"(SELECT *, {sliced('pos', 'n', 6)} AS s FROM {LINE} WHERE l_quantity < 10)"
BY_SLICE = f"(SELECT g.s::INTEGER AS s, count(l_orderkey) AS k, coalesce(sum(count(l_orderkey)) OVER (ORDER BY g.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM generate_series(0, 5) g(s) LEFT JOIN {KEPT} x ON x.s = g.s GROUP BY g.s)"


def masked_slices(spark: SparkSession, folder: str) -> Relation:
    return rows.mask(rows.split(lines(spark, folder), 6, "slice"), F.col("l_quantity") < 10)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, (lower + 3 * s)::BIGINT + row_number() OVER (PARTITION BY s ORDER BY pos) - 1 AS place FROM {KEPT} JOIN {BY_SLICE} USING (s)")
def compact_padded(spark: SparkSession, folder: str) -> DataFrame:
    """What a mask left of six slices, each with three unused places after it."""
    packed, _ = partition.compact_slices(masked_slices(spark, folder), padding=3)
    return rows.project(packed, **KEYS, place="place").to_df()


@query(f"SELECT s::BIGINT AS bucket, k AS count FROM {BY_SLICE}")
def compact_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return partition.compact_slices(masked_slices(spark, folder))[1].df


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey")
def hash_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Placed by key first, so the grouping shuffles no more."""
    return Query(lines(spark, folder)).partition("l_partkey", 16).group_by("l_partkey").aggregates(n=("sum", F.lit(1).cast("long"))).to_df()


# --- control ---------------------------------------------------------------------------------


@query("WITH t AS (SELECT r_regionkey + 1 AS k FROM region), u AS (SELECT k * 10 AS k FROM t) SELECT k FROM u")
def let_shadowing(spark: SparkSession, folder: str) -> DataFrame:
    p = Program(t=table(spark, folder, "region"))
    p.let("t", lambda s: rows.project(s["t"], k=F.col("r_regionkey") + 1)).let("t", lambda s: rows.project(s["t"], k=F.col("k") * 10))
    return p["t"].to_df()


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def cat_uncat(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    bundle = rows.cat(*[rows.filter_rows(nation, F.col("n_regionkey") == k) for k in range(3)])
    return rows.project(rows.uncat(bundle, 1), n_nationkey="n_nationkey").to_df()


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < 3")
def complete_written(spark: SparkSession, folder: str) -> DataFrame:
    """The rows so far written and read again before the filter."""
    return Query(lines(spark, folder)).rename(**KEYS, l_quantity="l_quantity").complete(True).filter(F.col("l_quantity") < 3).rename(**KEYS).to_df()


@query("SELECT * FROM (VALUES (0, 0, 'lineitem'), (1, 2, 'filter 2 conditions mode=plain'), (2, 2, 'append revenue'), (3, 2, 'group_by l_suppkey')) t(line, indent, step)")
def plan_listing(spark: SparkSession, folder: str) -> DataFrame:
    q = Query(lines(spark, folder), "lineitem").filter(F.col("l_quantity") < 24, F.col("l_discount") > 0.05).append(revenue=F.col("l_extendedprice") * F.col("l_discount"))
    listed = q.group_by("l_suppkey").aggregates(revenue=("sum", "revenue")).listing().split("\n")
    return from_rows(spark, ((i, len(x) - len(x.lstrip()), x.lstrip()) for i, x in enumerate(listed)), "line int, indent int, step string", "line").to_df()


@query("SELECT 'region > append > sort > sort: no column ''nothing'' among [''r_regionkey'', ''r_name'', ''next'']' AS message")
def typed_error(spark: SparkSession, folder: str) -> DataFrame:
    """What a wrong plan is told: the steps up to the one that refuses, and why."""
    try:
        Query(table(spark, folder, "region"), "region").append(next=F.col("r_regionkey") + 1).sort("nothing").to_df()
    except AlgebraError as e:
        return from_rows(spark, [(str(e),)], "message string").to_df()
    raise AssertionError("a sort by no column was not refused")


@query("SELECT r_regionkey, r_name FROM region")
def block_identity(spark: SparkSession, folder: str) -> DataFrame:
    return Query(table(spark, folder, "region")).connector(rows.block).to_df()
