"""TPC-H queries 1, 6, 17 and 19, adapted: dates, one brand and the codes fit the tables there are.

Money is summed as decimals, so a result does not depend on the order of the rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregate, rows
from millrace.operators.join import JoinConfig
from millrace.plans import Query
from millrace.plans.builder import choice
from millrace.queries import query
from millrace.sources import tables

# Codes of ship modes, of the ship instruction, of containers by size.
AIR, AIR_REG, IN_PERSON = 1, 2, 1
SMALL, MEDIUM, LARGE, MED_BOX = (0, 1, 2, 3), (4, 5, 6, 7), (9, 10, 11, 12), 5


def price() -> Column:
    return F.col("l_extendedprice").cast("decimal(12,2)")


def rate() -> Column:
    return F.col("l_discount").cast("decimal(4,2)")


def discounted() -> Column:
    return price() * (F.lit(1).cast("decimal(4,2)") - rate())


@query("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS sum_qty, sum(p)::DOUBLE AS sum_base_price,
        sum(p * (1 - d))::DOUBLE AS sum_disc_price, sum(p * (1 - d) * (1 + t))::DOUBLE AS sum_charge,
        round(sum(l_quantity::DECIMAL(12,2))::DOUBLE / count(*), 6) AS avg_qty, round(sum(p)::DOUBLE / count(*), 6) AS avg_price,
        round(sum(d)::DOUBLE / count(*), 6) AS avg_disc, count(*) AS count_order
    FROM (SELECT *, l_extendedprice::DECIMAL(12,2) AS p, l_discount::DECIMAL(4,2) AS d, l_tax::DECIMAL(4,2) AS t FROM lineitem)
    WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
""")
def tpch_q01(spark: SparkSession, folder: str) -> DataFrame:
    sums = (
        Query(tables.table(spark, folder, "lineitem"), "lineitem")
        .filter(F.col("l_shipdate") <= F.lit(datetime(1998, 9, 2)))
        .append(price=price(), rate=rate(), disc_price=discounted())
        .append(charge=F.col("disc_price") * (F.lit(1).cast("decimal(4,2)") + F.col("l_tax").cast("decimal(4,2)")), quantity=F.col("l_quantity").cast("decimal(12,2)"), one=F.lit(1).cast("long"))
        .group_by("l_returnflag", "l_linestatus")
        .aggregates(sum_qty=("sum", "quantity"), sum_base_price=("sum", "price"), sum_disc_price=("sum", "disc_price"), sum_charge=("sum", "charge"), sum_disc=("sum", "rate"), count_order=("sum", "one"))
    )
    mean = lambda c: F.round(F.col(c).cast("double") / F.col("count_order"), 6)
    return (
        sums.append(avg_qty=mean("sum_qty"), avg_price=mean("sum_base_price"), avg_disc=mean("sum_disc"))
        .append(**{c: F.col(c).cast("double") for c in ("sum_qty", "sum_base_price", "sum_disc_price", "sum_charge")})
        .rename(**{c: c for c in ("l_returnflag", "l_linestatus", "sum_qty", "sum_base_price", "sum_disc_price", "sum_charge", "avg_qty", "avg_price", "avg_disc", "count_order")})
        .connector(lambda r: rows.sort(r, "l_returnflag", "l_linestatus"))
        .to_df()
    )


Q6 = """
    SELECT coalesce(sum(l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(4,2)), 0)::DOUBLE AS revenue FROM lineitem
    WHERE l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
        AND l_discount > 0.05 AND l_discount < 0.07 AND l_quantity < 24
"""


def q06(spark: SparkSession, folder: str, mode: object = "plain") -> Query:
    return (
        Query(tables.table(spark, folder, "lineitem"), "lineitem")
        .filter(
            (F.col("l_shipdate") > F.lit(datetime(1996, 1, 1))) & (F.col("l_shipdate") < F.lit(datetime(1997, 1, 1))),
            (F.col("l_discount") > 0.05) & (F.col("l_discount") < 0.07),
            F.col("l_quantity") < 24,
            mode=mode,
        )
        .rename(revenue=price() * rate())
        .aggregate(revenue=("sum", "revenue"))
        .cast("revenue", "double")
    )


@query(Q6)
def tpch_q06(spark: SparkSession, folder: str) -> DataFrame:
    return q06(spark, folder).to_df()


@query(Q6)
def filter_cracked(spark: SparkSession, folder: str) -> DataFrame:
    return q06(spark, folder, "cracked").to_df()


@query(Q6)
def filter_collect(spark: SparkSession, folder: str) -> DataFrame:
    return q06(spark, folder, "collect").to_df()


@query(Q6)
def tpch_q06_sliced(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen slices, a sum in each, and the sum of these."""
    sliced = rows.split(tables.table(spark, folder, "lineitem"), 16)
    kept = rows.filter_rows(sliced, (F.col("l_shipdate") > F.lit(datetime(1996, 1, 1))) & (F.col("l_shipdate") < F.lit(datetime(1997, 1, 1))), (F.col("l_discount") > 0.05) & (F.col("l_discount") < 0.07), F.col("l_quantity") < 24)
    sums = aggregate.two_phase(rows.project(kept, revenue=price() * rate()), [], revenue=("sum", "revenue"))
    return sums.select(F.col("revenue").cast("double"))


Q17 = """
    WITH p AS (SELECT DISTINCT p_partkey FROM part WHERE p_brand = 'Brand#23' AND (p_partkey * 3) % 13 = 5)
    SELECT round(coalesce(sum(l_extendedprice::DECIMAL(12,2)), 0)::DOUBLE / 7.0, 6) AS avg_yearly FROM lineitem l JOIN p ON l_partkey = p_partkey
    WHERE l_quantity < (SELECT 0.2::DOUBLE * sum(x.l_quantity::DECIMAL(12,2))::DOUBLE / count(*) FROM lineitem x WHERE x.l_partkey = l.l_partkey)
"""


@query(Q17)
def tpch_q17(spark: SparkSession, folder: str) -> DataFrame:
    parts = Query(tables.part(spark, folder), "part").filter(F.col("p_brand") == "Brand#23", F.col("p_container") == MED_BOX).group_by("p_partkey").aggregates()
    lines = Query(tables.table(spark, folder, "lineitem"), "lineitem").semi_join(parts, "l_partkey", "p_partkey").rename(l_partkey="l_partkey", l_quantity="l_quantity", price=price())
    means = (
        lines.rename(key=F.col("l_partkey"), quantity=F.col("l_quantity").cast("decimal(12,2)"), one=F.lit(1).cast("long"))
        .group_by("key").aggregates(quantity=("sum", "quantity"), n=("sum", "one")).rename(key="key", limit=0.2 * F.col("quantity").cast("double") / F.col("n"))
    )
    kept = lines.equi_join(means, "l_partkey", "key").filter(F.col("l_quantity") < F.col("limit")).aggregate(total=("sum", "price"))
    return kept.rename(avg_yearly=F.round(F.col("total").cast("double") / 7.0, 6)).to_df()


@query(Q17)
def tpch_q17_means_first(spark: SparkSession, folder: str) -> DataFrame:
    """The other plan: means of all parts, then the chosen parts."""
    lines = Query(tables.table(spark, folder, "lineitem"), "lineitem").rename(l_partkey="l_partkey", l_quantity="l_quantity", price=price())
    means = lines.rename(key=F.col("l_partkey"), quantity=F.col("l_quantity").cast("decimal(12,2)"), one=F.lit(1).cast("long")).group_by("key").aggregates(quantity=("sum", "quantity"), n=("sum", "one"))
    parts = Query(tables.part(spark, folder), "part").filter(F.col("p_brand") == "Brand#23", F.col("p_container") == MED_BOX).group_by("p_partkey").aggregates()
    limits = means.semi_join(parts, "key", "p_partkey").rename(key="key", limit=0.2 * F.col("quantity").cast("double") / F.col("n"))
    kept = lines.equi_join(limits, "l_partkey", "key").filter(F.col("l_quantity") < F.col("limit")).aggregate(total=("sum", "price"))
    return kept.rename(avg_yearly=F.round(F.col("total").cast("double") / 7.0, 6)).to_df()


Q19 = """
    SELECT coalesce(sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2))), 0)::DOUBLE AS revenue
    FROM lineitem JOIN (SELECT *, (p_partkey * 3) % 13 AS c FROM part) ON l_partkey = p_partkey
    WHERE (l_orderkey * 3 + l_linenumber) % 6 = 1 AND (l_orderkey + l_linenumber) % 3 IN (1, 2) AND (
        (p_brand = 'Brand#12' AND c IN (0, 1, 2, 3) AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
        OR (p_brand = 'Brand#23' AND c IN (4, 5, 6, 7) AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
        OR (p_brand = 'Brand#24' AND c IN (9, 10, 11, 12) AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15))
"""


def q19(spark: SparkSession, folder: str, config: object = JoinConfig()) -> Query:  # noqa: B008
    def one(brand: str, containers: tuple[int, ...], quantity: int, size: int) -> Column:
        return (F.col("p_brand") == brand) & F.col("p_container").isin(*containers) & F.col("l_quantity").between(quantity, quantity + 10) & F.col("p_size").between(1, size)

    either = one("Brand#12", SMALL, 1, 5) | one("Brand#23", MEDIUM, 10, 10) | one("Brand#24", LARGE, 20, 15)
    parts = Query(tables.part(spark, folder), "part").rename(p_partkey="p_partkey", p_brand="p_brand", p_size="p_size", p_container="p_container")
    return (
        Query(tables.lineitem(spark, folder), "lineitem")
        .filter(F.col("l_shipinstruct") == IN_PERSON, F.col("l_shipmode").isin(AIR, AIR_REG))
        .equi_join(parts, "l_partkey", "p_partkey", config=config)
        .filter(either)
        .rename(price=discounted())
        .aggregate(revenue=("sum", "price"))
        .cast("revenue", "double")
    )


#: Physical forms of query 19; all give the same rows.
Q19_FORMS = {
    "tpch_q19": JoinConfig(),
    "join_broadcast": JoinConfig("broadcast"),
    "join_shuffle_hash": JoinConfig("shuffle_hash"),
    "join_partitioned": JoinConfig("partitioned"),
    "join_gather": JoinConfig(gather=True),
}
for _name, _config in Q19_FORMS.items():
    query(Q19, _name)(lambda spark, folder, config=_config: q19(spark, folder, config).to_df())


def q19_variants(spark: SparkSession, folder: str) -> list[Query]:
    return list(q19(spark, folder, choice(*Q19_FORMS.values())).variants())


@query("""
    WITH t AS (SELECT l_quantity, (l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(15,4) AS x FROM lineitem),
        m AS (SELECT round(sum(x)::DOUBLE / count(*), 4)::DECIMAL(15,4) AS mean FROM t)
    SELECT coalesce(sum((x - mean)::DECIMAL(15,4) * (x - mean)::DECIMAL(15,4)), 0)::DOUBLE AS squares FROM t, m WHERE l_quantity > 25
""")
def funky_square_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Squared distances from the mean of all rows, over some of them."""
    t = rows.project(tables.table(spark, folder, "lineitem"), x=discounted().cast("decimal(15,4)"), l_quantity="l_quantity")
    mean = aggregate.aggregate(t, total=("sum", "x"), n=("sum", F.lit(1).cast("long"))).select(F.round(F.col("total").cast("double") / F.col("n"), 4).cast("decimal(15,4)").alias("mean"))
    beside = rows.zip_scalar(rows.mask(t, F.col("l_quantity") > 25), mean)
    off = rows.project(beside, off=(F.col("x") - F.col("mean")).cast("decimal(15,4)"))
    return aggregate.aggregate(rows.project(off, square=F.col("off") * F.col("off")), squares=("sum", "square")).select(F.col("squares").cast("double"))
