"""Readers, writers, host rows and a synthetic generator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.relation import Relation, relation
from millrace.types import AlgebraError

FORMATS = ("parquet", "orc", "csv", "json")

# Measured on the tables this library is tested on: the shortest prefix of columns that is unique.
ORDER_KEYS = {
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"),
    "conversations": ("conv_id", "turn"),
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",),
    "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",),
}


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table in files. Text formats take a declared schema; nothing is inferred by reading the data twice."""
    if fmt not in FORMATS:
        raise AlgebraError(f"no format {fmt!r}")
    if fmt in ("csv", "json") and schema is None:
        raise AlgebraError(f"{fmt} needs a declared schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table behind JDBC, read in parallel over ranges of an integer column if given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Iterable[str] = ()) -> None:
    if fmt not in FORMATS:
        raise AlgebraError(f"no format {fmt!r}")
    writer = df.write.format(fmt).mode(mode)
    if names := list(partition_by):
        writer = writer.partitionBy(*names)
    writer.save(path)


def table(spark: SparkSession, folder: str, name: str) -> Relation:
    """A Parquet table of a folder, in the order of its key."""
    return relation(read(spark, f"{folder}/{name}.parquet"), *ORDER_KEYS.get(name, ()))


def from_rows(spark: SparkSession, rows: Iterable, schema: StructType | str, *order: str) -> Relation:
    """Host rows as a relation."""
    return relation(spark.createDataFrame(list(rows), schema), *order)


def lineitem(spark: SparkSession, folder: str) -> Relation:
    """lineitem with the codes that the table does not have, derived from its keys."""
    t = table(spark, folder, "lineitem")
    return t.with_df(
        t.df.withColumn("l_shipmode", ((F.col("l_orderkey") + F.col("l_linenumber")) % 3).cast("int")).withColumn(
            "l_shipinstruct", ((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 6).cast("int")
        )
    )


def part(spark: SparkSession, folder: str) -> Relation:
    """part with a container code derived from its key."""
    t = table(spark, folder, "part")
    return t.with_df(t.df.withColumn("p_container", ((F.col("p_partkey") * 3) % 13).cast("int")))


def generate(spark: SparkSession, scale: float, seed: int = 1) -> dict[str, DataFrame]:
    """Random part, orders and lineitem: 200,000, 1,500,000 and 1 to 7 times as many rows, times the scale."""

    def draw(name: str, n: int) -> F.Column:
        return F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(n))

    parts, orders = max(1, int(200_000 * scale)), max(1, int(1_500_000 * scale))
    price = lambda key: ((90_000 + F.pmod(key / 10, F.lit(20_001)) + 100 * (key % 1_000)) / 100).cast("decimal(18,2)").cast("double")
    part_df = spark.range(parts).select(
        F.col("id").alias("p_partkey"), draw("container", 39).cast("int").alias("p_container"), draw("brand", 25).cast("int").alias("p_brand"),
        (1 + draw("size", 49)).cast("int").alias("p_size"), draw("type", 150).cast("int").alias("p_type"), price(F.col("id")).alias("p_retailprice"),
    )
    order_df = spark.range(orders).select(F.col("id").alias("o_orderkey"), draw("date", 2_406).cast("int").alias("o_orderdate"), draw("customer", max(1, orders // 10)).alias("o_custkey"))
    lines = spark.range(orders).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), 1 + draw("lines", 7)))).withColumn("o", F.col("id")).withColumn("id", F.col("id") * 8 + F.col("n"))
    line_df = lines.select(
        F.col("o").alias("l_orderkey"), F.col("n").cast("int").alias("l_linenumber"), draw("part", parts).alias("l_partkey"), draw("quantity", 51).cast("double").alias("l_quantity"),
        (draw("discount", 11) / 100).alias("l_discount"), (draw("tax", 9) / 100).alias("l_tax"), draw("mode", 3).cast("int").alias("l_shipmode"),
        draw("instruct", 6).cast("int").alias("l_shipinstruct"), draw("ship", 2_557).cast("int").alias("l_shipdate"),
    )
    line_df = line_df.withColumn("l_extendedprice", F.round(F.col("l_quantity") * price(F.col("l_partkey")), 2))
    return {"part": part_df, "orders": order_df, "lineitem": line_df}
