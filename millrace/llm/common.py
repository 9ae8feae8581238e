"""What the training-data operators share: tables in the shared folder, running totals, batches, joins on keys that many rows have.

Nothing here collects rows to the driver but one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from millrace.storage import delete, discard, materialise, own_dir, settled

__all__ = ["delete", "discard", "materialise", "only", "own_dir", "running_total", "salted_join", "sampled", "settled", "small", "spread", "table", "with_fields"]

#: Rows, and bytes of text, that a Python worker looks at together: its memory is bounded with long documents, too.
TOGETHER_ROWS, TOGETHER_BYTES = 256, 8 << 20
#: Keys dealt to several places at most, and rows of a key that one place takes at least.
HEAVY_KEYS, LIGHT_ROWS = 1 << 16, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table of one small file would keep one core busy. Large tables stay as they are.

    So does what comes out of a shuffle, which adaptive execution spreads, and which would run to be asked.
    """
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def small(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows and few bytes of the column ``text``, or of one row that is larger by itself."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < b.num_rows:
            fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER_BYTES, side="right"))
            stop = min(at + TOGETHER_ROWS, max(fits, at + 1), b.num_rows)
            yield b.slice(at, stop - at)
            at = stop


def sampled(rows: DataFrame, sample: int, columns: Sequence[str]) -> DataFrame:
    """About ``sample`` distinct rows at most, drawn by a hash of ``columns``: rows alike in these count once, however many there are."""
    total = rows.count()
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64(*columns, F.lit("sample")), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    return rows.dropDuplicates(list(columns))


def salted_join(rows: DataFrame, values: DataFrame, key: str, deal: Sequence[str], total: int | None = None, how: str = "inner") -> DataFrame:
    """rows with what ``values`` has for their key: one row a key, with ``n``, about how many rows have that key.

    Rows of a key that many have are dealt to several places by a hash of the columns ``deal``, and the key's row of values
    goes to each, so no task gets all rows of a key. A key is dealt out if its n is more than LIGHT_ROWS and than a
    HEAVY_KEYS-th of the sum of n (``total`` if known); so there are at most HEAVY_KEYS such keys, which are broadcast.
    """
    if total is None:
        sums = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__all"))
        values = values.crossJoin(F.broadcast(sums))  # one row
        most: Column = F.greatest(F.lit(LIGHT_ROWS), F.col("__all") / HEAVY_KEYS)
    else:
        most = F.lit(max(LIGHT_ROWS, total / HEAVY_KEYS))
    values = values.withColumn("__places", F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")).drop("__all", "n")
    heavy = values.filter("__places > 1").select(key, F.col("__places").alias("__of"))
    rows = rows.join(F.broadcast(heavy), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*deal), F.coalesce("__of", F.lit(1))).cast("int")).drop("__of")
    values = values.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__places") - 1))).drop("__places")
    return rows.join(values, [key, "__salt"], how).drop("__salt")


def running_total(df: DataFrame, order: str, value: str, total: str) -> DataFrame:
    """Add ``total``: the sum of ``value`` over all rows before this one in ascending ``order``; nulls come first, equal values in any order.

    Rows are dealt to ranges of ``order`` and, where many rows have one value, of a number of their own, so df must give its rows
    in the same partitions whenever it is read. The driver gets one sum per range, and no task sees more than its own range.
    """
    spark = df.sparkSession
    keys = [F.col(order).asc_nulls_first(), F.col("__tie")]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn("__range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    before, sums = 0, []
    for row in ranged.groupBy("__range").agg(F.sum(value).alias("n")).orderBy("__range").collect():
        sums.append((row["__range"], before))
        before += row["n"] or 0
    offsets = spark.createDataFrame(sums, "__range int, __before long")
    inside = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "__range")  # one row per partition
        .withColumn(total, (F.col("__before") + F.col("__inside")).cast("long"))
        .drop("__range", "__tie", "__before", "__inside")
    )


def only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns of df; whatever else the table has cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def with_fields(df: DataFrame, column: str, ddl: str) -> StructType:
    """The schema of a column of df, of any type and name, followed by the fields of ``ddl``."""
    return StructType([df.schema[column], *StructType.fromDDL(ddl).fields])
