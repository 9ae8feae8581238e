"""A relation: a DataFrame with an order key and hidden columns for validity, position and slices."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.storage import materialise
from millrace.types import AlgebraError, require

VALID, POS = "__valid", "__pos"
#: Before the name of an order column that a projection does not show.
UNSEEN = "__by_"
#: Bytes of input for one range of an order, and the most ranges there are: their counts are broadcast.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 17
#: Slices whose bounds are broadcast at most; those of more are joined like any table.
MOST_SLICES = 1 << 17

Make = Callable[[DataFrame], DataFrame]


class Relation:
    """df with ``order``, the columns that put its rows in one total order, and ``slices``, outermost first, with their ``sizes``:
    how many slices the level has within each slice around it, empty ones counted.

    Hidden columns: VALID where a mask applies, POS where positions are needed, one per slice level,
    and order columns that are not shown, which cost nothing until an order is asked for.

    Slice numbers need positions, which need a pass over the table; so ``df`` may be given as a function that is called when
    somebody looks at slices, and ``rows`` are the same rows for whoever does not.
    """

    def __init__(
        self, df: DataFrame | Callable[[], DataFrame], order: Sequence[str] = (), slices: Sequence[str] = (), sizes: Sequence[int] = (), rows: DataFrame | None = None
    ):
        if len(slices) != len(sizes):
            raise AlgebraError("each slice level needs the number of its slices")
        if rows is None and callable(df):
            raise AlgebraError("a relation whose df is made later needs rows")
        self._df, self.order, self.slices, self.sizes = df, tuple(order), tuple(slices), tuple(sizes)
        self.rows: DataFrame = df if rows is None else rows

    @cached_property
    def df(self) -> DataFrame:
        return self._df() if callable(self._df) else self._df

    @property
    def deferred(self) -> bool:
        return callable(self._df)

    @property
    def hidden(self) -> list[str]:
        return hidden(self.rows.columns, self.slices)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c not in self.hidden]

    @property
    def masked(self) -> bool:
        return VALID in self.rows.columns

    def map(self, make: Make, order: Sequence[str] | None = None) -> Relation:
        """The relation after something done to each row, or to which rows there are, that does not look at slices."""
        order = self.order if order is None else order
        if not self.deferred:
            return Relation(make(self.df), order, self.slices, self.sizes)
        return Relation(lambda: make(self.df), order, self.slices, self.sizes, make(self.rows))

    def with_df(self, df: DataFrame) -> Relation:
        return Relation(df, self.order, self.slices, self.sizes)

    def to_df(self) -> DataFrame:
        """The valid rows, without hidden columns."""
        df = self.rows.filter(VALID) if self.masked else self.rows
        return df.drop(*self.hidden)

    def grid(self, levels: int | None = None) -> DataFrame:
        """One row for every slice of the outer ``levels`` (all if not given), empty ones too: their numbers."""
        return grid(self.rows.sparkSession, self.slices[:levels], self.sizes[:levels])


def hidden(columns: Sequence[str], slices: Sequence[str]) -> list[str]:
    return [c for c in columns if c in (VALID, POS, *slices) or c.startswith(UNSEEN)]


def valid(df: DataFrame) -> Column:
    return F.col(VALID) if VALID in df.columns else F.lit(True)


def relation(df: DataFrame, *order: str) -> Relation:
    require(df, order, "order key")
    return Relation(df, order)


def grid(spark: SparkSession, slices: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    out, below = [], prod(sizes)
    for name, n in zip(slices, sizes, strict=True):
        below //= n
        out.append((F.expr(f"id div {below}") % n).cast("int").alias(name))
    return spark.range(prod(sizes)).select(*out)


def ranges_of(df: DataFrame) -> int:
    """How many ranges an order of df is cut into: by the bytes of the tables it reads, and not fewer than a shuffle has."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(max(-(-size // RANGE_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_RANGES)


def number(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add the contiguous position of each row in ascending order, from 0; nulls come first.

    Rows are dealt to ranges of all order columns together, so that a value many rows share is no range of its own, sorted
    in them and written to the shared folder, with each row's place in its range: no shuffle but that one, and no task larger than its
    range. A range starts where the rows of lower ranges end; the counts, one row a range, are taken from what is written.
    """
    if not order:
        raise AlgebraError("positions need an order key")
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(ranges_of(df), *keys).sortWithinPartitions(*keys)
    # The low 33 bits of the id count the rows of a partition, in their order.
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = materialise(ranged.withColumn("__range", F.spark_partition_id()).withColumn("__nth", nth), "ranges")
    counts = written.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    placed = written.join(F.broadcast(starts), "__range")  # MOST_RANGES rows at most
    return placed.withColumn(name, (F.col("__start") + F.col("__nth")).cast("long")).drop("__range", "__nth", "__start")


def positioned(rel: Relation) -> Relation:
    """rel with POS; valid and invalid rows alike have one."""
    if POS in rel.rows.columns:
        return rel
    return rel.with_df(number(rel.df, rel.order, POS))


def bounded(df: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """A table of at most one row per slice, broadcast if there are few enough."""
    return F.broadcast(df) if prod(sizes) <= MOST_SLICES else df


def within(rel: Relation) -> Relation:
    """A positioned, sliced relation with __at, each row's place in its innermost slice, and __rows, how many that has.

    Slices hold neighbouring rows, so a place is a position less the slice's least one; no slice goes to one task.
    """
    bounds = rel.df.groupBy(*rel.slices).agg(F.min(POS).alias("__first"), F.count(F.lit(1)).alias("__rows"))
    df = rel.df.join(bounded(bounds, rel.sizes), list(rel.slices))
    return rel.with_df(df.withColumn("__at", F.col(POS) - F.col("__first")).drop("__first"))
