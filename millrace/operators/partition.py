"""Histograms of buckets, offsets, stable partitions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import bit_range, hash64
from millrace.operators.relation import POS, Relation, bounded, grid, number, positioned, within
from millrace.operators.rows import collect, project, split, zip_rows
from millrace.types import AlgebraError, HistogramState, is_integral, require

#: Buckets that one task sums up; only one sum for so many goes to a single task.
RUN = 4_096


@dataclass(frozen=True)
class Histogram:
    """df: bucket and count, then bucket and offset, one row for each of ``buckets`` buckets, empty ones too.

    ``make`` gives df; a histogram that only passes from one operator to the next is never counted.
    """

    make: Callable[[], DataFrame]
    buckets: int
    state: HistogramState
    depth: int = 0
    slices: tuple[str, ...] = field(default=())

    @cached_property
    def df(self) -> DataFrame:
        return self.make()


def histogram(rel: Relation, bucket: str, buckets: int) -> Histogram:
    """Valid rows per bucket in [0, buckets), for each innermost slice if there are slices, empty ones too."""
    require(rel.rows, [bucket], "histogram")
    if not is_integral(rel.rows.schema[bucket].dataType):
        raise AlgebraError(f"histogram: {bucket!r} is not an integer")

    def make() -> DataFrame:
        rows = collect(rel).df
        counted = rows.groupBy(*rel.slices, F.col(bucket).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
        every = grid(rows.sparkSession, [*rel.slices, "bucket"], [*rel.sizes, buckets]).withColumn("bucket", F.col("bucket").cast("long"))
        full = every.join(bounded(counted, [*rel.sizes, buckets]), [*rel.slices, "bucket"], "left")
        return full.withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))

    return Histogram(make, buckets, HistogramState.BUILT, len(rel.slices), rel.slices)


def _before(counts: DataFrame, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over lower buckets: within runs of buckets, and over the sums of runs."""
    counts = counts.withColumn("__run", F.expr(f"bucket div {RUN}"))
    inside = F.sum(value).over(Window.partitionBy("__run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = counts.groupBy("__run").agg(F.sum(value).alias("__sum"))
    lower = F.sum("__sum").over(Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__run", F.coalesce(lower, F.lit(0)).alias("__lower"))
    joined = counts.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(sums, "__run")
    return joined.withColumn(out, (F.col("__lower") + F.col("__inside")).cast("long")).drop("__run", "__inside", "__lower")


def offsets(hist: Histogram, disjoint: bool = False) -> Histogram:
    """Exclusive prefix sums, bucket by bucket and within a bucket slice by slice; a last row has the total.

    With ``disjoint`` every slice counts from 0 and has its own total.
    """
    if hist.state is not HistogramState.BUILT:
        raise AlgebraError(f"offsets: the histogram is {hist.state.value}")
    slices, none = list(hist.slices), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("offset")

    def make() -> DataFrame:
        if disjoint and slices:
            before = F.sum("count").over(Window.partitionBy(*slices).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
            run = hist.df.select(*slices, "bucket", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))
            last = hist.df.groupBy(*slices).agg(none).select(*slices, F.lit(hist.buckets).cast("long").alias("bucket"), "offset")
            return run.unionByName(last)
        total = hist.df.groupBy("bucket").agg(F.sum("count").alias("__all"))
        run = _before(total, "__all", "__start").drop("__all")
        earlier = F.sum("count").over(Window.partitionBy("bucket").orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)) if slices else F.lit(0)
        run = hist.df.withColumn("__earlier", F.coalesce(earlier, F.lit(0))).join(run, "bucket")
        run = run.select(*slices, "bucket", (F.col("__start") + F.col("__earlier")).cast("long").alias("offset"))
        missing = [F.lit(None).cast("int").alias(s) for s in slices]
        return run.unionByName(hist.df.agg(none).select(*missing, F.lit(hist.buckets).cast("long").alias("bucket"), "offset"))

    return replace(hist, make=make, state=HistogramState.REDUCED)


def partition(rel: Relation, bucket: str, hist: Histogram, values: Relation | None = None, disjoint: bool = False) -> tuple[Relation, Histogram]:
    """Rows in order of bucket, and within one in their own order; the histogram counts as moved.

    With ``values`` the rows of that relation are moved, each by the bucket at its position in ``rel``. The result has a slice level __bucket
    and a column ``place``, each row's position in the new order; with ``disjoint`` every bucket is a buffer of its own
    and places count from 0 in each.
    """
    if hist.state is not HistogramState.REDUCED:
        raise AlgebraError(f"partition: the histogram is {hist.state.value}, not reduced")
    if hist.depth != len(rel.slices):
        raise AlgebraError(f"partition: the histogram is {hist.depth} deep, the rows {len(rel.slices)}")
    moved = replace(hist, state=HistogramState.MOVED)
    if values is not None:
        if len(values.slices) != len(rel.slices):
            raise AlgebraError(f"partition: the keys are {len(rel.slices)} deep, the values {len(values.slices)}")
        rel = zip_rows(project(rel, **{bucket: bucket}), values)
    rel = collect(rel)
    # Slices hold neighbouring rows, so within a bucket the rows' order is that of slices too.
    df, order = rel.rows, list(rel.order)
    if POS in df.columns:
        df, order = df.withColumnRenamed(POS, "__by_pos"), ["__by_pos" if c == POS else c for c in order]
    df = number(df, [bucket, *(c for c in order if c != bucket)], POS).withColumn("__bucket", F.col(bucket).cast("int"))
    out = Relation(df.drop(*rel.slices, "__by_pos"), (POS,), ("__bucket",), (hist.buckets,))
    if disjoint:
        at = within(out)
        return at.with_df(at.df.withColumnRenamed("__at", "place").drop("__rows")), moved
    return out.with_df(out.df.withColumn("place", F.col(POS))), moved


def compact_slices(rel: Relation, padding: int = 0) -> tuple[Relation, Histogram]:
    """Without invalid rows, and the rows left in each slice, empty ones too, as a histogram.

    ``place`` is a row's place in a buffer that holds the slices one after the other, each followed by ``padding`` unused places.
    """
    if len(rel.slices) != 1:
        raise AlgebraError(f"compact: {len(rel.slices)} slice levels, and not one")
    if padding < 0:
        raise AlgebraError("compact: a negative padding")
    (level,), (n,) = rel.slices, rel.sizes
    at = within(positioned(collect(rel)))
    counts = histogram(Relation(at.df.withColumn("__slice", F.col(level))), "__slice", n)
    starts = offsets(counts).df.select(F.col("bucket").alias("__b"), "offset")
    df = at.df.join(bounded(starts, [n + 1]), F.col(level) == F.col("__b"))
    df = df.withColumn("place", (F.col("offset") + padding * F.col(level) + F.col("__at")).cast("long"))
    return at.with_df(df.drop("__b", "offset", "__at", "__rows")), counts


def restore_histogram(hist: Histogram) -> Histogram:
    """A moved histogram as it was before: offsets here never move with the rows."""
    if hist.state is not HistogramState.MOVED:
        raise AlgebraError(f"restore_histogram: the histogram is {hist.state.value}, not moved")
    return replace(hist, state=HistogramState.REDUCED)


@dataclass(frozen=True)
class HashConfig:
    """How keys become buckets: the top ``bits`` of the hash, the key's own bits down from ``msb`` if width is 0, or one bucket if bits is 0 too."""

    width: int = 32
    bits: int = 8
    msb: int | None = None

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    def bucket(self, key: Column) -> Column:
        if self.bits == 0:
            return F.lit(0).cast("int")
        if self.width == 0:
            msb = self.bits - 1 if self.msb is None else self.msb
            return bit_range(key, msb, msb - self.bits + 1).cast("int")
        return hash64([(key, self.width)], self.bits).cast("int")


def radix_partition(rel: Relation, key: str, msb: int, lsb: int, hash: Callable[[Column], Column] | None = None, slices: int = 0) -> tuple[Relation, Histogram]:
    """Histogram, offsets, partition and restored histogram over a range of the bits of a key, or of its ``hash``.

    The rows may be cut into ``slices`` first, whose histograms are merged; the order stays the same.
    """
    require(rel.rows, [key], "radix partition")
    bits = bit_range(hash(F.col(key)) if hash else F.col(key), msb, lsb)
    keyed = rel.map(lambda df: df.withColumn("bucket", bits))
    keyed = split(keyed, slices) if slices > 1 else keyed
    hist = offsets(histogram(keyed, "bucket", 1 << (msb - lsb + 1)))
    rows, moved = partition(keyed, "bucket", hist)
    return rows, restore_histogram(moved)


def hash_partition(rel: Relation, key: str, n: int) -> Relation:
    """The same rows, placed by key for what comes next."""
    require(rel.rows, [key], "hash partition")
    return rel.map(lambda df: df.repartition(n, key))
