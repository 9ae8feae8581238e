"""The six combiners, over groups, over slices and across slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.relation import Relation, bounded, positioned
from millrace.operators.rows import collect, named, with_position
from millrace.types import AlgebraError, require

Combine = Callable[[Column], Column]
#: Each combiner and what it gives for no rows: sums 0, products 1, and true, or false; a least or greatest value is null.
COMBINERS: dict[str, tuple[Combine, object]] = {
    "sum": (F.sum, 0),
    "product": (F.product, 1.0),
    "min": (F.min, None),
    "max": (F.max, None),
    "and": (F.bool_and, True),
    "or": (F.bool_or, False),
}


#: For what gives no rows: the combiner's identity. None gives null.
IDENTITY = object()


def combine(op: str, column: Column, init: object = IDENTITY) -> Column:
    """The aggregate, and for no rows ``init``."""
    if op not in COMBINERS:
        raise AlgebraError(f"no combiner {op!r}")
    f, none = COMBINERS[op]
    empty = none if init is IDENTITY else init
    return f(column) if empty is None else F.coalesce(f(column), F.lit(empty))


def aggregate(rel: Relation, keys: list[str | int] | None = None, **columns: tuple[str, str | int | Column]) -> DataFrame:
    """columns: name = (combiner, column). With keys one row per group, the aggregates first and then the keys; else one row.

    Keys and columns are named or given by ordinal.
    """
    df = rel.to_df()
    keys = None if keys is None else [named(rel, k) for k in keys]
    require(df, keys or [], "aggregate")
    value = lambda c: c if isinstance(c, Column) else F.col(named(rel, c))
    made = [combine(op, value(c), init=None if keys else IDENTITY).alias(name) for name, (op, c) in columns.items()]
    if keys is None:
        return df.agg(*made)
    if not made:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*made).select(*columns, *keys)


def reduce_slices(rel: Relation, op: str, column: str | int, name: str, init: object = IDENTITY) -> DataFrame:
    """One row per innermost slice, empty and wholly masked ones too, which give ``init``; without slices one row."""
    rel = collect(rel)
    value = F.col(named(rel, column))
    if not rel.slices:
        return rel.rows.agg(combine(op, value, init).alias(name))
    found = rel.df.groupBy(*rel.slices).agg(combine(op, value, init).alias(name))
    every = rel.grid().join(bounded(found.withColumn("__some", F.lit(True)), rel.sizes), list(rel.slices), "left")
    none = COMBINERS[op][1] if init is IDENTITY else init
    kept = F.col(name) if none is None else F.when(F.col("__some"), F.col(name)).otherwise(F.lit(none))
    return every.select(*rel.slices, kept.cast(found.schema[name].dataType).alias(name))


def nested_reduce(rel: Relation, op: str, column: str, name: str) -> DataFrame:
    """Across the innermost slices: the first elements of all combined, the second, and so on; ``place`` says which."""
    if not rel.slices:
        raise AlgebraError("nested_reduce: there is no slice level")
    placed = with_position(positioned(rel), "place", relative=True)
    df = collect(placed).df
    return df.groupBy(*rel.slices[:-1], "place").agg(combine(op, F.col(column)).alias(name))


def two_phase(rel: Relation, keys: list[str], **columns: tuple[str, str]) -> DataFrame:
    """Groups within slices first, then over slices; without keys one row.

    Combiners are associative and commutative, so it does not matter which slice a row is in: a task groups the rows that it holds, and
    the groups of tasks meet. No slice is numbered for it.
    """
    rows = collect(rel).rows
    made = [combine(op, F.col(c), init=None if keys else IDENTITY).alias(name) for name, (op, c) in columns.items()]
    return rows.groupBy(*keys).agg(*made)


def count(rel: Relation, name: str = "n") -> DataFrame:
    """The number of valid rows."""
    return rel.to_df().agg(F.count(F.lit(1)).alias(name))


