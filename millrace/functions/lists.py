"""Operations on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate_left(values: Column, n: int) -> Column:
    """The first n values moved to the end; n counts modulo the length."""
    size = F.size(values)
    k = F.when(size > 0, F.pmod(F.lit(n), size)).otherwise(0)
    return F.concat(F.slice(values, k + 1, size), F.slice(values, F.lit(1), k))


def rotate_right(values: Column, n: int) -> Column:
    return rotate_left(values, -n)


def prefix_sum(values: Column) -> Column:
    """Exclusive running sums: the sum of the values before each."""
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("sum"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.array(s["sum"])).alias("out"), (s["sum"] + x).cast("long").alias("sum"))
    return F.aggregate(values, zero, step, lambda s: s["out"])


def fill(value: Column, n: int) -> Column:
    return F.array_repeat(value, n)
