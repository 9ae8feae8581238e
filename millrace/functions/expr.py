"""Scalar expressions that Spark's own operators do not give as the algebra means them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.types import PRIMITIVES, AlgebraError

Value = Column | int | float | bool


def _col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def int_div(a: Value, b: Value) -> Column:
    """Integer division, truncating toward zero: -7 by 2 is -3."""
    return F.call_function("div", _col(a), _col(b))


def int_pow(a: Value, b: Value) -> Column:
    """a to the power of b >= 0 in 64-bit integers, exactly, by squaring; a power beyond them raises, and null gives null."""
    step = F.struct(F.lit(1).cast("long").alias("out"), _col(a).cast("long").alias("square"), _col(b).cast("int").alias("left"))

    def double(s: Column, _: Column) -> Column:
        odd, more = s["left"].bitwiseAND(F.lit(1)) == 1, s["left"] > 1  # a square beyond the last bit is not needed, and may not fit
        return F.struct(
            F.when(odd, s["out"] * s["square"]).otherwise(s["out"]).alias("out"),
            F.when(more, s["square"] * s["square"]).otherwise(s["square"]).alias("square"),
            F.shiftright(s["left"], 1).alias("left"),
        )

    bits = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(F.bin(_col(b).cast("long")))))
    return F.when(_col(a).isNotNull() & _col(b).isNotNull(), F.aggregate(bits, step, double, lambda s: s["out"]))


def pow2(n: Value) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), _col(n).cast("int"))


def log2_up(n: Value) -> Column:
    """The least k with 2**k >= n, for n >= 1: 0, 1, 2, 2, 3 for 1 to 5."""
    return F.length(F.bin((_col(n) - 1).cast("long"))).cast("int") * (_col(n) > 1).cast("int")


def bit_range(value: Value, msb: int, lsb: int) -> Column:
    """Bits msb down to lsb of an integer, as a number."""
    if not 63 >= msb >= lsb >= 0:
        raise AlgebraError(f"bit range {msb} to {lsb}")
    mask = (1 << (msb - lsb + 1)) - 1
    return F.shiftrightunsigned(_col(value).cast("long"), lsb).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long"))


def cast_to(value: Value, primitive: str) -> Column:
    """Cast to a primitive type by its name; a float becomes an integer by truncation toward zero."""
    if primitive not in PRIMITIVES:
        raise AlgebraError(f"no primitive type {primitive!r}")
    return _col(value).cast(PRIMITIVES[primitive])


def not_equal(a: Value, b: Value) -> Column:
    return ~(_col(a) == _col(b))
