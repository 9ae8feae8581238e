"""A multiplicative 64-bit hash, exact in 64-bit integers that never overflow."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.types import AlgebraError

#: Fixed value: the multiplier of the hash.
MULTIPLIER = 6542915301859449791
#: Numbers are multiplied by limbs of so many bits: sums of their products fit a signed integer.
LIMB = 22
LOW = (1 << LIMB) - 1


def _times(h: Column) -> Column:
    """h * MULTIPLIER modulo 2**64, both as the bits of a long."""
    z = [MULTIPLIER >> LIMB * i & LOW for i in range(3)]
    limbs = [F.shiftrightunsigned(h, LIMB * i).bitwiseAND(F.lit(LOW).cast("long")) for i in range(3)]
    out, carry = [], F.lit(0).cast("long")
    for k in range(3):
        total = carry
        for i in range(k + 1):
            total = total + limbs[i] * F.lit(z[k - i]).cast("long")
        out.append(F.shiftleft(total.bitwiseAND(F.lit(LOW).cast("long")), LIMB * k))
        carry = F.shiftrightunsigned(total, LIMB)
    return out[0].bitwiseOR(out[1]).bitwiseOR(out[2])


def _bound(h: Column, f: Callable[[Column], Column]) -> Column:
    """f(h) with h written down once, however often f uses it."""
    return F.transform(F.array(h), f)[0]


def hash64(fields: Sequence[tuple[Column, int]], bits: int) -> Column:
    """The top ``bits`` bits of the hash of integer fields, given as (column, width in bits).

    Fields are packed into a word, first field highest; when the next does not fit, the word is
    multiplied before it is shifted, and counts as empty. The result is a short, int, long or
    decimal(20,0) that holds them. A null field gives null.
    """
    if not fields or not 1 <= bits <= 64 or any(not 1 <= w <= 64 for _, w in fields):
        raise AlgebraError("hash64 takes fields of 1 to 64 bits and gives 1 to 64 bits")
    h, filled, multiplied = F.lit(0).cast("long"), 0, 0

    def times(x: Column) -> Column:
        # Each product uses its argument ten times; more than two inline would be a large expression.
        return _times(x) if multiplied < 2 else _bound(x, _times)

    for value, width in fields:
        if filled + width > 64:
            h, filled, multiplied = times(h), 0, multiplied + 1
        else:
            filled += width
        # Shifted bits leave the low ones free, so adding is setting them.
        field = value.cast("long") if width == 64 else value.cast("long").bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        h = field if width == 64 else F.shiftleft(h, width).bitwiseOR(field)
    top = F.shiftrightunsigned(times(h), 64 - bits)
    if bits > 32:
        exact = top.cast("decimal(20,0)")
        return exact if bits < 64 else F.when(top < 0, (exact + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(exact)
    return top.cast("smallint" if bits <= 8 else "int" if bits <= 16 else "bigint")
