"""Primitive types, schema checks and the states of a histogram."""

from __future__ import annotations

from collections.abc import Iterable
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class AlgebraError(ValueError):
    """An operator was given what its type rule refuses; ``path`` names the operators around it."""

    def __init__(self, message: str, path: Iterable[str] = ()):
        self.path = tuple(path)
        super().__init__(" > ".join([*self.path, message]) if self.path else message)


# The algebra's primitive types, each as the narrowest Spark type that holds all its values.
PRIMITIVES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int": T.IntegerType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint": T.LongType(), "index": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(), "double": T.DoubleType(),
}

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_integral(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGRAL) or isinstance(kind, T.DecimalType) and kind.scale == 0


def accepts(to: T.DataType, given: T.DataType) -> bool:
    """Integers accept each other; a float accepts integers, a double also floats; else types are equal."""
    if is_integral(to):
        return is_integral(given)
    if isinstance(to, T.DoubleType):
        return is_integral(given) or isinstance(given, (T.FloatType, T.DoubleType))
    if isinstance(to, T.FloatType):
        return is_integral(given) or isinstance(given, T.FloatType)
    return to == given


def check_schema(df: DataFrame, declared: T.StructType) -> DataFrame:
    """df, if the declared schema accepts its own: as many fields, in order, the same names, accepted types."""
    given = df.schema
    if len(given) != len(declared):
        raise AlgebraError(f"{len(declared)} columns declared, {len(given)} given")
    for to, by in zip(declared, given, strict=True):
        if to.name and to.name != by.name:
            raise AlgebraError(f"column {to.name!r} declared, {by.name!r} given")
        if not accepts(to.dataType, by.dataType):
            raise AlgebraError(f"column {to.name!r}: {to.dataType.simpleString()} does not accept {by.dataType.simpleString()}")
    return df


def require(df: DataFrame, columns: Iterable[str], what: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise AlgebraError(f"{what}: no column {', '.join(map(repr, missing))} among {df.columns}")


class HistogramState(Enum):
    """A histogram is built, then reduced to offsets, then moved by a partition, once each."""

    BUILT = "built"
    REDUCED = "reduced"
    MOVED = "moved"
