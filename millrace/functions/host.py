"""Python functions of one value as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.expr import PRIMITIVES
from millrace.types import AlgebraError


def host_function(f: Callable[[object], object], primitive: str) -> Callable[[Column], Column]:
    """f on each value, in Arrow batches, giving a primitive type; a null stays null and is not shown to f."""
    if primitive not in PRIMITIVES:
        raise AlgebraError(f"no primitive type {primitive!r}")

    @F.pandas_udf(PRIMITIVES[primitive])
    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return run
