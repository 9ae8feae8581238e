"""Joins: equality with a residual, semi, cross and theta; hints choose the physical form, never the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.relation import Relation, number
from millrace.operators.rows import collect
from millrace.types import AlgebraError, require


@dataclass(frozen=True)
class JoinConfig:
    """strategy: auto, broadcast (if the right side is within ``broadcast_bytes`` by its statistics, else as auto),
    shuffle_hash, merge, or partitioned into ``partitions``; dedup: equal right rows count once; gather: fetch right columns by position.
    """

    strategy: str = "auto"
    partitions: int = 0
    dedup: bool = False
    gather: bool = False
    broadcast_bytes: int = 64 << 20


STRATEGIES = ("auto", "broadcast", "shuffle_hash", "merge", "partitioned")


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _hinted(right: DataFrame, config: JoinConfig) -> DataFrame:
    if config.strategy not in STRATEGIES:
        raise AlgebraError(f"join: no strategy {config.strategy!r}")
    if config.strategy == "broadcast":
        return F.broadcast(right) if plan_bytes(right) <= config.broadcast_bytes else right
    hint = {"shuffle_hash": "shuffle_hash", "merge": "merge"}.get(config.strategy)
    return right.hint(hint) if hint else right


def equi_join(
    left: Relation, right: Relation, left_keys: str | Sequence[str], right_keys: str | Sequence[str], residual: Column | None = None, config: JoinConfig = JoinConfig()  # noqa: B008
) -> Relation:
    """Inner join on equal keys, and a residual over both sides' columns. Both sides' keys stay."""
    lk, rk = ([k] if isinstance(k, str) else list(k) for k in (left_keys, right_keys))
    left, right = collect(left), collect(right)
    require(left.rows, lk, "join's left side")
    require(right.rows, rk, "join's right side")
    if clash := set(left.columns) & set(right.columns):
        raise AlgebraError(f"join: both sides have {sorted(clash)}; rename one")
    table = right.to_df()
    if config.dedup:
        table = table.distinct()
    on = [F.col(a) == F.col(b) for a, b in zip(lk, rk, strict=True)]
    if residual is not None and not config.gather:
        on.append(residual)
    if config.gather:
        # Keys and positions join first; the other right columns are fetched by position.
        order = right.order if right.order and set(right.order) <= set(table.columns) else table.columns
        numbered = number(table, order, "__at")
        slim = _hinted(numbered.select(*rk, "__at"), config)

        def make(df: DataFrame) -> DataFrame:
            out = df.join(slim, on).drop(*rk).join(numbered, "__at").drop("__at")
            return out if residual is None else out.filter(residual)

    elif config.strategy == "partitioned":
        n = config.partitions or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = _hinted(table.repartition(n, *rk), config)
        make = lambda df: df.repartition(n, *lk).join(placed, on)
    else:
        hinted = _hinted(table, config)
        make = lambda df: df.join(hinted, on)
    return left.map(make)


def semi_join(left: Relation, right: Relation, left_key: str, right_key: str) -> Relation:
    """Left rows whose key the right side has."""
    left, table = collect(left), right.to_df()
    require(left.rows, [left_key], "semi join's left side")
    require(table, [right_key], "semi join's right side")
    keys = table.select(F.col(right_key).alias("__key"))
    return left.map(lambda df: df.join(keys, F.col(left_key) == F.col("__key"), "left_semi"))


def theta_join(left: Relation, right: Relation, condition: Column) -> Relation:
    """Inner join on any condition over both sides' columns."""
    left, table = collect(left), right.to_df()
    if clash := set(left.columns) & set(table.columns):
        raise AlgebraError(f"join: both sides have {sorted(clash)}; rename one")
    return left.map(lambda df: df.join(table, condition))


def cross(left: Relation, right: Relation) -> Relation:
    """All pairs."""
    left, table = collect(left), right.to_df()
    if clash := set(left.columns) & set(table.columns):
        raise AlgebraError(f"cross: both sides have {sorted(clash)}; rename one")
    return left.map(lambda df: df.crossJoin(table))
