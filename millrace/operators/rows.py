"""Projection, masks, order, slices and bundles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from millrace.operators.relation import POS, UNSEEN, VALID, Relation, hidden, positioned, valid, within
from millrace.storage import materialise
from millrace.types import AlgebraError, is_integral, require

# --- projection ------------------------------------------------------------------------------


def project(rel: Relation, **columns: Column | str) -> Relation:
    """The given columns, in order, under the given names. The rows' order stays, shown or not."""
    chosen = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    order, unseen = [], []
    for c in rel.order:
        shown = isinstance(columns.get(c), str) and columns[c] == c
        order.append(c if shown or c in rel.hidden else f"{UNSEEN}{c}")
        if order[-1] != c:
            unseen.append(F.col(c).alias(order[-1]))
    return rel.map(lambda df: df.select(*chosen, *hidden(df.columns, rel.slices), *unseen), order)


def named(rel: Relation, key: str | int) -> str:
    """A column's name, given it or the column's ordinal among those that show, from 0."""
    if isinstance(key, str):
        return key
    if not 0 <= key < len(rel.columns):
        raise AlgebraError(f"no column {key} among {len(rel.columns)}")
    return rel.columns[key]


def evaluate(rel: Relation, expr: Column, name: str = "value") -> Relation:
    """One column, computed row by row."""
    return project(rel, **{name: expr})


def rename(rel: Relation, keep: bool = False, prepend: bool = False, **columns: Column | str) -> Relation:
    """Computed columns: alone, after the others (keep), or before them (prepend). A name given again replaces its column."""
    if not columns:
        return rel
    rest = [c for c in rel.columns if c not in columns] if keep or prepend else []
    others = {c: c for c in rest}
    return project(rel, **(columns | others if prepend else others | columns))


def zip_rows(first: Relation, *others: Relation) -> Relation:
    """Relations side by side by position. Validity and slices are the first's; masks of others count for nothing."""
    out = positioned(first)
    for k, other in enumerate(others):
        if clash := set(out.columns) & set(other.columns):
            raise AlgebraError(f"zip: both sides have {sorted(clash)}")
        right = positioned(other).df.select(*other.columns, F.col(POS).alias(f"__pos_{k}"))
        out = out.with_df(out.df.join(right, F.col(POS) == F.col(f"__pos_{k}")).drop(f"__pos_{k}"))
    return out


def zip_scalar(rel: Relation, scalar: DataFrame) -> Relation:
    """Every row beside the one row of ``scalar``, an aggregate without groups."""
    return rel.map(lambda df: df.crossJoin(F.broadcast(scalar.limit(1))))


def cast(rel: Relation, column: str, to: str) -> Relation:
    require(rel.rows, [column], "cast")
    return rel.map(lambda df: df.withColumn(column, F.col(column).cast(to)))


def with_position(rel: Relation, name: str = "position", relative: bool = False) -> Relation:
    """Each row's position, from 0; relative counts within the innermost slice."""
    rel = positioned(rel)
    if not relative:
        return rel.with_df(rel.df.withColumn(name, F.col(POS)))
    if not rel.slices:
        raise AlgebraError("a relative position needs slices")
    at = within(rel)
    return at.with_df(at.df.withColumn(name, F.col("__at")).drop("__at", "__rows"))


# --- masks -----------------------------------------------------------------------------------


def mask(rel: Relation, condition: Column) -> Relation:
    """Rows that fail the condition become invalid and stay where they are."""
    if not isinstance(rel.rows.select(condition.alias("c")).schema["c"].dataType, BooleanType):
        raise AlgebraError("mask: the condition is not boolean")
    return rel.map(lambda df: df.withColumn(VALID, valid(df) & F.coalesce(condition, F.lit(False))))


def collect(rel: Relation) -> Relation:
    """Without invalid rows; positions are counted anew. Without a mask it changes nothing."""
    if not rel.masked:
        return rel
    return rel.map(lambda df: _renumbered(rel, df.filter(VALID).drop(VALID)))


def _renumbered(rel: Relation, df: DataFrame) -> DataFrame:
    """df without positions that hold no more, now that rows have gone."""
    return df.drop(POS) if rel.order != (POS,) else df


#: Rows are always contiguous here: to compact is to collect.
compact = collect


def filter_rows(rel: Relation, *conditions: Column, mode: str = "plain") -> Relation:
    """Rows for which all conditions hold. The modes differ in how, not in what: one filter, a mask for
    each condition in order (cracked), or a filter for each (collect)."""
    if mode == "cracked":
        for c in conditions:
            rel = mask(rel, c)
        return collect(rel)
    if mode not in ("plain", "collect"):
        raise AlgebraError(f"filter: no mode {mode!r}")
    rel = collect(rel)
    for c in conditions:
        rel = rel.map(lambda df, c=c: df.filter(c))
    return rel.map(lambda df: _renumbered(rel, df)) if conditions else rel


def distinct(rel: Relation) -> Relation:
    return Relation(rel.to_df().distinct())


# --- order -----------------------------------------------------------------------------------


def sort(rel: Relation, *keys: str | int) -> Relation:
    """Stable ascending sort by columns, named or by ordinal, within slices if there are any; positions follow the new order."""
    if not keys:
        raise AlgebraError("sort: no key")
    keys = tuple(named(rel, k) for k in keys)
    require(rel.rows, keys, "sort")
    rel = collect(rel)
    stable = [c for c in rel.order if c not in keys]
    df = rel.df.drop(POS) if POS in rel.df.columns and rel.order != (POS,) else rel.df
    if POS in stable:
        df, stable = df.withColumnRenamed(POS, "__was"), ["__was" if c == POS else c for c in stable]
    by = (*rel.slices, *keys, *stable)
    return Relation(df.orderBy(*[F.col(c).asc_nulls_first() for c in by]), by, rel.slices, rel.sizes)


def gather(index: Relation, column: str, target: Relation) -> Relation:
    """For each index row the target's row at that position, in index order; positions outside give no row."""
    if not is_integral(index.rows.schema[column].dataType):
        raise AlgebraError(f"gather: {column!r} is not an integer")
    if clash := set(index.columns) & set(target.columns):
        raise AlgebraError(f"gather: both sides have {sorted(clash)}")
    right = positioned(target).df.select(*target.columns, F.col(POS).alias("__at"))
    return index.map(lambda df: df.join(right, F.col(column) == F.col("__at")).drop("__at"))


# --- slices ----------------------------------------------------------------------------------


def slice_of(position: Column, rows: Column, n: int) -> Column:
    """The slice of a position among n: slice 0 takes the remainder, the others rows div n each."""
    each = F.call_function("div", rows, F.lit(n))
    first = each + rows % n
    return F.when(position < first, F.lit(0)).otherwise(1 + F.call_function("div", position - first, F.greatest(each, F.lit(1)))).cast("int")


def split(rel: Relation, n: int, name: str | None = None) -> Relation:
    """n slices of neighbouring rows, within the innermost slices there are. n = 0 is one slice around all.

    Slices without a name of their own are numbered when somebody looks at them.
    """
    if n < 0:
        raise AlgebraError("split: a negative number of slices")
    if n == 0:
        return shell(rel, name)
    column = name or f"__s{len(rel.slices) + 1}"

    def numbered() -> DataFrame:
        at = positioned(rel)
        if at.slices:
            return within(at).df.withColumn(column, slice_of(F.col("__at"), F.col("__rows"), n)).drop("__at", "__rows")
        total = at.df.agg(F.count(F.lit(1)).alias("__rows"))
        return at.df.crossJoin(F.broadcast(total)).withColumn(column, slice_of(F.col(POS), F.col("__rows"), n)).drop("__rows")

    levels = ((*rel.slices, column), (*rel.sizes, n))
    return Relation(numbered(), rel.order, *levels) if name else Relation(numbered, rel.order, *levels, rows=rel.rows)


def shell(rel: Relation, name: str | None = None) -> Relation:
    """One slice more, of which every innermost slice has one."""
    column = name or f"__s{len(rel.slices) + 1}"
    one = lambda df: df.withColumn(column, F.lit(0))
    levels = ((*rel.slices, column), (*rel.sizes, 1))
    return Relation(lambda: one(rel.df), rel.order, *levels, rows=one(rel.rows)) if rel.deferred else Relation(one(rel.df), rel.order, *levels)


def flatten(rel: Relation) -> Relation:
    """Without the innermost slice level."""
    if not rel.slices:
        raise AlgebraError("flatten: there is no slice level")
    if rel.deferred and len(rel.slices) == 1:
        return Relation(rel.rows, rel.order)
    return Relation(rel.df.drop(rel.slices[-1]), rel.order, rel.slices[:-1], rel.sizes[:-1])


def last_array(rel: Relation) -> Relation:
    """Of the innermost slice level only the last slice, within each outer one: no row, if that slice is empty."""
    if not rel.slices:
        raise AlgebraError("last_array: there is no slice level")
    return rel.with_df(rel.df.filter(F.col(rel.slices[-1]) == rel.sizes[-1] - 1))


def slice_column(rel: Relation, name: str = "slice") -> Relation:
    """The innermost slice's number as a column of its own."""
    if not rel.slices:
        raise AlgebraError("slice_column: there is no slice level")
    return rel.with_df(rel.df.withColumn(name, F.col(rel.slices[-1])))


# --- control ---------------------------------------------------------------------------------


def block(rel: Relation, written: bool = False) -> Relation:
    """The same relation, as a table in the shared folder if ``written``: what comes after does not run into what is before."""
    return rel.with_df(materialise(rel.df, "block")) if written else rel


def connector(rel: Relation, f: Callable[[Relation], Relation]) -> Relation:
    return f(rel)


def cat(*rels: Relation) -> tuple[Relation, ...]:
    """Relations bundled; this is no union."""
    return rels


def uncat(bundle: Sequence[Relation], n: int) -> Relation:
    if not 0 <= n < len(bundle):
        raise AlgebraError(f"uncat: {n} of a bundle of {len(bundle)}")
    return bundle[n]


def length(rel: Relation) -> DataFrame:
    """The number of rows, valid or not, as one row ``length``."""
    return rel.rows.agg(F.count(F.lit(1)).alias("length"))
