"""A fluent builder. A query is a list of steps over base relations; nothing runs until ``to_df``.

Steps may hold parameters with several values; ``variants`` gives a query for each combination, all
of which return the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame

from millrace.operators import aggregate as agg
from millrace.operators import join, partition, rows
from millrace.operators.join import JoinConfig
from millrace.operators.relation import Relation
from millrace.types import AlgebraError


@dataclass(frozen=True, eq=False)
class Choice:
    """A parameter with several values. Used in several places it has the same value in all of them."""

    values: tuple

    def derive(self, f: Callable[[object], object]) -> Derived:
        """A parameter that follows this one."""
        return Derived(self, f)


@dataclass(frozen=True, eq=False)
class Derived:
    source: Choice
    f: Callable[[object], object]


def choice(*values: object) -> Choice:
    if not values:
        raise AlgebraError("a choice of nothing")
    return Choice(values)


def settle(option: object, picked: dict[int, object]) -> object:
    """An option's value, given those of the choices; a choice not among them has its first."""
    if isinstance(option, Derived):
        return option.f(settle(option.source, picked))
    if isinstance(option, Choice):
        return picked.get(id(option), option.values[0])
    return option


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable
    options: dict
    detail: str = ""


@dataclass(frozen=True)
class Query:
    """Base relation and steps so far. Methods return a new query."""

    base: Relation
    name: str = "relation"
    steps: tuple[Step, ...] = ()

    def _then(self, name: str, run: Callable, detail: str = "", **options: object) -> Query:
        return replace(self, steps=(*self.steps, Step(name, run, options, detail)))

    # Rows and columns.
    def filter(self, *conditions: Column, mode: str | Choice = "plain") -> Query:
        return self._then("filter", lambda r, mode: rows.filter_rows(r, *conditions, mode=mode), f"{len(conditions)} conditions", mode=mode)

    def mask(self, condition: Column) -> Query:
        return self._then("mask", lambda r: rows.mask(r, condition))

    def compact(self) -> Query:
        return self._then("compact", rows.compact)

    def rename(self, keep: bool = False, **columns: Column | str) -> Query:
        return self._then("rename", lambda r: rows.rename(r, keep, **columns), ", ".join(columns))

    def append(self, **columns: Column | str) -> Query:
        return self._then("append", lambda r: rows.rename(r, True, **columns), ", ".join(columns))

    def prepend(self, **columns: Column | str) -> Query:
        return self._then("prepend", lambda r: rows.rename(r, True, True, **columns), ", ".join(columns))

    def cast(self, column: str, to: str) -> Query:
        return self._then("cast", lambda r: rows.cast(r, column, to), f"{column} to {to}")

    def distinct(self) -> Query:
        return self._then("distinct", rows.distinct)

    def sort(self, *keys: str | int) -> Query:
        return self._then("sort", lambda r: rows.sort(r, *keys), ", ".join(map(str, keys)))

    # Slices.
    def split(self, n: int) -> Query:
        """Slices for what follows; fewer than two are none."""
        return self if n < 2 else self._then("split", lambda r: rows.split(r, n), str(n))

    def shell(self) -> Query:
        return self._then("shell", rows.shell)

    def flatten(self) -> Query:
        return self._then("flatten", rows.flatten)

    def partition(self, key: str, n: int | Choice) -> Query:
        return self._then("partition", lambda r, n: partition.hash_partition(r, key, n), key, n=n)

    # Other relations.
    def equi_join(self, right: Query | Relation, left_key: str, right_key: str, residual: Column | None = None, config: JoinConfig | Choice = JoinConfig()) -> Query:  # noqa: B008
        def run(r: Relation, config: JoinConfig, right: Query) -> Relation:
            return join.equi_join(r, right.to_relation(), left_key, right_key, residual, config)

        other = right if isinstance(right, Query) else Query(right)
        return self._then("equi_join", run, f"{left_key} = {right_key}", config=config, right=Choice(tuple(other.variants())))

    def semi_join(self, right: Query | Relation, left_key: str, right_key: str) -> Query:
        other = right if isinstance(right, Query) else Query(right)
        return self._then("semi_join", lambda r, right: join.semi_join(r, right.to_relation(), left_key, right_key), f"{left_key} = {right_key}", right=Choice(tuple(other.variants())))

    # Aggregates.
    def aggregate(self, **columns: tuple[str, str | Column]) -> Query:
        return self._then("aggregate", lambda r: Relation(agg.aggregate(r, **columns)), ", ".join(columns))

    def group_by(self, *keys: str) -> Grouping:
        return Grouping(self, keys)

    def reduce(self, op: str, column: str, name: str | None = None) -> Query:
        """One row per innermost slice, or one row."""

        def run(r: Relation) -> Relation:
            out = agg.reduce_slices(r, op, column, name or column)
            return Relation(out, (), r.slices, r.sizes)

        return self._then("reduce", run, f"{op} {column}")

    def nested_reduce(self, op: str, column: str, name: str | None = None) -> Query:
        """Across the innermost slices, place by place."""
        return self._then("nested_reduce", lambda r: Relation(agg.nested_reduce(r, op, column, name or column), ("place",), r.slices[:-1], r.sizes[:-1]), f"{op} {column}")

    def nested_sum(self, column: str, mute: bool = False) -> Query:
        """The sum over what the slices gave; with ``mute``, for a plan without slices, nothing to do."""
        return self if mute else self.aggregate(**{column: ("sum", column)})

    def count(self, name: str = "n") -> Query:
        return self._then("count", lambda r: Relation(agg.count(r, name)), name)

    def position(self, name: str = "position", relative: bool = False) -> Query:
        return self._then("position", lambda r: rows.with_position(r, name, relative), name)

    def gather(self, column: str, target: Query | Relation) -> Query:
        """For each row the target's row at the position that a column names."""
        other = target if isinstance(target, Query) else Query(target)
        return self._then("gather", lambda r, right: rows.gather(r, column, right.to_relation()), column, right=Choice(tuple(other.variants())))

    def complete(self, materialise: bool = False) -> Query:
        """A place at which the rows so far may be written and read again; otherwise it changes nothing."""
        return self._then("complete", lambda r: rows.block(r, materialise)) if materialise else self

    def connector(self, f: Callable[[Relation], Relation]) -> Query:
        return self._then("connector", lambda r: rows.connector(r, f))

    # Ends.
    def to_relation(self) -> Relation:
        """The first variant's relation."""
        r = self.base
        for k, s in enumerate(self.steps):
            try:
                r = s.run(r, **{n: settle(v, {}) for n, v in s.options.items()})
            except AlgebraError as e:
                raise AlgebraError(e.args[0], [self.name, *(x.name for x in self.steps[: k + 1])]) from e
        return r

    def to_df(self) -> DataFrame:
        return self.to_relation().to_df()

    def variants(self) -> Iterator[Query]:
        """A query for every combination of the choices in its steps."""
        options = [v for s in self.steps for v in s.options.values()]
        found = {id(c): c for c in (v.source if isinstance(v, Derived) else v for v in options) if isinstance(c, Choice)}
        for values in product(*(c.values for c in found.values())):
            picked = dict(zip(found, values, strict=True))
            yield replace(self, steps=tuple(replace(s, options={n: settle(v, picked) for n, v in s.options.items()}) for s in self.steps))

    def listing(self) -> str:
        """The steps, one to a line, with their options."""
        lines = [self.name]
        for s in self.steps:
            options = "".join(f" {n}={v}" for n, v in s.options.items() if not isinstance(v, Query) and n != "right")
            lines.append(f"  {s.name} {s.detail}{options}".rstrip())
            others = s.options.get("right")
            others = settle(others, {})
            if isinstance(others, Query):
                lines += [f"    {x}" for x in others.listing().split("\n")]
        return "\n".join(lines)

    def explain(self, mode: str = "formatted") -> None:
        print(self.listing())
        self.to_df().explain(mode)


@dataclass(frozen=True)
class Grouping:
    query: Query
    keys: tuple[str, ...]

    def aggregates(self, **columns: tuple[str, str | Column]) -> Query:
        """One row per group: the aggregates, then the keys; without aggregates the distinct keys."""
        return self.query._then("group_by", lambda r: Relation(agg.aggregate(r, list(self.keys), **columns)), ", ".join(self.keys))
