"""Named subplans in sequence."""

from __future__ import annotations

from collections.abc import Callable

from millrace.operators.relation import Relation
from millrace.types import AlgebraError


class Program:
    """Assignments in order: a later one sees those before it and may take a name again, which shadows it.

    ``once`` makes a subplan the first time a key is used and gives the same one afterwards.
    """

    def __init__(self, **inputs: Relation):
        self.scope, self.memo, self.made = dict(inputs), {}, 0

    def let(self, name: str, make: Callable[[Program], Relation] | Relation) -> Program:
        self.scope[name] = make if isinstance(make, Relation) else make(self)
        return self

    def fresh(self, relation: Relation, prefix: str = "t") -> str:
        self.made += 1
        name = f"{prefix}{self.made}"
        while name in self.scope:
            self.made += 1
            name = f"{prefix}{self.made}"
        self.scope[name] = relation
        return name

    def rename(self, old: str, new: str) -> Program:
        self.scope[new] = self[old]
        del self.scope[old]
        return self

    def once(self, key: object, make: Callable[[], Relation]) -> Relation:
        if key not in self.memo:
            self.memo[key] = make()
        return self.memo[key]

    def reset(self) -> None:
        self.scope.clear()
        self.memo.clear()
        self.made = 0

    def __getitem__(self, name: str) -> Relation:
        if name not in self.scope:
            raise AlgebraError(f"no relation {name!r} among {sorted(self.scope)}")
        return self.scope[name]
