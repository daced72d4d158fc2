"""Relations: what the parser and the fluent API build. Clauses are kept apart, as their order is free."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .expr import Path


@dataclass(frozen=True)
class Item:
    """One part of a projection: a path, an expression, an aggregate, `*` or `T.*`."""

    expr: object
    name: str | None = None

    @property
    def out(self) -> str:
        return self.name or self.expr.name


@dataclass(frozen=True)
class Term:
    """A table in a join, or a filtered query over it, or the absence that ends a guard."""

    name: str
    rel: Rel | None = None


@dataclass(frozen=True)
class Use:
    """A query function (of the catalog or of a trait) applied to rows, which it names `self`."""

    name: str
    rel: Rel


@dataclass(frozen=True)
class Join:
    """`>< terms[0] | terms[1] | ...`; `on` is for the Python API only (non-key equality)."""

    terms: tuple[Term, ...]
    via: str | None = None
    alias: str | None = None
    on: tuple[tuple[str, str], ...] = ()


def _expr(x):
    if isinstance(x, str):
        from .parser import parse_expr

        return parse_expr(x)
    return x


@dataclass(frozen=True)
class Rel:
    source: object
    joins: tuple[Join, ...] = ()
    wheres: tuple = ()
    groups: tuple[str, ...] = ()
    items: tuple[Item, ...] = ()
    orders: tuple[str, ...] = ()
    rows: int | None = None
    moment: str | None = None
    others: tuple[Rel, ...] = ()  # set union

    def where(self, e) -> Rel:
        return replace(self, wheres=(*self.wheres, _expr(e)))

    def _add(self, j: Join) -> Rel:
        return replace(self, joins=(*self.joins, j))

    def join(self, *terms, via: str | None = None, alias: str | None = None, on: tuple = ()) -> Rel:
        made = tuple(t if isinstance(t, Term) else Term(t.source, t) if isinstance(t, Rel) else Term(t) for t in terms)
        return self._add(Join(made, via, alias, tuple(on)))

    def group(self, *fields: str) -> Rel:
        return replace(self, groups=(*self.groups, *fields))

    def project(self, *items) -> Rel:
        made = []
        for x in items:
            if isinstance(x, Item):
                made.append(x)
            elif isinstance(x, tuple):
                made.append(Item(_expr(x[0]), x[1]))
            else:
                made.append(Item(x if x.endswith("*") else Path(tuple(x.split(".")))))
        return replace(self, items=(*self.items, *made))

    def order(self, *fields: str) -> Rel:
        return replace(self, orders=(*self.orders, *fields))

    def limit(self, n: int) -> Rel:
        return replace(self, rows=n)

    def at(self, moment: str) -> Rel:
        return replace(self, moment=moment)

    def __or__(self, other: Rel) -> Rel:
        return replace(self, others=(*self.others, other))
