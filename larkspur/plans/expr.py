"""Expressions of the query language and their lowering to Spark columns.

Logic is two-valued: comparisons are null-safe where they test equality, and an ordering with an
absent operand is false, so `not` never meets a NULL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import FUNCTIONS
from .model import CheckError

AGGREGATES = ("count", "sum", "min", "max", "avg", "percentile")
SPANS = ("days", "hours", "minutes", "seconds", "millis")
CLOCKS = {"now", "current_timestamp", "current_date", "rand", "uuid", "random"}


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]

    @property
    def name(self) -> str:
        return self.parts[-1]


@dataclass(frozen=True)
class Bin:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Is:
    of: Path
    variant: str
    negated: bool = False


@dataclass(frozen=True)
class If:
    cond: object
    then: object
    other: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Lambda:
    params: tuple[str, ...]
    body: object


@dataclass(frozen=True)
class Apply:
    """A lambda applied to arguments."""

    fn: Lambda
    args: tuple


@dataclass(frozen=True)
class Let:
    name: str
    value: object
    body: object


@dataclass(frozen=True)
class Exists:
    """A query in boolean position, rooted at `self`: whether it has a row."""

    rel: object


@dataclass(frozen=True)
class Ctor:
    """A variant of a sum type with its payload, as a struct (tag, payload)."""

    tag: str
    payload: object = Lit(None)


@dataclass(frozen=True)
class Match:
    """The value of the arm of a sum value's variant; `x` in an arm names the payload."""

    of: object
    arms: tuple[tuple[str, object], ...]
    variants: tuple[str, ...] | None = None  # all variants of the type, where it is declared


@dataclass(frozen=True)
class Agg:
    fn: str
    of: object
    arg: float | None = None


def parts(e) -> tuple:
    """The expressions that `e` is made of."""
    if isinstance(e, Match):
        return (e.of, *(x for _, x in e.arms))
    return {
        Bin: lambda: (e.left, e.right),
        Not: lambda: (e.of,),
        If: lambda: (e.cond, e.then, e.other),
        Call: lambda: e.args,
        Agg: lambda: (e.of,),
        Apply: lambda: (e.fn.body, *e.args),
        Let: lambda: (e.value, e.body),
        Ctor: lambda: (e.payload,),
    }.get(type(e), tuple)()


def paths(e) -> list[Path]:
    if isinstance(e, Path):
        return [e]
    return [p for x in parts(e) for p in paths(x)]


def tests(e) -> list[Is]:
    if isinstance(e, Is):
        return [e]
    return [t for x in parts(e) for t in tests(x)]


def mapped(e, f):
    """`e` with `f` applied to every part of it, innermost first."""
    to = lambda x: mapped(x, f)
    inner = {
        Bin: lambda: Bin(e.op, to(e.left), to(e.right)),
        Not: lambda: Not(to(e.of)),
        If: lambda: If(to(e.cond), to(e.then), to(e.other)),
        Call: lambda: Call(e.name, tuple(map(to, e.args))),
        Agg: lambda: Agg(e.fn, to(e.of), e.arg),
        Lambda: lambda: Lambda(e.params, to(e.body)),
        Apply: lambda: Apply(to(e.fn), tuple(map(to, e.args))),
        Let: lambda: Let(e.name, to(e.value), to(e.body)),
        Ctor: lambda: Ctor(e.tag, to(e.payload)),
        Match: lambda: Match(to(e.of), tuple((t, to(x)) for t, x in e.arms), e.variants),
    }.get(type(e), lambda: e)()
    return f(inner)


def put(e, values: dict[str, object]):
    """`e` with the expressions of `values` for their names; names that an inner lambda or let binds stay."""
    if isinstance(e, Path) and e.parts[0] in values:
        value = values[e.parts[0]]
        if len(e.parts) == 1:
            return value
        if isinstance(value, Path):
            return Path((*value.parts, *e.parts[1:]))
        raise CheckError(f"{e.parts[0]} is not a row, it has no field {e.parts[1]}")
    if isinstance(e, Lambda):
        return Lambda(e.params, put(e.body, {k: v for k, v in values.items() if k not in e.params}))
    if isinstance(e, Let):
        return Let(e.name, put(e.value, values), put(e.body, {k: v for k, v in values.items() if k != e.name}))
    if isinstance(e, Apply):
        return Apply(put(e.fn, values), tuple(put(x, values) for x in e.args))
    if isinstance(e, Match):
        inner = {k: v for k, v in values.items() if k != "x"}
        return Match(put(e.of, values), tuple((t, put(x, inner)) for t, x in e.arms), e.variants)
    if isinstance(e, Bin):
        return Bin(e.op, put(e.left, values), put(e.right, values))
    if isinstance(e, Not):
        return Not(put(e.of, values))
    if isinstance(e, If):
        return If(put(e.cond, values), put(e.then, values), put(e.other, values))
    if isinstance(e, Call):
        return Call(e.name, tuple(put(x, values) for x in e.args))
    if isinstance(e, Agg):
        return Agg(e.fn, put(e.of, values), e.arg)
    if isinstance(e, Ctor):
        return Ctor(e.tag, put(e.payload, values))
    return e


def inline(e, functions: dict[str, Lambda], depth: int = 0):
    """`e` without user functions, lambdas and lets: all are written out, so that Catalyst sees plain columns."""
    if depth > 50:
        raise CheckError("a function may not call itself")

    def one(x):
        if isinstance(x, Let):
            return inline(put(x.body, {x.name: x.value}), functions, depth + 1)
        if isinstance(x, Call) and isinstance(functions.get(x.name), Lambda):
            x = Apply(functions[x.name], x.args)
        if isinstance(x, Apply):
            if len(x.args) != len(x.fn.params):
                raise CheckError(f"a function of {len(x.fn.params)} arguments got {len(x.args)}")
            return inline(put(x.fn.body, dict(zip(x.fn.params, x.args, strict=True))), functions, depth + 1)
        if isinstance(x, Path) and len(x.parts) == 1 and isinstance(functions.get(x.name), Lambda) and not functions[x.name].params:
            return inline(functions[x.name].body, functions, depth + 1)
        return x

    return mapped(e, one)


def _matched(e: Match, to) -> Column:
    names = [t for t, _ in e.arms]
    if e.variants is not None and set(e.variants) - set(names):
        raise CheckError(f"the match leaves out {', '.join(sorted(set(e.variants) - set(names)))}")
    value = to(e.of)
    out = None
    for tag, arm in e.arms:
        hit, got = value["tag"] == tag, lower(arm, lambda p: value["payload"] if p.parts == ("x",) else to(p), None)
        out = F.when(hit, got) if out is None else out.when(hit, got)
    return out.otherwise(F.raise_error(F.concat(F.lit("no arm matches the variant "), F.coalesce(value["tag"], F.lit("absent")))))


def _typed(path: Path, beside: Lit, column) -> Column:
    """The field beside a literal; a document's path is read as the literal's type, without coercion."""
    typed = getattr(column, "typed", None)
    return typed(path, beside.value) if typed else column(path)


def lower(e, column, tag, exists=None) -> Column:
    """`column(path)`, `tag(path)` and `exists(relation)` give the Spark columns of a field, of its variant and of a query's having rows."""
    to = lambda x: lower(x, column, tag, exists)
    if isinstance(e, Exists):
        if exists is None:
            raise CheckError("a query has no place here")
        return exists(e.rel)
    if isinstance(e, Ctor):
        return F.struct(F.lit(e.tag).alias("tag"), to(e.payload).alias("payload"))
    if isinstance(e, Match):
        return _matched(e, to)
    if isinstance(e, (Let, Apply)):
        return to(inline(e, {}))
    if isinstance(e, Lit):
        return F.lit(e.value)
    if isinstance(e, Path):
        return column(e)
    if isinstance(e, Not):
        return ~to(e.of)
    if isinstance(e, Is):
        same = F.coalesce(tag(e.of) == e.variant, F.lit(False))
        return ~same if e.negated else same
    if isinstance(e, If):
        return F.when(to(e.cond), to(e.then)).otherwise(to(e.other))
    if isinstance(e, Call):
        if e.name == "matches":
            raise CheckError("matches applies to one resolved row, after a unique field has narrowed the query; it is no row filter")
        if e.name in CLOCKS:
            raise CheckError(f"{e.name}: a query reads its sample moment, never a clock or a random source")
        if e.name not in FUNCTIONS:
            raise CheckError(f"unknown function {e.name}")
        if e.name in SPANS and isinstance(e.args[0], Bin) and e.args[0].op == "-":  # time - time
            return FUNCTIONS[e.name](F.timestamp_diff("MILLISECOND", to(e.args[0].right), to(e.args[0].left)))
        return FUNCTIONS[e.name](*[a.value if isinstance(a, Lit) and not isinstance(a.value, str) else to(a) for a in e.args])
    if isinstance(e, Bin):
        if e.op == "=~":
            if not isinstance(e.right, Lit):
                raise CheckError("the right side of =~ is a literal or a reference value, never input")
            re.compile(e.right.value)
            return F.coalesce(to(e.left).rlike(e.right.value), F.lit(False))
        left, right = (_typed(x, y, column) if isinstance(x, Path) and isinstance(y, Lit) else to(x) for x, y in ((e.left, e.right), (e.right, e.left)))
        if e.op == "==":
            return left.eqNullSafe(right)
        if e.op == "/=":
            return ~left.eqNullSafe(right)
        if e.op in ("<", "<=", ">", ">="):
            return F.coalesce({"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[e.op], F.lit(False))
        return {"&&": lambda: left & right, "||": lambda: left | right, "+": lambda: left + right, "-": lambda: left - right, "*": lambda: left * right, "/": lambda: left / right, "<>": lambda: F.concat(left, right)}[e.op]()
    raise CheckError(f"not an expression here: {e}")
