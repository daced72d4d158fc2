"""Functors by name: their signatures, how they are wrapped, what they may import, and how they compose."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import CheckError

_SIGNATURE = re.compile(r"^\s*(?P<a>.+?)\s*->\s*(?P<b>[^>]+?)\s*$")


@dataclass(frozen=True)
class Functor:
    """`run` takes a column and gives a struct (ok, value, error), whatever the function was written as."""

    name: str
    source: str
    target: str
    run: Callable[[Column], Column]


def _outcome(ok: Column, value: Column, error: Column) -> Column:
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), F.when(~ok, error).alias("error"))


def wrapped(name: str, signature: str, f: Callable[[Column], Column], secret: bool = False) -> Functor:
    """Lift a function to a -> Either Error b by its signature.

    Bool: a false result is a failure of the input; Maybe: an absent one is; Either: f gives the
    struct itself; anything else can't fail. IO is rejected, and a secret only admits a -> Bool.
    """
    m = _SIGNATURE.match(signature)
    if not m:
        raise CheckError(f"{name}: {signature!r} is not a signature")
    a, b = m["a"], m["b"]
    if b.split()[0] == "IO":
        raise CheckError(f"{name}: a -> IO b is rejected; emit to a queue instead")
    if secret and b != "Bool":
        raise CheckError(f"{name}: on a secret only a -> Bool is admitted, as errors can carry the value out")
    error = F.lit(f"{name} failed")
    if b == "Bool":
        return Functor(name, a, a, lambda x: _outcome(F.coalesce(f(x), F.lit(False)), x, error))
    if b.split()[0] == "Maybe":
        return Functor(name, a, b.split(None, 1)[1], lambda x: _outcome(f(x).isNotNull(), f(x), error))
    if b.split()[0] == "Either":
        return Functor(name, a, b.split()[-1], f)
    return Functor(name, a, b, lambda x: _outcome(F.lit(True), f(x), error))


@dataclass
class Registry:
    """Functors of a schema. Packages beyond the standard ones must be allowed before they are imported."""

    functors: dict[str, Functor] = field(default_factory=dict)
    allowed: set[str] = field(default_factory=lambda: {"Data.Text", "Data.Time", "Data.Maybe", "Data.List", "Data.Map", "Text.Regex.TDFA"})

    def allow(self, package: str) -> None:
        self.allowed.add(package)

    def imports(self, package: str) -> None:
        if package not in self.allowed:
            raise CheckError(f"{package} is not an allowed package")

    def register(self, name: str, signature: str, f: Callable[[Column], Column], secret: bool = False) -> Functor:
        if name in self.functors:
            raise CheckError(f"functor {name} exists")
        self.functors[name] = wrapped(name, signature, f, secret)
        return self.functors[name]

    def apply(self, name: str, column: Column, kind: str) -> Column:
        """The outcome of a functor on a column of the language's type `kind`, which must be the functor's."""
        if name not in self.functors:
            raise CheckError(f"no functor {name}")
        f = self.functors[name]
        if f.source not in (kind, "a"):
            raise CheckError(f"{name} takes {f.source}, not {kind}")
        return f.run(column)

    def chain(self, names: list[str], column: Column, kind: str) -> Column:
        """Functors one after the other, up to the first failure; their types must fit."""
        out = None
        for name in names:
            f = self.functors.get(name)
            if f is None:
                raise CheckError(f"no functor {name}")
            if f.source not in (kind, "a"):
                raise CheckError(f"{name} takes {f.source}, not {kind}")
            if out is None:
                out = f.run(column)
            else:
                nxt = f.run(out["value"])
                out = F.when(out["ok"], nxt).otherwise(F.struct(
                    F.lit(False).alias("ok"),
                    F.lit(None).cast("string").alias("value"),
                    out["error"].alias("error"),
                )) if f.target in ("Text", "a") else F.struct(
                    (out["ok"] & nxt["ok"]).alias("ok"),
                    F.when(out["ok"], nxt["value"]).alias("value"),
                    F.coalesce(out["error"], nxt["error"]).alias("error"),
                )
            kind = kind if f.target == "a" else f.target
        return out


@dataclass(frozen=True)
class Endpoint:
    """An API functor: a path, a query, and the format of its rows; a handler functor has a queue in place of the path."""

    path: str
    query: str
    format: str = "json"
    params: tuple[str, ...] = ()

    def text(self, **values: str) -> str:
        """The query with its parameters as literals; values are quoted, never spliced in as code."""
        missing = set(self.params) - set(values)
        if missing or set(values) - set(self.params):
            raise CheckError(f"{self.path} takes {', '.join(self.params) or 'no parameters'}")
        out = self.query
        for name, v in values.items():
            quoted = str(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
            out = re.sub(rf"\${name}\b", lambda _, q=quoted: q, out)
        return out


def route(endpoints: list[Endpoint], path: str) -> Endpoint:
    """The endpoint with the longest path that begins `path`, at a slash."""
    fits = [e for e in endpoints if path == e.path or path.startswith(e.path.rstrip("/") + "/")]
    if not fits:
        raise CheckError(f"no endpoint serves {path}")
    return max(fits, key=lambda e: len(e.path))
