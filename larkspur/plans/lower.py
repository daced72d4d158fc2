"""Checking and lowering of relations to DataFrames.

Clauses are put in one order: scans and joins, where, group, projection, order, limit. A `where`
binds to the joined input; a name that only the projection makes is filtered after it. Joins
follow references; guards try their terms from left to right. The result is one lazy DataFrame,
so that Catalyst sees the whole plan: filters and columns reach the scans, small sides are
broadcast by their measured size.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import documents, versions
from .expr import Agg, Bin, Call, Exists, Is, Lambda, Lit, Not, Path, inline, lower, paths, put, tests
from .model import CheckError, Context, TableDef
from .parser import parse
from .rel import Item, Join, Rel, Term, Use


class _Scope:
    """A DataFrame under construction and what its columns are called in the query."""

    def __init__(self, df: DataFrame, names: dict[str, dict[str, str]], tables: dict[str, str], outer: set[str], ctx: Context):
        self.df, self.names, self.tables, self.outer, self.ctx = df, names, tables, outer, ctx
        self.hops: dict[tuple[str, ...], str] = {}

    def find(self, parts: tuple[str, ...]) -> str | None:
        if len(parts) > 1 and parts[0] in self.names:
            return self.names[parts[0]].get(parts[1]) if len(parts) == 2 else None
        if len(parts) == 1:
            for fields in self.names.values():
                if parts[0] in fields:
                    return fields[parts[0]]
        return None

    def table_of(self, parts: tuple[str, ...]) -> tuple[TableDef | None, int]:
        """The table whose field a path begins with, and the place of that field in the path."""
        at = 1 if len(parts) > 1 and parts[0] in self.names else 0
        alias = parts[0] if at else next((a for a, fields in self.names.items() if parts[0] in fields), None)
        return self.ctx.catalog.tables.get(self.tables.get(alias, "")), at

    def document(self, parts: tuple[str, ...]) -> tuple[Column, str] | None:
        """The document field that a path enters, and the path inside."""
        table, at = self.table_of(parts)
        if table is None or len(parts) <= at + 1:
            return None
        if parts[at] in table.opaque:
            raise CheckError(f"{table.name}.{parts[at]} is not indexed; declare it Doc indexed to query paths into it")
        if parts[at] not in table.docs:
            return None
        return F.col(f"`{self.find(parts[: at + 1])}`"), ".".join(parts[at + 1 :])

    def typed(self, p: Path, literal: object) -> Column:
        """A field beside a literal; from a document only a value of the literal's own type."""
        doc = self.document(p.parts)
        if doc is None:
            return self.column(p)
        kind, family = ("boolean", "^BOOLEAN") if isinstance(literal, bool) else ("string", "^STRING") if isinstance(literal, str) else ("double", "^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return F.when(documents.tag_at(*doc).rlike(family), documents.value_at(*doc, kind))

    def anchored(self, rel: Rel) -> tuple[DataFrame, list[str], list[str]]:
        """The rows of `self` for which a query has rows: (frame, its columns, the columns here that they equal)."""
        alias, table = next(iter(self.tables.items()), (None, None))
        if rel.source != "self" or table not in self.ctx.catalog.tables:
            raise CheckError("a query in boolean position is rooted at self, a row of a table")
        if any(j.on for j in rel.joins):
            raise CheckError("every hop of a query in boolean position is a reference, in either direction")
        t = self.ctx.catalog.tables[table]
        own = {p.parts[0] for w in rel.wheres for p in paths(w)} & set(t.columns)
        hops = [e.field for j in rel.joins for e in self.ctx.catalog.edges_between(table, j.terms[0].name)]
        columns = list(t.key) if t.key else list(dict.fromkeys(hops)) if hops and not own else list(t.columns)
        inner = run(replace(rel, source=table, items=tuple(Item(Path((table, c)), f"__a_{c}") for c in columns), orders=(), rows=None), self.ctx)
        return inner, inner.columns, [self.names[alias][c] for c in columns]

    def filter(self, rel: Rel, how: str) -> None:
        """Keep the rows for which a query has rows (left_semi), or has none (left_anti)."""
        inner, theirs, ours = self.anchored(rel)
        cond = F.lit(True)
        for a, b in zip(ours, theirs, strict=True):
            cond = cond & (self.df[f"`{a}`"] == inner[b])
        self.df = self.df.join(inner, cond, how)

    def exists(self, rel: Rel) -> Column:
        """Whether a query has rows, as a column: its rows are joined as a flag and filter nothing."""
        inner, theirs, ours = self.anchored(rel)
        flag = f"__exists{sum(c.startswith('__exists') for c in self.df.columns)}"
        inner = inner.distinct().withColumn(flag, F.lit(True))
        cond = F.lit(True)
        for a, b in zip(ours, theirs, strict=True):
            cond = cond & (self.df[f"`{a}`"] == inner[b])
        self.df = self.df.join(inner, cond, "left").drop(*theirs)
        return F.coalesce(flag, F.lit(False))

    def column(self, p: Path) -> Column:
        doc = self.document(p.parts)
        if doc is not None:
            return documents.value_at(*doc, "string")
        name = self.find(p.parts) or self.navigate(p.parts)
        if name is None:
            raise CheckError(f"unknown field {'.'.join(p.parts)}")
        return F.col(f"`{name}`")

    def navigate(self, parts: tuple[str, ...]) -> str | None:
        """Follow references field by field; paths that share a prefix share its join."""
        if parts in self.hops:
            return self.hops[parts]
        start = 2 if parts[0] in self.names else 1
        table = self.tables.get(parts[0]) if start == 2 else next((self.tables[a] for a, fields in self.names.items() if parts[0] in fields), None)
        if table not in self.ctx.catalog.tables or len(parts) <= start:
            return None
        here = parts[:start]
        for step in range(start, len(parts)):
            edge = next((e for e in self.ctx.catalog.tables[table].edges if e.field == here[-1]), None)
            if edge is None:
                return None
            alias = "/".join(here)
            if (*here, "") not in self.hops:
                right = self.ctx.frame(edge.to)
                right = right.select(*[F.col(c).alias(f"{alias}/{c}") for c in right.columns])
                left = self.find(here) or self.hops[here]
                self.df = self.df.join(right, self.df[f"`{left}`"] == right[f"`{alias}/{edge.key}`"], "left")
                self.hops[(*here, "")] = alias
            table = edge.to
            here = (*here, parts[step])
            self.hops[here] = f"{alias}/{parts[step]}"
        return self.hops[parts] if self.hops[parts] in self.df.columns else None

    def tag(self, p: Path) -> Column:
        doc = self.document(p.parts)
        if doc is not None:
            return documents.tag_at(*doc)
        for name in (f"{p.parts[0]}__tag", f"{p.name}__tag"):
            if name in self.df.columns:
                return F.col(name)
        raise CheckError(f"{'.'.join(p.parts)} has one variant only; `is` needs a sum or a guarded source")


class _Columns:
    """What `lower` asks for fields."""

    def __init__(self, scope: _Scope):
        self.scope = scope

    def __call__(self, p: Path) -> Column:
        return self.scope.column(p)

    def typed(self, p: Path, literal: object) -> Column:
        return self.scope.typed(p, literal)


def _rooted(body: Rel, rows: Rel) -> Rel:
    """A query function's body with `rows` for self."""
    if isinstance(body.source, Rel):
        return replace(body, source=_rooted(body.source, rows))
    return replace(body, source=rows) if body.source == "self" else body


def base_table(source, ctx: Context) -> str | None:
    """The table whose rows a source gives, filtered at most."""
    if isinstance(source, str):
        body = ctx.catalog.functions.get(source)
        if isinstance(body, Rel):
            return base_table(body, ctx)
        return source if source in ctx.catalog.tables and source not in ctx.catalog.views else None
    if isinstance(source, Use):
        body = ctx.catalog.functions.get(source.name)
        return base_table(_rooted(body, source.rel), ctx) if isinstance(body, Rel) else None
    plain = not (source.items or source.groups or source.joins or source.others)
    return base_table(source.source, ctx) if plain else None


def _scan(ctx: Context, source) -> tuple[DataFrame, str | None]:
    if isinstance(source, Rel):
        return run(source, ctx), base_table(source, ctx)
    if isinstance(source, Use):
        body = ctx.catalog.functions.get(source.name)
        if not isinstance(body, Rel):
            raise CheckError(f"{source.name} is not a query function")
        return run(_rooted(body, source.rel), ctx), base_table(source, ctx)
    if source in ctx.catalog.views:  # bound when read, so `*` follows the tables as they are now
        return run(ctx.catalog.views[source], ctx), None
    if isinstance(ctx.catalog.functions.get(source), Rel):
        return run(ctx.catalog.functions[source], ctx), base_table(source, ctx)
    if source in ctx.frames or source in ctx.catalog.tables:
        df, t = ctx.frame(source), ctx.catalog.tables.get(source)
        if t is not None and t.versioned:
            df = versions.current(df, t.key[0], ctx.moment).drop(*versions.BOOK)
        return (_as_declared(df, t, ctx) if ctx.history and t is not None else df), source
    raise CheckError(f"unknown table {source}")


def _as_declared(df: DataFrame, t: TableDef, ctx: Context) -> DataFrame:
    """Stored rows under a version of the schema: its fields, whatever they are called now; fields that no row has are NotFound."""
    every = [c.tables[t.name] for c in (ctx.catalog, *ctx.history.values()) if t.name in c.tables]
    pairs = {p for x in every for p in x.renamed}
    out = []
    for c in t.columns:
        names = [c, *[o for n, o in pairs if n == c], *[n for n, o in pairs if o == c]]
        stored = next((x for x in names if x in df.columns), None)
        out += [F.col(f"`{stored}`").alias(c)] if stored else [F.lit(None).cast("string").alias(c), F.lit("NotFound").alias(f"{c}__tag")]
    return df.select(*out)


_ISO = re.compile(r"\d{4}-\d{2}-\d{2}")


def pinned(ctx: Context, token: str) -> Context:
    """`ctx` at a moment (ISO text), or at a version of the schema: a tag, a branch, or the beginning of a hash."""
    if _ISO.match(token):
        return replace(ctx, moment=token.replace("T", " ").rstrip("Z"))
    found = {id(c): c for name, c in ctx.history.items() if name == token or len(token) >= 4 and name.startswith(token)}
    if token in ctx.history:
        found = {0: ctx.history[token]}
    if len(found) != 1:
        raise CheckError(f"{token!r} names {'several versions' if found else 'no version'} of the schema")
    return replace(ctx, catalog=next(iter(found.values())))


def _written_out(rel: Rel, ctx: Context, table: str | None) -> Rel:
    """`rel` with user functions, and behaviors at the sample moment, written out."""
    functions = {k: v for k, v in ctx.catalog.functions.items() if isinstance(v, Lambda)}
    t = ctx.catalog.tables.get(table or "")
    for name, body in t.behaviors if t else ():
        mentioned = [p.name for x in (*rel.wheres, *[i.expr for i in rel.items if not isinstance(i.expr, str)]) for p in paths(x)]
        if name in (c.lstrip("-") for c in rel.orders):
            raise CheckError(f"no order by {name}, a behavior has no value but at a moment")
        if name in mentioned:
            if ctx.moment is None:
                raise CheckError(f"{name} is a behavior; say at which moment: at \"...\"")
            functions[name] = Lambda((), put(body.body, {body.params[0]: Call("moment", (Lit(ctx.moment),))}))
    if not functions:
        return rel
    items = tuple(i if isinstance(i.expr, str) else Item(inline(i.expr, functions), i.out) for i in rel.items)
    return replace(rel, items=items, wheres=tuple(inline(w, functions) for w in rel.wheres))


def _conjuncts(e) -> list:
    return [*_conjuncts(e.left), *_conjuncts(e.right)] if isinstance(e, Bin) and e.op == "&&" else [e]


def _edge(ctx: Context, scope: _Scope, term: Term, via: str | None):
    """(left column, right column, whether from the referencing side) of the reference that a join follows."""
    found = []
    for alias, table in scope.tables.items():
        for e in ctx.catalog.edges_between(table, term.name):
            if via in (None, e.field):
                found.append((scope.names[alias][e.field], e.key, True))
        for e in ctx.catalog.edges_between(term.name, table):
            if via in (None, e.field) and table != term.name:
                found.append((scope.names[alias][e.key], e.field, False))
    if not found:
        raise CheckError(f"no reference joins {term.name}" + (f" via {via}" if via else ""))
    if len(found) > 1:
        raise CheckError(f"several references join {term.name}; name one with via")
    return found[0]


def _declared(ctx: Context, scope: _Scope, j: Join) -> Join:
    """`j` with the fallback that the joining field declares, if the query names none."""
    if len(j.terms) == 1 and j.terms[0].rel is None and not j.on:
        for table in scope.tables.values():
            for e in ctx.catalog.edges_between(table, j.terms[0].name):
                if e.fallback and j.via in (None, e.field):
                    return replace(j, terms=(*j.terms, *[Term(x) for x in e.fallback]))
    return j


def _join(ctx: Context, scope: _Scope, j: Join) -> None:
    j = _declared(ctx, scope, j)
    *tables, last = j.terms
    terminal = last.name if last.rel is None and last.name in ctx.catalog.absences else None
    if terminal is None:
        tables.append(last)
    guard = len(j.terms) > 1
    parts = []
    for t in tables:
        right = run(t.rel, ctx) if t.rel is not None else _scan(ctx, t.name)[0]
        if j.on:
            left_col, right_col, forward = None, None, True
        else:
            left_col, right_col, forward = _edge(ctx, scope, t, j.via)
        if not forward and not j.alias and t.rel is None and guard:
            raise CheckError(f"a reverse join to {t.name} that is named in the query needs `as`")
        parts.append((t, right, left_col, right_col, forward))
    alias = j.alias or tables[0].name
    if not guard:
        t, right, left_col, right_col, _ = parts[0]
        right, fields = _renamed(scope, right, alias)
        cond = scope.df[f"`{left_col}`"] == right[f"`{fields[right_col]}`"] if not j.on else _on(scope, right, fields, j.on)
        scope.df = scope.df.join(right, cond)
        scope.names[alias], scope.tables[alias] = fields, t.name
        return
    if any(not p[4] for p in parts) and len(parts) > 1:
        _reverse_chain(scope, parts, terminal, alias)
        return
    tag, out = F.lit(None).cast("string"), {}
    for k, (t, right, left_col, right_col, _) in enumerate(parts):
        right, fields = _renamed(scope, right.withColumn("__hit", F.lit(True)), f"{alias}__{k}")
        free = tag.isNull()
        scope.df = scope.df.join(right, free & (scope.df[f"`{left_col}`"] == right[f"`{fields[right_col]}`"]), "left")
        name = f"{alias}__tag{k}"
        scope.df = scope.df.withColumn(name, F.when(F.col(fields["__hit"]), F.lit(t.name)).otherwise(tag))
        tag = F.col(name)
        for c, p in fields.items():
            if c != "__hit":
                out.setdefault(c, []).append(p)
    _finish(scope, out, tag, terminal, alias, tables[0].name)


def _finish(scope: _Scope, out: dict[str, list[str]], tag: Column, terminal: str | None, alias: str, table: str) -> None:
    if terminal is None:
        scope.df = scope.df.where(tag.isNotNull())
    scope.df = scope.df.withColumn(f"{alias}__tag", F.coalesce(tag, F.lit(terminal)))
    scope.names[alias] = {c: ps[0] for c, ps in out.items()}
    scope.df = scope.df.withColumns({ps[0]: F.coalesce(*[F.col(f"`{p}`") for p in ps]) for ps in out.values() if len(ps) > 1})
    scope.tables[alias] = table
    scope.outer.add(alias)


def _reverse_chain(scope: _Scope, parts: list, terminal: str | None, alias: str) -> None:
    """Referencing tables: all rows of the first table that has any for the key."""
    rest, frames, fields0 = scope.df, [], {}
    for t, right, left_col, right_col, _ in parts:
        right, fields = _renamed(scope, right, alias)
        hit = rest.join(right, rest[f"`{left_col}`"] == right[f"`{fields[right_col]}`"]).withColumn("__t", F.lit(t.name))
        frames.append(hit)
        rest = rest.join(right, rest[f"`{left_col}`"] == right[f"`{fields[right_col]}`"], "left_anti")
        fields0 |= fields
    if terminal is not None:
        frames.append(rest.withColumn("__t", F.lit(terminal)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    scope.df = out.withColumnRenamed("__t", f"{alias}__tag")
    scope.names[alias], scope.tables[alias] = fields0, parts[0][0].name
    scope.outer.add(alias)


def _renamed(scope: _Scope, right: DataFrame, alias: str) -> tuple[DataFrame, dict[str, str]]:
    fields = {c: c if c not in scope.df.columns and not c.startswith("__") and "__" not in alias else f"{alias}__{c.strip('_')}" for c in right.columns}
    return right.select(*[F.col(f"`{c}`").alias(n) for c, n in fields.items()]), fields


def _on(scope: _Scope, right: DataFrame, fields: dict[str, str], on) -> Column:
    cond = F.lit(True)
    for a, b in on:
        cond = cond & (scope.df[f"`{scope.find((a,))}`"] == right[f"`{fields[b]}`"])
    return cond


_AGG = {"count": lambda c, a: F.count(F.lit(1)), "sum": lambda c, a: F.sum(c), "min": lambda c, a: F.min(c), "max": lambda c, a: F.max(c), "avg": lambda c, a: F.avg(c), "percentile": lambda c, a: F.percentile(c, a)}


def _check_outer(rel: Rel, scope: _Scope) -> None:
    for w in rel.wheres:
        for p in paths(w):
            alias = p.parts[0] if len(p.parts) > 1 else next((a for a, f in scope.names.items() if p.parts[0] in f), None)
            if alias in scope.outer:
                raise CheckError(f"where on {'.'.join(p.parts)} of the guarded source {alias}: filter before the guard, as in >< ({alias} where ...) | ...")


def fetch(rel: Rel | str, ctx: Context) -> DataFrame:
    """As run(), for a result that is read in order: without `order by`, in the order that the table declares, else by its candidate key."""
    rel = parse(rel) if isinstance(rel, str) else rel
    name = base_table(replace(rel, items=(), joins=()), ctx)
    t = ctx.catalog.tables.get(name or "")
    aggregates = any(isinstance(i.expr, Agg) for i in rel.items)
    if t is not None and not (rel.orders or rel.groups or rel.others or aggregates):
        rel = rel.order(*(t.order or t.key or ()))
    return run(rel, ctx)


def run(rel: Rel | str, ctx: Context) -> DataFrame:
    """The DataFrame of a relation or of query text, in no order that the query does not ask for."""
    rel = parse(rel) if isinstance(rel, str) else rel
    if rel.moment is not None:
        ctx = pinned(ctx, rel.moment)
        t = ctx.catalog.tables.get(base_table(replace(rel, items=(), joins=(), groups=(), others=()), ctx) or "")
        if _ISO.match(rel.moment) and t is not None and not (t.versioned or t.behaviors):
            raise CheckError(f"{t.name} keeps no versions: it has no state at {rel.moment}")
    if rel.others:
        parts = [replace(rel, others=(), orders=(), rows=None), *rel.others]
        out = run(parts[0], ctx)
        for p in parts[1:]:
            out = out.unionByName(run(p, ctx))
        out = out.distinct()  # tables are sets
        return _ordered(out, rel.orders, rel.rows, lambda c: F.col(c))
    rel = _written_out(rel, ctx, base_table(rel.source, ctx))
    df, table = _scan(ctx, rel.source)
    name = rel.source if isinstance(rel.source, str) else table or "it"
    scope = _Scope(df, {name: {c: c for c in df.columns}}, {name: table} if table else {}, set(), ctx)
    for j in rel.joins:
        _join(ctx, scope, j)
    _check_outer(rel, scope)
    made = {i.out for i in rel.items if not isinstance(i.expr, str)}
    late = [w for w in rel.wheres if any(scope.find(p.parts) is None and p.parts[0] in made and len(p.parts) == 1 for p in paths(w))]
    for w in rel.wheres:
        for c in _conjuncts(w) if w not in late else ():
            if isinstance(c, Exists):
                scope.filter(c.rel, "left_semi")
            elif isinstance(c, Not) and isinstance(c.of, Exists):
                scope.filter(c.of.rel, "left_anti")
            else:
                cond = lower(c, _Columns(scope), scope.tag, scope.exists)
                scope.df = scope.df.where(cond)
    aggregates = any(isinstance(i.expr, Agg) for i in rel.items)
    if rel.groups or aggregates:
        out = _grouped(rel, scope)
    elif rel.items:
        cols = _projected(rel.items, scope)
        keep = [c for c in rel.orders if c.lstrip("-") not in cols]
        extra = {f"__o{k}": scope.column(Path(tuple(c.lstrip("-").split(".")))) for k, c in enumerate(keep)}
        out = scope.df.select(*[c.alias(n) for n, c in cols.items()], *[c.alias(n) for n, c in extra.items()])
        orders = tuple(("-" if c.startswith("-") else "") + f"__o{keep.index(c)}" if c in keep else c for c in rel.orders)
        for w in late:
            out = out.where(lower(w, lambda p: F.col(p.name), scope.tag))
        return _ordered(out, orders, rel.rows, F.col).drop(*extra)
    else:
        out = scope.df
    for w in late:
        out = out.where(lower(w, lambda p: F.col(p.name), scope.tag))
    return _ordered(out, rel.orders, rel.rows, lambda c: F.col(c) if c in out.columns else scope.column(Path(tuple(c.split(".")))))


def _projected(items: tuple[Item, ...], scope: _Scope) -> dict[str, Column]:
    """Columns by name; a later item takes the place of an earlier one of its name."""
    out: dict[str, Column] = {}
    for i in items:
        if isinstance(i.expr, str):
            for alias in [i.expr[:-2]] if i.expr != "*" else list(scope.names):
                if alias not in scope.names:
                    raise CheckError(f"unknown source {alias}")
                out |= {c: F.col(f"`{p}`") for c, p in scope.names[alias].items()}
        elif isinstance(i.expr, Is):
            out[i.out] = lower(i.expr, scope.column, scope.tag)
        elif isinstance(i.expr, Path) and i.expr.parts[-1] == "tag" and f"{i.expr.parts[0]}__tag" in scope.df.columns:
            out[i.out] = F.col(f"{i.expr.parts[0]}__tag")
        else:
            if tests(i.expr) == [] and isinstance(i.expr, Agg):
                raise CheckError("an aggregate needs a group or stands alone")
            out[i.out] = lower(i.expr, _Columns(scope), scope.tag, scope.exists)
    return out


def _bare(e, rel: Rel, scope: _Scope):
    """An aggregate's field: bare, or addressed by the lower-cased plural of the source (orders.total)."""
    if isinstance(e, Path) and len(e.parts) == 2 and e.parts[0] not in scope.names and e.parts[0].rstrip("s") == str(rel.source).split(".")[-1].lower().rstrip("s"):
        return Path(e.parts[1:])
    return e


def _grouped(rel: Rel, scope: _Scope) -> DataFrame:
    keys = {g.split(".")[-1]: scope.column(Path(tuple(g.split(".")))) for g in rel.groups}
    aggs: dict[str, Column] = {}
    plain: dict[str, str] = {}
    for i in rel.items:
        if isinstance(i.expr, Agg):
            aggs[i.out] = _AGG[i.expr.fn](lower(_bare(i.expr.of, rel, scope), _Columns(scope), scope.tag) if i.expr.fn != "count" else None, i.expr.arg)
        elif isinstance(i.expr, Path) and i.expr.name in keys:
            plain[i.out] = i.expr.name
        elif isinstance(i.expr, Path) and len(i.expr.parts) == 1 and i.expr.name.rstrip("s") == str(rel.source).rstrip("s"):
            rest = [c for c in scope.names[rel.source].values() if c not in keys]
            aggs[i.out] = F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rest]))  # the nested table itself
        else:
            raise CheckError(f"{i.out} is neither a group field nor an aggregate")
    df = scope.df
    if not keys:
        return df.agg(*[c.alias(n) for n, c in aggs.items()])
    if not rel.items:
        rest = [c for c in scope.names[next(iter(scope.names))].values() if c not in keys]
        return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("rows"))
    by = df.groupBy(*[c.alias(n) for n, c in keys.items()])
    out = by.agg(*[c.alias(n) for n, c in aggs.items()]) if aggs else df.select(*[c.alias(n) for n, c in keys.items()]).distinct()
    return out.select(*[F.col(plain[i.out]).alias(i.out) if i.out in plain else F.col(i.out) for i in rel.items])


def _ordered(df: DataFrame, orders: tuple[str, ...], rows: int | None, column) -> DataFrame:
    """Absent values sort last in either direction."""
    if orders:
        df = df.orderBy(*[column(c.lstrip("-")).desc_nulls_last() if c.startswith("-") else column(c).asc_nulls_last() for c in orders])
    return df if rows is None else df.limit(rows)
