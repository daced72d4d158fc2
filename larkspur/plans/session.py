"""A session: statements as text, staged on a catalog until they are committed, and rows written to version logs.

Nothing here reads a clock. The session's moment is given, and every write and query of a
statement has that moment.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import access, integrity, rollup, versions, writes
from ..operators.txlog import TxLog
from . import keys
from . import statements as S
from .expr import Bin, Call, Exists, Lambda, Lit, Path, lower, mapped, paths, put
from .graph import Diff, Graph, diff, visibility
from .lower import _Columns, _Scope, fetch, run
from .model import CheckError, Context, Edge, TableDef
from .rel import Rel, Term

#: Kinds of the language and their Spark types (fixed values).
KINDS = {
    "Text": "string",
    "Int": "long",
    "Decimal": "double",
    "Bool": "boolean",
    "Timestamp": "timestamp_ntz",
    "Moment": "timestamp_ntz",
    "Date": "date",
    "Duration": "long",
    "Doc": "string",
    "DataId": "string",
}
_KEYLESS = ("LogData", "Keyless", "Component", "Reference")


@dataclass
class Declared:
    """What a table's declaration says beside its columns."""

    kinds: dict[str, str]
    rules: list[writes.FieldRule]
    defaults: dict[str, object]
    asserts: dict[str, object]
    uniques: dict[str, tuple[str, ...]]
    events: tuple[S.EventDecl, ...] = ()
    required: tuple[str, ...] = ()


class Session:
    def __init__(self, ctx: Context, moment: str, role: str | None = None, store: str | None = None, user: object = None, users: str = "User"):
        """`role` is what grants name; `user` is the key of the requester's row in the table `users`."""
        self.ctx, self.moment, self.role, self.store, self.user, self.users = ctx, moment, role, store, user, users
        self.graph = Graph().commit(ctx.catalog)
        self.types: dict[str, S.TypeDecl] = {}
        self.traits: dict[str, S.TableDecl] = {}
        self.declared: dict[str, Declared] = {}
        self.modes: dict[str, S.Mode] = {}
        self.aggregates: dict[str, Rel] = {}
        self.retained: dict[str, S.RetainDecl] = {}
        self.grants = access.Grants()
        self.violations: DataFrame | None = None
        self.materialized: dict[str, tuple[str, str, DataFrame]] = {}
        self.levels: list[tuple[str, str]] = []
        self.hidden: set[str] = set()
        self.let: dict[str, Rel] = {}
        self.notes: list[str] = []  # what the last checked asserts gave cause to say
        self.space = ""
        self.seq = 0

    # --- running text
    def execute(self, text: str, moment: str | None = None):
        """The result of the last statement: a DataFrame, a message, or a list of messages."""
        self.moment = moment or self.moment
        out: object = None
        for s in S.parse_all(text):
            out = self.one(s)
        return out

    def one(self, s):
        if isinstance(s, Rel):
            return self.query(s)
        handler = {
            S.TypeDecl: self.declare_type,
            S.TraitDecl: self.declare_trait,
            S.TableDecl: self.declare,
            S.ViewDecl: self.view,
            S.Binding: self.bind,
            S.AggregateDecl: self.aggregate,
            S.RetainDecl: self.retain,
            S.Mode: self.mode,
            S.Constraint: self.constraint,
            S.Mutation: self.mutate,
            S.Evolution: self.evolve,
            S.Command: self.command,
        }
        return handler[type(s)](s)

    def context(self) -> Context:
        catalog = replace(self.ctx.catalog, views=self.ctx.catalog.views | self.let)
        return replace(self.ctx, catalog=catalog, moment=self.moment, history=self.graph.tokens() if len(self.graph.commits) > 1 else {})

    def query(self, rel: Rel) -> DataFrame:
        self.may_read(rel)
        ctx = self.context()
        for name in {rel.source, *[t.name for j in rel.joins for t in j.terms]} if self.user is not None else ():
            if isinstance(name, str) and name in self.declared and not (self.role and self.grants.bypasses(self.role, name)):
                ctx = self.redacted(name, ctx)
        return fetch(rel, ctx)

    def redacted(self, table: str, ctx: Context) -> Context:
        """`ctx` in which rows that fail an access assert of `table` have no value in any field, and say so in `access`.

        This comes before the query's own filters, so that none can tell what a hidden row holds.
        """
        asserts = self.declared[table].asserts
        rules = [self.as_user(body) for name, body in asserts.items() if access.classify({name: body})[name] == "access"]
        if not rules:
            return ctx
        t = ctx.catalog.tables[table]
        scope = _Scope(run(Rel(table), ctx), {table: {c: c for c in t.columns}}, {table: table}, set(), ctx)
        ok = F.lit(True)
        for body in rules:
            ok = ok & F.coalesce(lower(body, _Columns(scope), scope.tag, scope.exists), F.lit(False))
        fields = [F.when(F.col("__ok"), F.col(f"`{c}`")).alias(c) for c in t.columns]
        rows = scope.df.withColumn("__ok", ok).select(*fields, F.when(F.col("__ok"), "Granted").otherwise("Redacted").alias("access"))
        seen = replace(t, columns=(*t.columns, "access"), versioned=False)
        return replace(ctx, catalog=ctx.catalog.with_table(seen), frames=ctx.frames | {table: rows})

    def as_user(self, e):
        """An assert for this requester: the name stands for their key, and as a source for their row."""
        key = self.ctx.catalog.tables[self.users].key[0] if self.users in self.ctx.catalog.tables else None

        def one(x):
            if not isinstance(x, Exists):
                return x
            mine = Term(self.users, Rel(self.users).where(Bin("==", Path((key,)), Lit(self.user)))) if key else None
            joins = tuple(replace(j, terms=tuple(mine if t.name == access.USER else t for t in j.terms)) for j in x.rel.joins)
            return Exists(replace(x.rel, joins=joins, wheres=tuple(put(w, {access.USER: Lit(self.user)}) for w in x.rel.wheres)))

        return mapped(put(e, {access.USER: Lit(self.user)}), one)

    def may_read(self, rel: Rel) -> None:
        """Default-deny where the session has a role."""
        for name in (rel.source, *[t.name for j in rel.joins for t in j.terms]):
            if self.role and isinstance(name, str) and name in self.ctx.catalog.tables and not self.grants.can_read(self.role, name):
                raise CheckError(f"{self.role} has no grant that reaches {name}")

    def stage(self, **changes) -> None:
        self.ctx = replace(self.ctx, **changes)

    # --- declarations
    def declare_type(self, s: S.TypeDecl) -> str:
        self.types[s.name] = s
        return f"type {s.name}"

    def declare_trait(self, s: S.TraitDecl) -> str:
        self.traits[s.name] = s.body
        for name, body in s.body.functions.items():
            self.stage(catalog=self.ctx.catalog.with_function(name, body))
        return f"trait {s.name}"

    def base(self, kind: str) -> tuple[str, list[tuple[str, object]]]:
        """The Spark type of a kind, and the predicates that its domain types add, with their addresses."""
        head, found = kind.split()[0], []
        while head in self.types:
            t = self.types[head]
            found += [(f"{t.name} / {S.predicate_name(p)}", p) for p in t.predicates]
            if t.base is None:
                return "string", found
            head = t.base.split()[0]
        return KINDS.get(head, "string"), found

    def declare(self, s: S.TableDecl) -> Diff | str:
        body = [f for t in s.traits if t in self.traits for f in self.traits[t].fields] + list(s.fields)
        behaviors = tuple((f.name, f.default) for f in body if f.kinds[0].startswith("Behavior"))
        stored = [f for f in body if not f.kinds[0].startswith("Behavior")]
        for name, value in behaviors:
            if not isinstance(value, Lambda):
                raise CheckError(f"{s.name}.{name}: a behavior is defined by a function of the moment")
        tables = self.ctx.catalog.tables
        edges, kinds, rules = [], {}, []
        for f in stored:
            kind, inherited = self.base(f.kinds[0])
            if f.reference:
                if f.kinds[0] not in tables:
                    raise CheckError(f"{s.name}.{f.name} :> {f.kinds[0]}: the first variant of a reference is a table")
                target = tables[f.kinds[0]]
                edges.append(Edge(f.name, f.kinds[0], target.key[0] if target.key else "id", tuple(f.kinds[1:])))
                kind = self.declared[target.name].kinds.get(target.key[0], "string") if target.name in self.declared else "long"
            kinds[f.name] = kind
            own = [(f"{s.name}.{f.name} / {S.predicate_name(p)}", p) for p in f.predicates]
            rules += [self.rule(
                f.name,
                address if address.startswith(s.name) else f"{s.name}.{f.name} / {address.split(' / ')[1]}",
                p,
            ) for address, p in inherited + own]
        uniques = dict(s.uniques) | {f.name: (f.name,) for f in stored if f.unique}
        key = next(iter(uniques.values()), None)
        trait = next((t for t in s.traits if t in _KEYLESS), "UserData")
        columns = tuple(f.name for f in stored)
        renamed = tuple((f.name, f.renamed) for f in stored if f.renamed)
        docs = {f.name: f.indexed for f in stored if f.kinds[0] == "Doc"}
        made = TableDef(
            s.name,
            columns,
            key,
            tuple(edges),
            trait if key is None else "UserData",
            s.order,
            docs=frozenset(c for c, i in docs.items() if i),
            opaque=frozenset(c for c, i in docs.items() if not i),
            versioned=key is not None,
            behaviors=behaviors,
            renamed=renamed,
        )
        old = tables.get(s.name)
        absences = {v for f in stored for v in f.kinds[1:] if v not in tables and v not in self.types}
        catalog = self.ctx.catalog.with_table(made).with_absence(*absences)
        for name, f in s.functions.items():
            catalog = catalog.with_function(name, f)
        frames = self.ctx.frames if s.name in self.ctx.frames else self.ctx.frames | {s.name: self.empty(made, kinds)}
        self.stage(catalog=catalog, frames=frames)
        defaults = {f.name: f.default for f in stored if f.default is not None}
        required = tuple(f.name for f in stored if f.default is None and len(f.kinds) == 1)
        before = self.declared.get(s.name)
        self.check_asserts(s.name, before.asserts if before else {}, s.asserts)
        self.declared[s.name] = Declared(kinds, rules, defaults, dict(s.asserts), uniques, s.events, required)
        return diff(old, made, before.kinds if before else None, kinds) if old else f"table {s.name}"

    def rule(self, field: str, address: str, predicate) -> writes.FieldRule:
        mode = self.modes.get(address) or self.modes.get(address.split(" / ")[0])
        holds = lower(put(predicate, {"value": Path((field,))}), lambda p: F.col(f"`{p.name}`"), None)
        return writes.FieldRule(address, field, holds, mode.mode if mode else "enforce always", mode.queue if mode else None)

    def empty(self, t: TableDef, kinds: dict[str, str]) -> DataFrame:
        book = ["tx_seq long", "op string", "valid_from timestamp_ntz"] if t.versioned else []
        return self.ctx.spark.createDataFrame([], ", ".join([*[f"`{c}` {kinds[c]}" for c in t.columns], *book]))

    def check_asserts(self, table: str, old: dict[str, object], new: dict[str, object]) -> None:
        for name, body in new.items():
            loose = access.unanchored((table, body), self.ctx.catalog.edges_between)
            if loose:
                raise CheckError(f"{table}.{name}: {', '.join(loose)} is not reached from self along references")
            if not access.literal_pattern(body):
                raise CheckError(f"{table}.{name}: the right side of =~ is a literal or a reference value, never input")
        self.notes = access.mixed_conjuncts(new) + access.reclassified(old, new, table)

    def view(self, s: S.ViewDecl) -> str:
        self.stage(catalog=self.ctx.catalog.with_view(s.name, s.rel))
        return f"view {s.name}: {keys.describe(s.rel, self.ctx.catalog)}"

    def bind(self, s: S.Binding) -> str:
        if s.local:
            self.let[s.name] = s.body
        else:
            self.stage(catalog=self.ctx.catalog.with_function(s.name, s.body))
        return s.name

    def constraint(self, s: S.Constraint) -> str:
        table, _, name = s.name.rpartition(".")
        d = self.declared.setdefault(table, Declared({}, [], {}, {}, {}))
        if isinstance(s.body, tuple):
            d.uniques[name] = s.body
        else:
            new = d.asserts | {name: s.body}
            self.check_asserts(table, d.asserts, new)
            d.asserts = new
        return s.name

    def mode(self, s: S.Mode) -> str:
        self.modes[s.rule] = s
        for d in self.declared.values():
            d.rules = [replace(r, mode=s.mode, queue=s.queue) if s.rule in (r.address, r.address.split(" / ")[0]) else r for r in d.rules]
        return f"{s.mode} {s.rule}"

    # --- aggregates and retention
    def aggregate(self, s: S.AggregateDecl) -> str:
        self.aggregates[s.name] = s.rel
        return f"aggregate {s.name}"

    def template(self, name: str, time: str) -> rollup.Template:
        rel = self.aggregates[name]
        measures = [rollup.Measure(i.out, i.expr.fn, getattr(i.expr.of, "name", None), i.expr.arg or 0.5) for i in rel.items if hasattr(i.expr, "fn") and hasattr(i.expr, "of")]
        return rollup.Template(rel.groups, tuple(measures), time)

    def retain(self, s: S.RetainDecl) -> str:
        steps = max(len([x for x in chain if x.ttl != "drop"]) for _, chain in s.branches)
        if (s.aggregate is None) != (steps == 1):
            raise CheckError("`as` names the aggregate if a chain has more than one step, and only then")
        if s.aggregate is not None and s.aggregate not in self.aggregates:
            raise CheckError(f"unknown aggregate {s.aggregate}")
        template = self.template(s.aggregate, s.time or "created_at") if s.aggregate else rollup.Template((), (), s.time or "created_at")
        allowed = {*template.groups, template.time}
        for cond, chain in s.branches:
            for p in paths(cond) if cond is not None else ():
                if p.name not in allowed:
                    raise CheckError(f"a branch may only tell rows apart by group fields and the time, not by {p.name}")
            if len(chain) > 1:
                rollup.check_chain(template, list(chain))
            elif chain[-1].ttl not in (None, "drop"):
                raise CheckError("a chain ends, and only ends, in forever or drop")
        self.retained[s.table] = s
        return f"retain {s.table}"

    def levels_of(self, table: str) -> list[dict[str, DataFrame]]:
        """The levels of each branch of a table's chain as they stand at the session's moment."""
        s = self.retained[table]
        raw = self.ctx.frame(table)
        template = self.template(s.aggregate, s.time or "created_at") if s.aggregate else rollup.Template((), (), s.time or "created_at")
        conditions = [lower(c, lambda p: F.col(p.name), None) for c, _ in s.branches if c is not None]
        parts = rollup.branches(raw, conditions) if conditions else [raw]
        return [rollup.run_chain(part, template, list(chain), self.moment) for part, (_, chain) in zip(parts, s.branches, strict=False)]

    # --- writes
    def log(self, table: str) -> DataFrame:
        """All versions of a table; a table without versions becomes one of first versions when it is first written."""
        t, df = self.ctx.catalog.tables[table], self.ctx.frame(table)
        if t.versioned:
            return df
        if t.key is None:
            raise CheckError(f"{table} has no key by which a row could be replaced")
        return df.withColumns({"tx_seq": F.lit(0).cast("long"), "op": F.lit("I"), "valid_from": F.lit("1970-01-01").cast("timestamp_ntz")})

    def mutate(self, s: S.Mutation) -> str:
        if s.op == "insert" and s.of in self.ctx.catalog.views:
            return self.write_through(s.of, s.values)
        if s.op == "insert":
            row = self.row(s.of, s.values)
            return self.write(s.of, row, "I")
        rel = s.of
        table = rel.source if isinstance(rel.source, str) else None
        if table in self.ctx.catalog.views:  # the row that the view's key identifies
            owner = self.ctx.catalog.views[table]
            rel, table = replace(owner, items=(), wheres=(*owner.wheres, *rel.wheres)), owner.source
        t = self.ctx.catalog.tables[table]
        current = run(rel.project(*[f"{table}.{c}" if rel.joins else c for c in t.columns]), self.context())
        if s.op == "delete":
            return self.write(table, current, "D")
        scope = _Scope(current, {table: {c: c for c in t.columns}}, {table: table}, set(), self.context())
        new = {c: lower(e, _Columns(scope), scope.tag) for c, e in s.values.items()}
        unknown = set(new) - set(t.columns)
        if unknown or set(new) & set(dict(t.behaviors)):
            raise CheckError(f"{table} has no stored field {', '.join(sorted(unknown)) or 'of that name'}")
        return self.write(table, current.withColumns({c: v.cast(current.schema[c].dataType) for c, v in new.items()}), "U")

    def row(self, table: str, values: dict[str, object]) -> DataFrame:
        t, d = self.ctx.catalog.tables[table], self.declared.get(table)
        unknown = set(values) - set(t.columns)
        if unknown:
            raise CheckError(f"{table} has no stored field {', '.join(sorted(unknown))}")
        full = (dict(d.defaults) if d else {}) | values
        missing = [c for c in (d.required if d else t.key or ()) if c not in full]
        if missing:
            raise CheckError(f"{table}: {', '.join(missing)} has no value and no default")
        kinds = {f.name: f.dataType for f in self.ctx.frame(table).schema}
        text = lambda p: F.lit(p.name) if len(p.parts) == 1 and p.name[0].isupper() else None  # noqa: E731  a variant's name
        cells = [(lower(full[c], text, None) if c in full else F.lit(None)).cast("string").alias(c) for c in t.columns]
        return self.ctx.spark.range(1).select(*[c.try_cast(kinds[n]).alias(n) if n in kinds else c for n, c in zip(t.columns, cells, strict=True)])

    def write(self, table: str, rows: DataFrame, op: str) -> str:
        """Append one transaction, after the checks in their order; a row that a rule refuses refuses it whole."""
        t, d = self.ctx.catalog.tables[table], self.declared.get(table)
        log = self.log(table)
        live = versions.current(log, t.key[0])
        if d and op != "D":
            out = writes.write(rows, table, t.key[0], d.rules, before=live, node=self.graph.branches["main"][:12])
            bad = out.violations.limit(3).collect() if not out.refused.isEmpty() else []
            if bad:
                raise CheckError(f"{table}: refused by {', '.join(sorted({r['functor'] for r in bad}))}")
            rows = out.accepted
            self.violations = out.violations if self.violations is None else self.violations.unionByName(out.violations)
            for queue, fixes in out.repairs.items():
                self.stage(frames=self.ctx.frames | {queue: self.ctx.frames[queue].unionByName(fixes, allowMissingColumns=True) if queue in self.ctx.frames else fixes})
            self.check_references(table, rows, d, live, op)
        self.seq += 1
        if self.store:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            stored = TxLog(self.ctx.spark, f"{self.store}/{table}", schema)
            seq = stored.append(rows, op, self.moment, [t.key[0]], max(self.seq, max(stored.sequences(), default=0) + 1))
            rows = stored.read(seq).drop("row_pos", "tx_seq", "op", "valid_from")
        new = versions.append(log, rows, op, self.seq, self.moment)
        self.stage(catalog=self.ctx.catalog.with_table(replace(t, versioned=True)), frames=self.ctx.frames | {table: new})
        for e in d.events if d else ():
            self.fire(table, e, new)
        return f"transaction {self.seq}: {op} {table}"

    def check_references(self, table: str, rows: DataFrame, d: Declared, live: DataFrame, op: str) -> None:
        t = self.ctx.catalog.tables[table]
        for e in t.edges:
            if e.to in self.ctx.catalog.tables and not e.fallback:
                target = run(Rel(e.to).project(e.key), self.context())
                if not rows.where(F.col(e.field).isNotNull()).join(target, F.col(e.field) == target[e.key], "left_anti").isEmpty():
                    raise CheckError(f"{table}.{e.field}: no {e.to} has that key")
        for name, fields in d.uniques.items():
            others = live if op == "I" else live.join(rows.select(t.key[0]), t.key[0], "left_anti")
            if not rows.select(*fields).join(others.select(*fields), list(fields), "left_semi").isEmpty():
                raise CheckError(f"{table}.{name}: a row with that key exists")
        data = [a for n, a in d.asserts.items() if access.classify({n: a})[n] == "data"]
        for body in data:
            ctx = replace(self.context(), catalog=self.context().catalog.with_table(replace(t, versioned=False)), frames=self.ctx.frames | {table: rows})
            if run(Rel(table).where(body), ctx).count() != rows.count():
                raise CheckError(f"{table}: an assert does not hold")

    def fire(self, table: str, e: S.EventDecl, log: DataFrame) -> None:
        """Queue rows for the transitions of this transaction."""
        key = self.ctx.catalog.tables[table].key[0]
        condition = lower(e.condition, lambda p: F.col(p.name), lambda p: F.col(p.name))
        turned = versions.transitions(log, condition, key).where(F.col("tx_seq") == self.seq)
        rows = turned.select(*[lower(v, lambda p: F.col(p.name), None).alias(c) for c, v in e.payload.items()])
        queue = self.ctx.frames.get(e.queue)
        self.stage(frames=self.ctx.frames | {e.queue: rows if queue is None else queue.unionByName(rows, allowMissingColumns=True)})

    def parts(self, name: str) -> list[tuple[str, dict[str, str], dict[str, object]]]:
        """How a view decomposes into its base tables, referenced ones first; raises if it is read-only."""
        rel, catalog = self.ctx.catalog.views[name], self.ctx.catalog
        key = keys.derive(rel, catalog)
        if not key.meaningful:
            raise CheckError(f"{name} is read-only: its key is degenerate, as {key.reason}")
        tables = [rel.source, *[j.terms[0].name for j in rel.joins]]
        linked = [(a, b, e) for a in tables for b in tables if a != b for e in catalog.edges_between(a, b)]
        if any(len(j.terms) > 1 or j.on for j in rel.joins) or len(linked) < len(rel.joins):
            raise CheckError(f"{name} is read-only: a join does not follow a reference")
        fixed: dict[str, object] = {}
        for w in rel.wheres:
            for c in _equalities(w):
                fixed[c[0]] = c[1]
        shown = {i.expr.name: i.out for i in rel.items if isinstance(i.expr, Path)} | {c: c for i in rel.items if isinstance(i.expr, str) for t in tables if i.expr in ("*", f"{t}.*") for c in catalog.tables[t].columns}
        order = sorted(tables, key=lambda t: sum(1 for a, _, _ in linked if a == t))  # referenced tables reference none of the others
        out = []
        for t in order:
            columns = catalog.tables[t].columns
            fields = {c: shown[c] for c in columns if c in shown}
            fields |= {e.field: shown[e.key] for a, _, e in linked if a == t and e.key in shown and e.field not in fields}
            fields |= {e.key: shown[e.field] for _, b, e in linked if b == t and e.field in shown and e.key not in fields}
            constants = {c: fixed[c] for c in columns if c in fixed}
            d = self.declared.get(t)
            lacking = [c for c in (d.required if d else columns) if c not in fields and c not in constants]
            if lacking:
                raise CheckError(f"{name} is read-only: {t}.{lacking[0]} is neither projected nor fixed by its where")
            out.append((t, fields, constants))
        return out

    def write_through(self, name: str, values: dict[str, object]) -> str:
        done = [self.write(table, self.row(table, row), "I") for table, row in writes.decomposed(values, self.parts(name))]
        return "; ".join(done)

    # --- evolution
    def evolve(self, s: S.Evolution):
        catalog, name = self.ctx.catalog, s.names[0]
        if s.kind == "visibility":
            visibility([name], [(name, s.detail)])
            self.levels.append((name, s.detail))
            return f"{name} is {s.detail}"
        if s.kind == "deprecate":
            table, _, field = name.rpartition(".")
            if table in catalog.tables:  # one field
                t = catalog.tables[table]
                self.stage(catalog=catalog.with_table(replace(
                    t,
                    columns=tuple(c for c in t.columns if c != field),
                    edges=tuple(e for e in t.edges if e.field != field),
                )))
                return f"{name} is hidden"
            for view, rel in catalog.views.items():
                key = keys.derive(rel, catalog)
                if name in _sources(rel) and not key.meaningful:
                    raise CheckError(f"{view} depends on {name} and has a degenerate key, so it cannot be maintained without rescanning it: {key.reason}. Project the key into the view, or deprecate the view first.")
            self.hidden.add(name)
            if name in catalog.views:
                self.stage(catalog=replace(catalog, views={k: v for k, v in catalog.views.items() if k != name}))
            return f"{name} is hidden"
        if s.kind == "prune":
            t = catalog.tables.get(name)
            if t is not None and t.trait == "LogData":
                raise CheckError(f"rows of {name} are discarded by its chain only: retain {name} for ..., drop")
            users = [v for v, rel in catalog.views.items() if name in _sources(rel)] + [x.name for x in catalog.tables.values() if any(e.to == name for e in x.edges)]
            if users:
                raise CheckError(f"{name} is in use by {', '.join(users)}")
            self.stage(
                catalog=replace(catalog, tables={k: v for k, v in catalog.tables.items() if k != name}),
                frames={k: v for k, v in self.ctx.frames.items() if k != name},
            )
            return f"{name} is gone"
        if s.kind == "split":
            t, rows = catalog.tables[name], run(Rel(name), self.context())
            for body in s.detail:
                columns = tuple(dict.fromkeys((*t.key, *[f.name for f in body.fields])))
                self.stage(catalog=self.ctx.catalog.with_table(TableDef(body.name, columns, t.key)), frames=self.ctx.frames | {body.name: rows.select(*columns)})
            return f"{name} into {', '.join(b.name for b in s.detail)}"
        if s.kind == "merge":
            key = catalog.tables[name].key
            out = run(Rel(name), self.context())
            for other in s.names[1:]:
                out = out.join(run(Rel(other), self.context()), list(key), "full")
            columns = tuple(dict.fromkeys((*key, *[f.name for f in s.detail.fields])))
            self.stage(catalog=catalog.with_table(TableDef(s.detail.name, columns, key)), frames=self.ctx.frames | {s.detail.name: out.select(*columns)})
            return f"{', '.join(s.names)} into {s.detail.name}"
        table, _, field = name.rpartition(".")
        if s.kind == "extend":
            kind = self.types[name] if name in self.types else self.types.get(field)
            if kind is None or kind.base is not None:
                raise CheckError(f"{name} is not a sum type")
            if s.detail in kind.variants:
                raise CheckError(f"{s.detail} is a variant already; tags are never used again")
            self.types[kind.name] = replace(kind, variants=(*kind.variants, s.detail))
            return self.types[kind.name].variants.index(s.detail)
        gone, to = s.detail
        rows = run(Rel(table), self.context())
        new = to.body.name if isinstance(to.body, Path) else to.body.value
        return self.write(table, rows.where(F.col(field) == gone).withColumn(field, F.lit(new)), "U")

    # --- commands
    def command(self, s: S.Command):
        a = s.args
        if s.kind == "commit":
            self.graph = self.graph.commit(self.ctx.catalog)
            return [self.graph.branches["main"], *self.notes]
        if s.kind == "rollback":
            self.stage(catalog=self.graph.commits[self.graph.branches["main"]].catalog)
            return "rolled back"
        if s.kind in ("tag", "branch", "merge"):
            self.graph = getattr(self.graph, s.kind)(a[0])
            self.stage(catalog=self.graph.commits[self.graph.branches["main"]].catalog)
            return a[0]
        if s.kind == "use":
            self.space = a[0]
            return a[0]
        if s.kind == "describe":
            return self.describe(a[0])
        if s.kind == "history":
            return [x for x in self.graph.line(self.graph.branches["main"]) if a[0] in self.graph.commits[x].catalog.tables or a[0] in self.graph.commits[x].catalog.views]
        if s.kind == "explain":
            return run(a[0], self.context())._jdf.queryExecution().explainString(self.ctx.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        if s.kind == "grant":
            self.grants = self.grants.grant(*a)
            return f"{a[0]} on {a[1]}"
        if s.kind == "revoke":
            self.grants = self.grants.revoke(*a)
            return f"{a[0]} on {a[1]}"
        if s.kind == "show grants":
            return self.grants.table(self.ctx.spark, a[0])
        if s.kind == "refresh":
            return self.refresh(*a)
        if s.kind == "drop view":
            self.materialized.pop(a[0])
            return a[0]
        if s.kind == "show views":
            return self.ctx.spark.createDataFrame([(n, node, at) for n, (node, at, _) in self.materialized.items()], "name string, node string, moment string")
        if s.kind == "show violations":
            empty = self.ctx.spark.createDataFrame([], ", ".join(f"{c} string" for c in (*integrity.COLUMNS[:3], "schema_node", *integrity.COLUMNS[3:])))
            found = self.violations if self.violations is not None else empty
            found = found if a[0] is None else found.where((F.col("functor") == a[0]) | F.startswith("functor", F.lit(f"{a[0]} / ")))
            return found if a[1] is None else found.limit(a[1])
        if s.kind in ("show transactions", "show transaction"):
            return self.transactions(s)
        raise CheckError(f"unknown command {s.kind}")

    def transactions(self, s: S.Command) -> DataFrame:
        """What the session's tables were written, the newest first; or the mutations of one transaction."""
        written = [(n, f) for n, f in self.ctx.frames.items() if "tx_seq" in f.columns]
        one = lambda n, f: f.select(F.lit(n).alias("table"), "tx_seq", "op", "valid_from", F.to_json(F.struct(*[c for c in f.columns if c not in versions.BOOK])).alias("row"))
        each = [one(n, f) for n, f in written]
        out = each[0]
        for x in each[1:]:
            out = out.unionByName(x)
        out = out.where("tx_seq > 0")
        if s.kind == "show transaction":
            return out.where(F.col("tx_seq") == s.args[0])
        since, limit = s.args
        out = out.groupBy("tx_seq", "table", "op").agg(F.min("valid_from").alias("valid_from"), F.count(F.lit(1)).alias("mutations")).orderBy(F.desc("tx_seq"))
        out = out if since is None else out.where(F.col("tx_seq") >= since)
        return out if limit is None else out.limit(limit)

    def describe(self, name: str) -> str:
        if name in self.ctx.catalog.views:
            rel = self.ctx.catalog.views[name]
            try:
                self.parts(name)
                writable = "yes"
            except CheckError as e:
                writable = f"no -- {e}"
            return f"view {name}\n  {keys.describe(rel, self.ctx.catalog)}\n  refresh: {keys.refresh_mode(rel, self.ctx.catalog)}\n  writable: {writable}"
        t, d = self.ctx.catalog.tables[name], self.declared.get(name)
        kinds = access.classify(d.asserts) if d else {}
        level = visibility([name], self.levels)[name]
        return "\n".join([f"table {name} ({level})", f"  key: {', '.join(t.key or ('none',))}", *[f"  assert {n} ({k})" for n, k in kinds.items()]])

    def refresh(self, name: str, at: str | None) -> str:
        """Compute a view and keep it, pegged to a commit and a moment; by key where its key is meaningful."""
        rel, node = self.ctx.catalog.views[name], self.graph.branches["main"]
        moment = at or self.moment
        ctx = replace(self.context(), moment=moment)
        mode = keys.refresh_mode(rel, self.ctx.catalog)
        old = self.materialized.get(name)
        new = run(rel, ctx)
        if old is not None and old[0] == node and mode == "incremental" and rel.groups:
            new = incremental(rel, ctx, old[2], old[1])
        if self.store:
            path = f"{self.store}/_views/{name}/{node[:12]}-{''.join(c for c in moment if c.isdigit())}"
            new.write.mode("overwrite").parquet(path)
            new = self.ctx.spark.read.parquet(path)
        self.materialized[name] = (node, moment, new)
        return mode if old is not None else "full"


def incremental(rel: Rel, ctx: Context, old: DataFrame, since: str) -> DataFrame:
    """A grouped view at the context's moment from its state at `since`: only groups that a later version touches are computed anew.

    A version touches the group that it has now and the one that it had then, so rows that move
    between groups, or go, are seen too.
    """
    t = ctx.catalog.tables[rel.source]
    log = ctx.frame(rel.source)
    changed = log.where((F.col("valid_from") > F.lit(since).cast("timestamp_ntz")) & (F.col("valid_from") <= F.lit(ctx.moment).cast("timestamp_ntz"))).select(t.key[0])
    was = versions.current(log, t.key[0], since).join(changed.distinct(), t.key[0], "left_semi").select(*rel.groups)
    now = versions.current(log, t.key[0], ctx.moment).join(changed.distinct(), t.key[0], "left_semi").select(*rel.groups)
    groups = was.unionByName(now).distinct()
    plain = {i.expr.name: i.out for i in rel.items if isinstance(i.expr, Path)}
    keyed = groups.select(*[F.col(g).alias(plain.get(g, g)) for g in rel.groups])
    rows = versions.current(log, t.key[0], ctx.moment).join(groups, list(rel.groups), "left_semi").drop(*versions.BOOK)
    part = run(rel, replace(ctx, catalog=ctx.catalog.with_table(replace(t, versioned=False)), frames=ctx.frames | {rel.source: rows}))
    return old.join(keyed, keyed.columns, "left_anti").unionByName(part)


def _equalities(e) -> list[tuple[str, object]]:
    """Fields that a condition fixes to constants."""
    if isinstance(e, Bin) and e.op == "&&":
        return [*_equalities(e.left), *_equalities(e.right)]
    if isinstance(e, Bin) and e.op == "==" and isinstance(e.left, Path) and isinstance(e.right, (Lit, Call)):
        return [(e.left.name, e.right)]
    return []


def _sources(rel) -> set[str]:
    if not isinstance(rel, Rel):
        return {rel} if isinstance(rel, str) else set()
    return _sources(rel.source) | {t.name for j in rel.joins for t in j.terms} | {x for o in rel.others for x in _sources(o)}
