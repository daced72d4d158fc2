"""Tables, fields, references between tables, absences, and the catalog of the provided data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

#: Built-in absences (fixed values); each is a value of its own and never SQL NULL in results of tests.
ABSENCES = ("NotFound", "Redacted", "Pending", "Deleted", "Sealed", "JsonNull", "NoKey", "NotRetained")


class CheckError(ValueError):
    """A query that the checker rejects before anything runs."""


@dataclass(frozen=True)
class Edge:
    """A reference field: `field` of one table holds the key `key` of table `to`.

    `fallback` names what a plain join tries next, tables or absences, as the field declares it.
    """

    field: str
    to: str
    key: str
    fallback: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableDef:
    """Columns, candidate key (None: keyless), references, trait, default order, secret columns.

    `docs` are document fields that paths may enter, `opaque` those that are not indexed. Rows of a
    `versioned` table are versions with the columns of a log. `behaviors` are fields that are
    functions of the sample moment. `renamed` tells under which name a field was stored before.
    """

    name: str
    columns: tuple[str, ...]
    key: tuple[str, ...] | None = None
    edges: tuple[Edge, ...] = ()
    trait: str = "UserData"
    order: tuple[str, ...] = ()
    secrets: frozenset[str] = frozenset()
    docs: frozenset[str] = frozenset()
    opaque: frozenset[str] = frozenset()
    versioned: bool = False
    behaviors: tuple[tuple[str, object], ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if self.key is None and self.trait not in ("Keyless", "LogData"):
            raise CheckError(f"table {self.name} has no candidate key; declare one or the trait Keyless")
        for c in self.order:
            if c.lstrip("-") in dict(self.behaviors):
                raise CheckError(f"{self.name}: no order by {c.lstrip('-')}, a behavior has no value but at a moment")
        for c in (*(self.key or ()), *(e.field for e in self.edges), *(c.lstrip("-") for c in self.order)):
            if c not in self.columns:
                raise CheckError(f"{self.name}.{c} is not a field")


@dataclass(frozen=True)
class Catalog:
    """Tables, views, absences and functions; immutable, so that a query keeps the version it was checked with.

    `functions` are lambdas over values, or queries that name their rows `self`.
    """

    tables: dict[str, TableDef] = field(default_factory=dict)
    views: dict[str, object] = field(default_factory=dict)
    absences: frozenset[str] = frozenset(ABSENCES)
    functions: dict[str, object] = field(default_factory=dict)

    def with_function(self, name: str, body: object) -> Catalog:
        return replace(self, functions=self.functions | {name: body})

    def with_table(self, t: TableDef) -> Catalog:
        return replace(self, tables=self.tables | {t.name: t})

    def with_view(self, name: str, rel: object) -> Catalog:
        return replace(self, views=self.views | {name: rel})

    def with_absence(self, *names: str) -> Catalog:
        return replace(self, absences=self.absences | set(names))

    def edges_between(self, a: str, b: str) -> list[Edge]:
        return [e for e in self.tables[a].edges if e.to == b] if a in self.tables else []


def _t(name: str, columns: str, key: str | None, edges: tuple = (), trait: str = "UserData", order: str = "", docs: str = "") -> TableDef:
    return TableDef(
        name,
        tuple(columns.split()),
        tuple(key.split()) if key else None,
        tuple(Edge(*e) for e in edges),
        trait,
        tuple(order.split()),
        docs=frozenset(docs.split()),
    )


TESTDATA = Catalog(
    {
        t.name: t
        for t in (
            _t("region", "r_regionkey r_name", "r_regionkey", trait="Reference"),
            _t("nation", "n_nationkey n_name n_regionkey", "n_nationkey", (("n_regionkey", "region", "r_regionkey"),), "Reference"),
            _t("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "c_custkey", (("c_nationkey", "nation", "n_nationkey"),)),
            _t("supplier", "s_suppkey s_name s_nationkey s_acctbal", "s_suppkey", (("s_nationkey", "nation", "n_nationkey"),)),
            _t("part", "p_partkey p_name p_brand p_type p_size p_retailprice", "p_partkey"),
            _t(
                "orders",
                "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
                "o_orderkey",
                (("o_custkey", "customer", "c_custkey"),),
                order="o_orderdate",
            ),
            _t(
                "lineitem",
                "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
                None,
                (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")),
                "Keyless",
            ),
            _t("events", "event_id ts user_id event_type value props", "event_id", (("user_id", "customer", "c_custkey"),), "LogData", docs="props"),
            _t("documents", "doc_id text lang source n_chars", "doc_id"),
            _t("labels", "doc_id quality toxic", "doc_id", (("doc_id", "documents", "doc_id"),)),
            _t("conversations", "conv_id turn role text", "conv_id turn"),
            _t("pages", "page_id url html", "page_id"),
            _t("benchmark", "item_id text", "item_id"),
            _t("embeddings", "vec_id embedding label", "vec_id"),
        )
    }
)


def discover(df: DataFrame, name: str, key: tuple[str, ...] | None = None, trait: str = "LogData") -> TableDef:
    """A table definition from an external source's own schema."""
    return TableDef(name, tuple(df.columns), key, (), trait if key is None else "UserData")


@dataclass(frozen=True)
class Context:
    """What a query is resolved against: session, folder, catalog and the sample moment (ISO text)."""

    spark: SparkSession
    folder: str
    catalog: Catalog = TESTDATA
    moment: str | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)
    history: dict[str, Catalog] = field(default_factory=dict)  # by hash, tag or branch

    def frame(self, table: str) -> DataFrame:
        return self.frames[table] if table in self.frames else self.spark.read.parquet(f"{self.folder}/{table}.parquet")
