"""More registered queries and their SQL: the language's statements, versions, documents, integrity, sources."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog_queries import CATALOG, code, text
from .functions import registry
from .functions.scalars import CROCKFORD, data_id, render_id, version_id, version_parts, virtual
from .operators import access, documents, evolution, rollup, txlog, versions, writes
from .plans import graph
from .plans.expr import Bin, Lit, Match, Path, lower
from .plans.lower import fetch, run
from .plans.model import Context, Edge, TableDef
from .plans.parser import parse
from .plans.session import Session, incremental
from .sources import changelog, connectors
from .streaming import events

MOMENT = "2002-01-01 00:00:00"


def _session(ctx: Context, *statements: str) -> Session:
    s = Session(ctx, MOMENT)
    for t in statements:
        s.execute(t)
    return s


# --- versions of rows: a log of orders, one version when placed and one a year later for every third
_VERSIONED = (
    "SELECT o_orderkey, o_custkey, o_totalprice, 'I' AS op, 1::BIGINT AS tx_seq, o_orderdate AS valid_from FROM orders "
    "UNION ALL SELECT o_orderkey, o_custkey, o_totalprice * 2, CASE WHEN o_orderkey % 2 = 0 THEN 'D' "
    "ELSE 'U' END, 2::BIGINT, o_orderdate + INTERVAL 365 DAY FROM orders WHERE o_orderkey % 3 = 0"
)


def _order_log(ctx: Context) -> DataFrame:
    o = ctx.frame("orders").select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        F.lit("I").alias("op"),
        F.lit(1).cast("long").alias("tx_seq"),
        F.col("o_orderdate").alias("valid_from"),
    )
    again = o.where("o_orderkey % 3 = 0").withColumns({
        "o_totalprice": F.col("o_totalprice") * 2,
        "op": F.when(F.col("o_orderkey") % 2 == 0, "D").otherwise("U"),
        "tx_seq": F.lit(2).cast("long"),
        "valid_from": F.col("valid_from") + F.expr("interval 365 days"),
    })
    return o.unionByName(again)


def _versioned(ctx: Context) -> Context:
    t = TableDef(
        "Placed",
        ("o_orderkey", "o_custkey", "o_totalprice"),
        ("o_orderkey",),
        (Edge("o_custkey", "customer", "c_custkey"),),
        order=("-o_totalprice",),
        versioned=True,
    )
    return replace(ctx, catalog=CATALOG.with_table(t), frames={"Placed": _order_log(ctx)})


@code(
    f"WITH v AS ({_VERSIONED}), n AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY tx_seq DESC) AS r FROM v "
    f"WHERE valid_from <= TIMESTAMP '1998-06-01') SELECT o_orderkey, o_totalprice, c_name FROM n "
    f"JOIN customer ON o_custkey = c_custkey WHERE r = 1 AND op <> 'D' AND o_totalprice > 100000"
)
def moment_scan(ctx):
    return run('Placed at "1998-06-01T00:00:00Z" >< customer where o_totalprice > 100000 { o_orderkey, o_totalprice, c_name }', _versioned(ctx))


@code("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50)")
def default_order(ctx):
    """The first rows in the order that the table declares, and the key: the order itself is in the result."""
    t = replace(CATALOG.tables["orders"], order=("o_orderdate", "o_orderkey"))
    first = fetch("orders limit 50 { o_orderkey }", replace(ctx, catalog=CATALOG.with_table(t)))
    return ctx.spark.createDataFrame([(r[0], i + 1) for i, r in enumerate(first.collect())], "o_orderkey long, place long")  # 50 rows


@code("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation")
def key_order(ctx):
    """Without a declared order: by candidate key."""
    return ctx.spark.createDataFrame([(r[0], i + 1) for i, r in enumerate(fetch("nation { n_nationkey }", ctx).collect())], "n_nationkey int, place long")  # 25 rows


# --- the language
text("doc_path_filter",
    'events where props.k == 3 || props.nothing is Value { event_id, props.k as k }',
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract(props, '$.k')::VARCHAR = '3'"
)
text("doc_path_absent",
    'events where props.nothing is NotFound && props.k is not NotFound { event_id }',
    "SELECT event_id FROM events WHERE json_extract(props, '$.nothing') IS NULL AND json_extract(props, '$.k') IS NOT NULL"
)
text("presence_text", "customer where self >< orders where o_totalprice > 300000 { c_custkey, c_name }",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey "
    "AND o_totalprice > 300000)"
)
text("absence_text", "orders where not $ self >< lineitem { o_orderkey }",
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"
)
text("presence_or", "customer where c_acctbal > 9000 || (self >< orders >< lineitem where l_quantity > 49) { c_custkey }",
    "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders "
    "JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity > 49)"
)
text("lambda_let",
    "orders { o_orderkey, (\\x -> x * 2) o_totalprice as twice, let half = o_totalprice / 2 in half + 1 as more, 3 `take` "
    "o_orderpriority as start }",
    "SELECT o_orderkey, o_totalprice * 2 AS twice, o_totalprice / 2 + 1 AS more, left(o_orderpriority, 3) AS start "
    "FROM orders"
)
text("duration_functions",
    'orders { o_orderkey, days (moment "2001-09-01" - o_orderdate) as d, hours (moment "2001-09-01" - o_orderdate) as h, '
    'seconds (moment "2001-09-01" - o_orderdate) as s }',
    "WITH x AS (SELECT o_orderkey, date_diff('millisecond', o_orderdate, TIMESTAMP '2001-09-01') AS ms FROM orders) "
    "SELECT o_orderkey, ms / 86400000.0::DOUBLE AS d, ms / 3600000.0::DOUBLE AS h, ms / 1000.0::DOUBLE AS s FROM x"
)
text("plural_address",
    "orders group o_orderpriority { o_orderpriority, orders.o_totalprice max as most, o_orderkey count as n }",
    "SELECT o_orderpriority, max(o_totalprice) AS most, count(*) AS n FROM orders GROUP BY o_orderpriority"
)
text("union_text",
    '(orders where o_totalprice > 300000 { o_orderkey, "big" as kind }) { o_orderkey, kind } | orders where o_orderstatus == '
    '"P" { o_orderkey, "open" as kind }',
    "SELECT o_orderkey, 'big' AS kind FROM orders WHERE o_totalprice > 300000 UNION SELECT o_orderkey, 'open' FROM orders "
    "WHERE o_orderstatus = 'P'"
)


@code(
    "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' "
    "ELSE 'small' END AS size, upper(trim(o_orderpriority)) AS priority, o_totalprice * 1.2 AS gross FROM orders "
    "WHERE o_totalprice > 1000 AND o_orderstatus = 'F'"
)
def user_functions(ctx):
    """Global functions and a global query, as text; coercions are such functions."""
    s = _session(
        ctx,
        "toSize x = if x > 100000 then \"large\" else \"small\"",
        "normalize x = upper (trim x)",
        "applyTax rate x = x * (1 + rate)",
        "premium = orders where o_totalprice > 1000",
        'done self = self where o_orderstatus == "F"',
    )
    return s.execute("done premium { o_orderkey, toSize o_totalprice as size, normalize o_orderpriority as priority, applyTax 0.2 o_totalprice as gross }")


@code("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def let_and_trait(ctx):
    s = _session(ctx,
        'trait Building { c_mktsegment : Text, building self = self where c_mktsegment == "BUILDING" }',
        "let rich = customer where c_acctbal > 5000")
    return s.execute("building (rich) { c_custkey, c_acctbal }")


@code(
    "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'Missing' ELSE 'Rich' END AS variant FROM orders LEFT JOIN (SELECT * "
    "FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey"
)
def declared_fallback(ctx):
    """The field declares what follows a customer that is not there; the query only names the join."""
    orders = replace(CATALOG.tables["orders"], edges=(Edge("o_custkey", "Rich", "c_custkey", ("Missing",)),))
    catalog = CATALOG.with_table(replace(CATALOG.tables["customer"], name="Rich")).with_table(orders)
    rich = ctx.frame("customer").where("c_acctbal > 5000")
    return run("orders >< Rich as who { o_orderkey, who.tag as variant }", replace(ctx, catalog=catalog, frames={"Rich": rich}))


@code(
    "SELECT o_orderkey, o_totalprice * (1 + 0.0001 * date_diff('millisecond', o_orderdate, TIMESTAMP '2001-09-01') / "
    "86400000.0::DOUBLE) AS due FROM orders WHERE o_totalprice * (1 + 0.0001 * date_diff('millisecond', o_orderdate, "
    "TIMESTAMP '2001-09-01') / 86400000.0::DOUBLE) > 200000"
)
def behavior_text(ctx):
    t = replace(CATALOG.tables["orders"], behaviors=(("due", parse(
        "orders { (\\t -> o_totalprice * (1 + 0.0001 * days (t - o_orderdate))) as f }"
    ).items[0].expr),))
    return run('orders at "2001-09-01T00:00:00Z" where due > 200000 { o_orderkey, due }', replace(ctx, catalog=CATALOG.with_table(t)))


@code(
    "SELECT part, CASE part WHEN 'small' THEN p_size * 1.0::DOUBLE ELSE -1.0::DOUBLE END AS v, p_partkey "
    "FROM (SELECT p_partkey, p_size, CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END AS part FROM part)"
)
def sum_values(ctx):
    col = lambda p: F.col(p.name)
    made = ctx.frame("part").select(
        "p_partkey",
        F.struct(F.when(F.col("p_size") < 10, "small").otherwise("large").alias("tag"), F.col("p_size").cast("double").alias("payload")).alias("s"),
    )
    arms = (("small", Path(("x",))), ("large", Bin("-", Lit(0.0), Lit(1.0))))
    return made.select("p_partkey", F.col("s.tag").alias("part"), lower(Match(Path(("s",)), arms, ("small", "large")), col, None).alias("v"))


# --- writes
@code(
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer "
    "WHERE c_custkey % 7 <> 0 UNION ALL SELECT 900001, 5.5::DOUBLE"
)
def insert_update_delete(ctx):
    t = replace(CATALOG.tables["customer"], columns=("c_custkey", "c_acctbal"), edges=())
    slim = replace(
        ctx,
        catalog=CATALOG.with_table(t),
        frames={"customer": ctx.frame("customer").select(
            "c_custkey",
            "c_acctbal",
            (F.col("c_custkey") % 5 == 0).alias("a"),
            (F.col("c_custkey") % 7 == 0).alias("b"),
        )},
    )
    slim = replace(slim, catalog=slim.catalog.with_table(replace(t, columns=("c_custkey", "c_acctbal", "a", "b"))))
    s = _session(slim, "customer where a == True { c_acctbal = c_acctbal + 100 }", "delete customer where b == True",
        "customer { c_custkey = 900001, c_acctbal = 5.5, a = False, b = False }"
    )
    return s.execute("customer { c_custkey, c_acctbal }")


_SHOP = """
type Amount : Decimal where >= 0
table Buyer { email : Text, name : Text, unique ref { email } }
table Sale { num : Int unique, buyer :> Buyer, total : Amount, status : Text = "Pending" }
view Pending = Sale >< Buyer where status == "Pending" { num, buyer, total, name }
monitor Sale.total
"""


@code("SELECT * FROM (VALUES (1::BIGINT, 'ann', 3.0::DOUBLE, 'Ann', 'Pending'), (2, 'bob', -4.0, 'Bob', 'Pending')) t(num, buyer, total, name, status)")
def write_through_view(ctx):
    s = _session(ctx, _SHOP, 'Pending { num = 1, buyer = "ann", total = 3, name = "Ann" }', 'Pending { num = 2, buyer = "bob", total = 0 - 4, name = "Bob" }')
    return s.execute("Sale >< Buyer { num, buyer, total, name, status }")


@code("SELECT 'Sale' AS subject_table, '2' AS subject, 'Sale.total / >= 0' AS functor, 'Derived' AS origin, '-4.0' AS observed, 'Open' AS state")
def show_violations(ctx):
    s = _session(ctx, _SHOP, 'Pending { num = 1, buyer = "ann", total = 3, name = "Ann" }', 'Pending { num = 2, buyer = "bob", total = 0 - 4, name = "Bob" }')
    return s.execute("show violations for Sale.total").drop("schema_node")


@code(
    "SELECT 1::BIGINT AS tx_seq, 'Buyer' AS \"table\", 'I' AS op, 1::BIGINT AS mutations UNION ALL SELECT 2, 'Sale', 'I', 1 "
    "UNION ALL SELECT 3, 'Sale', 'U', 1 UNION ALL SELECT 4, 'Sale', 'D', 1"
)
def show_transactions(ctx):
    s = _session(ctx, _SHOP, 'Pending { num = 1, buyer = "ann", total = 3, name = "Ann" }', "Sale where num == 1 { total = 9 }", "delete Sale where num == 1")
    return s.execute("show transactions").select("tx_seq", "table", "op", "mutations")


_RULES_SQL = "CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 1 THEN 'refused' ELSE 'accepted' END"


@code(
    f"SELECT c_custkey, {_RULES_SQL} AS outcome, CASE WHEN {_RULES_SQL} = 'accepted' THEN concat(c_custkey, '$', "
    f"sha256(concat(c_custkey, c_name))) ELSE c_name END AS stored FROM customer"
)
def field_write_steps(ctx):
    """Coerce, validate, decide, transform: `forward` lets unchanged bad values be; the name is stored as a salted digest."""
    rows = ctx.frame("customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_name")
    before = ctx.frame("customer").where("c_custkey % 2 = 0").select("c_custkey", "c_acctbal")
    rules = [writes.FieldRule("customer.c_acctbal / >= 0", "c_acctbal", F.col("c_acctbal") >= 0, "enforce forward")]
    out = writes.write(
        rows,
        "customer",
        "c_custkey",
        rules,
        kinds={"c_custkey": "long", "c_acctbal": "double"},
        transforms={"c_name": writes.salted_digest(F.col("c_name"), F.col("c_custkey").cast("string"))},
        before=before,
    )
    part = lambda df, how: df.select("c_custkey", F.lit(how).alias("outcome"), F.col("c_name").alias("stored"))
    return part(out.accepted, "accepted").unionByName(part(out.refused, "refused"))


@code(
    "SELECT c_custkey::VARCHAR AS subject, 'customer.c_acctbal / >= 0' AS functor, 'n1' AS schema_node, c_acctbal::VARCHAR AS "
    "observed FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey::VARCHAR, 'customer.c_name / short', 'n1', "
    "'Redacted' FROM customer WHERE length(c_name) > 18"
)
def violations_at_node(ctx):
    rules = [
        writes.FieldRule("customer.c_acctbal / >= 0", "c_acctbal", F.col("c_acctbal") >= 0, "monitor"),
        writes.FieldRule("customer.c_name / short", "c_name", F.length("c_name") <= 18, "monitor", secret=True),
    ]
    return writes.write(ctx.frame("customer"), "customer", "c_custkey", rules, node="n1").violations.select("subject", "functor", "schema_node", "observed")


@code("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def repair_queue(ctx):
    rules = [writes.FieldRule("customer.c_acctbal / >= 0", "c_acctbal", F.col("c_acctbal") >= 0, "repair into", "Fixes")]
    return writes.write(ctx.frame("customer"), "customer", "c_custkey", rules).repairs["Fixes"].select("c_custkey", "c_acctbal")


# --- logs, ids, components
_ALPHABET = CROCKFORD


@code(
    f"WITH v AS (SELECT event_id, ts, ((epoch_us(ts) // 1000)::HUGEINT * 281474976710656 + (event_id % 7) * 4294967296 + "
    f"event_id) * 16 AS v FROM events) SELECT event_id, date_trunc('millisecond', ts) AS created, (event_id % 7)::INT AS "
    f"server, array_to_string(list_transform(range(19, -1, -1), lambda k: substr('{_ALPHABET}', ((v // (1::HUGEINT << (5 * "
    f"k)::INT)) % 32)::INT + 1, 1)), '') AS id FROM v"
)
def virtual_columns(ctx):
    e = ctx.frame("events")
    rid = data_id(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 7, F.col("event_id"))
    made = virtual(F.col("rid"))
    return e.select("event_id", rid.alias("rid")).select(
        "event_id",
        made["created_at"].alias("created"),
        made["origin_server"].alias("server"),
        made["id"].alias("id"),
    )


@code(
    "SELECT printf('%08x%016x%04x', 3, l_orderkey, l_linenumber) AS id, 3::BIGINT AS shard, l_orderkey AS seq, l_linenumber "
    "AS place, l_partkey, l_suppkey FROM lineitem"
)
def row_version_id(ctx):
    li = ctx.frame("lineitem").select("l_partkey", "l_suppkey", version_id(F.lit(3), F.col("l_orderkey"), F.col("l_linenumber")).alias("rid"))
    shard, seq, place = version_parts(F.col("rid"))
    return li.select(F.lower(F.hex("rid")).alias("id"), shard.alias("shard"), seq.alias("seq"), place.alias("place"), "l_partkey", "l_suppkey")


@code("SELECT event_id, concat('node', event_id % 7) AS host FROM events WHERE event_id % 7 < 5")
def origin_server_join(ctx):
    """Rows to the nodes that made them: the server in the id is a reference by the node's key."""
    nodes = ctx.spark.range(5).select(F.col("id").cast("int").alias("node_id"), F.concat(F.lit("node"), F.col("id")).alias("host"))
    rid = data_id(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 7, F.col("event_id"))
    made = ctx.frame("events").select("event_id", virtual(rid)["origin_server"].alias("origin_server"))
    catalog = CATALOG.with_table(TableDef("Node", ("node_id", "host"), ("node_id",))).with_table(TableDef(
        "Made",
        ("event_id", "origin_server"),
        ("event_id",),
        (Edge("origin_server", "Node", "node_id"),),
    ))
    return run("Made >< Node { event_id, host }", replace(ctx, catalog=catalog, frames={"Made": made, "Node": nodes}))


def _stored_log(ctx: Context) -> txlog.TxLog:
    """A log of nations in the store: one transaction a region, and a delete."""
    log = txlog.TxLog(ctx.spark, f"{_scratch(ctx)}/nations", "n_nationkey int, n_name string")
    rows = ctx.frame("nation")
    for r in range(5):
        log.append(rows.where(F.col("n_regionkey") == r).select("n_nationkey", "n_name"), "I", f"2001-01-0{r + 1} 00:00:00", ["n_nationkey"])
    log.append(rows.where("n_nationkey % 2 = 0").select("n_nationkey", "n_name"), "D", "2001-02-01 00:00:00", ["n_nationkey"])
    return log


def _scratch(ctx: Context) -> str:
    """A new folder in the shared store of the cluster."""
    base = ctx.spark.conf.get("spark.checkpoint.dir", None) or ctx.spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/larkspur-{uuid.uuid4().hex}"


_LOG = (
    "SELECT n_nationkey, n_name, n_regionkey + 1 AS tx_seq, 'I' AS op, (row_number() OVER (PARTITION BY n_regionkey "
    "ORDER BY n_nationkey) - 1)::INT AS row_pos FROM nation UNION ALL "
    "SELECT n_nationkey, n_name, 6, 'D', (row_number() OVER (ORDER BY n_nationkey) - 1)::INT FROM nation "
    "WHERE n_nationkey % 2 = 0"
)


@code(f"SELECT n_nationkey, n_name, tx_seq::BIGINT AS tx_seq, op, row_pos FROM ({_LOG})")
def log_scan(ctx):
    return _stored_log(ctx).scan().select("n_nationkey", "n_name", "tx_seq", "op", "row_pos")


@code(f"SELECT n_nationkey, n_name, row_pos FROM ({_LOG}) WHERE tx_seq = 3")
def log_read(ctx):
    return _stored_log(ctx).read(3).select("n_nationkey", "n_name", "row_pos")


@code(f"SELECT tx_seq::BIGINT AS tx_seq, op, count(*) AS mutations FROM ({_LOG}) WHERE tx_seq >= 3 GROUP BY tx_seq, op")
def log_transactions(ctx):
    return _stored_log(ctx).transactions(since=3).select("tx_seq", "op", "mutations")


@code("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 ORDER BY l_linenumber")
def component_subtree(ctx):
    li = ctx.frame("lineitem").withColumn("path", txlog.tree_path(F.col("l_orderkey"), F.col("l_linenumber")))
    return txlog.subtree(li, "path", "00000007").select("l_orderkey", "l_linenumber", "l_partkey")


# --- views that are kept
@code(
    "SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM (SELECT o_custkey, o_totalprice FROM orders "
    "WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_custkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 3 = 0 "
    "AND o_orderkey % 2 = 1 AND o_orderdate + INTERVAL 365 DAY <= TIMESTAMP '2003-01-01' UNION ALL "
    "SELECT o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 "
    "AND o_orderdate + INTERVAL 365 DAY > TIMESTAMP '2003-01-01') GROUP BY o_custkey"
)
def incremental_view(ctx):
    """A view kept since 2000, brought to 2003: only customers with later versions are computed anew."""
    ctx = _versioned(ctx)
    view = parse("Placed group o_custkey { o_custkey, o_totalprice sum as total, o_orderkey count as n }")
    old = run(view, replace(ctx, moment="2000-01-01 00:00:00"))
    return incremental(view, replace(ctx, moment="2003-01-01 00:00:00"), old, "2000-01-01 00:00:00")


@code("SELECT c_custkey, c_name, c_acctbal FROM customer")
def schema_at_token(ctx):
    """A field is renamed and another dropped; the query is pinned to the schema before."""
    t = replace(CATALOG.tables["customer"], columns=("c_custkey", "c_name", "c_acctbal"), edges=())
    g = graph.Graph().commit(CATALOG.with_table(t)).tag("v1")
    g = g.commit(CATALOG.with_table(replace(t, columns=("c_custkey", "c_label"), renamed=(("c_label", "c_name"),))))
    now = g.commits[g.branches["main"]].catalog
    stored = ctx.frame("customer").select("c_custkey", F.col("c_name").alias("c_label"), "c_acctbal")
    return run('customer at "v1" { c_custkey, c_name, c_acctbal }', replace(ctx, catalog=now, history=g.tokens(), frames={"customer": stored}))


@code("SELECT c_custkey, c_name AS c_label, NULL::VARCHAR AS c_phone, 'NotFound' AS c_phone__tag FROM customer")
def schema_added_field(ctx):
    """Rows of before under the schema of now: a renamed field keeps its values, a new one is NotFound."""
    t = replace(CATALOG.tables["customer"], columns=("c_custkey", "c_label", "c_phone"), edges=(), renamed=(("c_label", "c_name"),))
    g = graph.Graph().commit(CATALOG).commit(CATALOG.with_table(t))
    return run("customer { c_custkey, c_label, c_phone, c_phone__tag }", replace(ctx, catalog=g.commits[g.branches["main"]].catalog, history=g.tokens()))


@code(
    "SELECT * FROM (VALUES ('added', 'c_phone'), ('omitted', 'c_acctbal'), ('omitted', 'c_nationkey'), ('omitted', "
    "'c_mktsegment'), ('renamed', 'c_name > c_label')) t(change, field)"
)
def redeclare_diff(ctx):
    old = CATALOG.tables["customer"]
    new = replace(old, columns=("c_custkey", "c_label", "c_phone"), edges=(), renamed=(("c_label", "c_name"),))
    d = graph.diff(old, new)
    rows = [*[("added", c) for c in d.added], *[("omitted", c) for c in d.omitted], *[("renamed", f"{o} > {n}") for n, o in d.renamed]]
    return ctx.spark.createDataFrame(rows, "change string, field string")


def _rank_sql(rounds: int = 30) -> str:
    """The same fixed number of rounds as recursive SQL over the catalog's references."""
    nodes = sorted(CATALOG.tables)
    n = len(nodes)
    edges = sorted({(t.name, e.to) for t in CATALOG.tables.values() for e in t.edges})
    links = ", ".join(f"('{a}', '{b}')" for a, b in edges)
    names = ", ".join(f"('{x}')" for x in nodes)
    return (
        f"WITH RECURSIVE nodes(name) AS (VALUES {names}), links(a, b) AS (VALUES {links}), degree AS (SELECT a, count(*) AS d FROM links GROUP BY a), "
        f"step AS (SELECT 0 AS i, name, 1.0::DOUBLE / {n} AS r FROM nodes UNION ALL "
        f"SELECT s.i + 1, x.name, (0.15 + 0.85 * (SELECT sum(q.r) FROM step q WHERE q.name NOT IN (SELECT a FROM links))) / {n} + 0.85 * coalesce((SELECT sum(q.r / d.d) FROM step q JOIN links l ON l.a = q.name JOIN degree d ON d.a = q.name WHERE l.b = x.name), 0) "
        f"FROM nodes x, (SELECT max(i) AS i FROM step) s WHERE s.i < {rounds}) SELECT name, round(r, 9) AS rank FROM step WHERE i = {rounds}"
    )


@code(_rank_sql())
def schema_rank(ctx):
    ranks = graph.pagerank(replace(CATALOG, views={}))
    return ctx.spark.createDataFrame([(n, round(r, 9)) for n, r in ranks.items()], "name string, rank double")


# --- access
@code(
    "SELECT * FROM (VALUES ('ann', 'app.pm.Doc', true, false), ('ann', 'app.hr.Pay', false, false), ('ann', 'app', false, "
    "false), ('adm', 'app.pm.Doc', true, true), ('adm', 'sys.Log', false, false)) t(role, target, readable, bypass)"
)
def grants_reach(ctx):
    g = access.Grants().grant("ann", "app.pm").grant("adm", "app", True)
    rows = [(r, t, g.can_read(r, t), g.bypasses(r, t)) for r, t in (
        ("ann", "app.pm.Doc"),
        ("ann", "app.hr.Pay"),
        ("ann", "app"),
        ("adm", "app.pm.Doc"),
        ("adm", "sys.Log"),
    )]
    return ctx.spark.createDataFrame(rows, "role string, target string, readable boolean, bypass boolean")


# --- documents
@code(
    "WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), t AS (SELECT key, CASE "
    "WHEN json_type(json_extract(props, '$.' || key)) IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' "
    "WHEN json_type(json_extract(props, '$.' || key)) = 'VARCHAR' THEN 'STRING' "
    "ELSE json_type(json_extract(props, '$.' || key)) END AS kind FROM k) "
    "SELECT key, count(*) AS present, count(*)::DOUBLE / (SELECT count(*) "
    "FROM events) AS share, array_to_string(list_sort(list(DISTINCT kind)), ',') AS types FROM t GROUP BY key"
)
def doc_key_census(ctx):
    return documents.census(ctx.frame("events"), "props").withColumn("types", F.array_join("types", ","))


# --- rollups
_TEMPLATE = rollup.Template(
    ("event_type",),
    (
        rollup.Measure("n", "count"),
        rollup.Measure("users", "distinct", "user_id"),
        rollup.Measure(
            "spread",
            rollup.MergeableAgg(lambda c: F.struct(F.max(c).alias("a"), F.min(c).alias("b")), lambda c: F.struct(F.max(c["a"]).alias("a"), F.min(c["b"]).alias("b")), lambda c: c["a"] - c["b"]),
            "value",
        ),
    ),
    "ts",
)


@code("SELECT date_trunc('month', ts) AS bucket_start, event_type, count(*) AS n, max(value) - min(value) AS spread, true AS near FROM events GROUP BY 1, 2")
def sketch_chain(ctx):
    """Distinct users by sketch and a custom aggregate, merged hour to day to month; the sketch is within 5 % of the count."""
    raw = ctx.frame("events")
    level = _TEMPLATE.level(raw, "hour")
    month = _TEMPLATE.read(_TEMPLATE.coarser(_TEMPLATE.coarser(level, "day"), "month"))
    exact = raw.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return month.join(exact, "event_type").select(
        "bucket_start",
        "event_type",
        "n",
        "spread",
        (F.abs(F.col("users") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"),
    )


_PLAIN = rollup.Template(("event_type",), (rollup.Measure("n", "count"), rollup.Measure("total", "sum", "value")), "ts")


@code(
    "SELECT 'level' AS part, date_trunc('day', ts)::VARCHAR AS bucket, event_type, count(*) AS n FROM events "
    "WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2, 3 UNION ALL SELECT 'raw', NULL, event_type, count(*) FROM events "
    "WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 3 UNION ALL SELECT 'record', min(event_id)::VARCHAR || '-' || "
    "max(event_id)::VARCHAR, NULL, count(*) FROM events WHERE ts < TIMESTAMP '2024-01-15'"
)
def rollup_two_appends(ctx):
    """First the level's rows, then the prune record; the level is written twice, as after a crash, and changes nothing."""
    raw = ctx.frame("events").withColumn("tx_seq", F.col("event_id"))
    empty = _PLAIN.level(raw.limit(0), "day")
    once, _ = rollup.roll_over(raw, empty, _PLAIN, "day", "2024-01-15")
    level, record = rollup.roll_over(raw, once, _PLAIN, "day", "2024-01-15")
    left = rollup.pruned(raw, record, "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    out = level.select(F.lit("level").alias("part"), F.date_format("bucket_start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "event_type", "n")
    out = out.unionByName(left.select(F.lit("raw").alias("part"), F.lit(None).cast("string").alias("bucket"), "event_type", "n"))
    said = record.select(
        F.lit("record").alias("part"),
        F.concat_ws("-", "first_seq", "last_seq").alias("bucket"),
        F.lit(None).cast("string").alias("event_type"),
        F.col("n_rows").alias("n"),
    )
    return out.unionByName(said)


@code(
    "SELECT event_type, grain, sum(n)::BIGINT AS n FROM (SELECT event_type, CASE WHEN event_type = 'click' THEN CASE "
    "WHEN ts < TIMESTAMP '2024-01-24' THEN 'day' ELSE 'raw' END ELSE CASE WHEN ts < TIMESTAMP '2024-01-17' THEN 'gone' "
    "ELSE 'raw' END END AS grain, 1 AS n FROM events) WHERE grain <> 'gone' GROUP BY event_type, grain"
)
def retain_text(ctx):
    """A chain with a branch, written as text: clicks keep days of what is a week old, other events go after two weeks."""
    s = Session(ctx, "2024-01-31 00:00:00")
    s.execute("aggregate PerDay = events group event_type { event_type, value count as n, value sum as total }")
    s.execute('retain events as PerDay using ts where event_type == "click" for 7 days, by day forever otherwise for 14 days, drop')
    parts = []
    for levels in s.levels_of("events"):
        for grain, df in levels.items():
            n = F.count(F.lit(1)) if grain == "raw" else F.sum("n")
            parts.append(df.groupBy("event_type").agg(n.cast("long").alias("n")).withColumn("grain", F.lit(grain)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("event_type", "grain", "n")


# --- sources and formats
_CHANGES = (
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 4 <> 0 UNION ALL "
    "SELECT c_custkey, upper(c_name), c_acctbal FROM customer WHERE c_custkey % 8 = 0"
)


@code("SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 4 = 0 THEN 'changed' ELSE c_name END AS name FROM customer WHERE c_custkey % 6 <> 0")
def change_log_stream(ctx):
    """A folder of change files, followed as a stream into a version log; read twice, as after a restart."""
    base = _scratch(ctx)
    c = ctx.frame("customer")
    payload = lambda name: F.to_json(F.struct(name.alias("name")))
    row = lambda df, seq, op, name: df.select(F.lit("src").alias("connector_id"), (F.col("c_custkey") * 10 + seq).alias("external_seq"), F.lit("2024-01-01").cast("timestamp").alias("external_timestamp"), F.lit(op).alias("operation"), F.lit("customer").alias("external_table"), F.col("c_custkey").cast("string").alias("external_key"), payload(name).alias("external_payload"))
    all_ = row(c, 1, "insert", F.col("c_name")).unionByName(row(c.where("c_custkey % 4 = 0"), 2, "update", F.lit("changed"))).unionByName(row(c.where("c_custkey % 6 = 0"), 3, "delete", F.lit(None).cast("string"))).unionByName(row(c.limit(1), 9, "truncate", F.lit(None).cast("string")))
    all_.repartition(3).write.json(f"{base}/changes")
    for _ in range(2):
        changelog.follow(changelog.changes(ctx.spark, f"{base}/changes", 2), "customer", "name string", f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return changelog.state(ctx.spark.read.parquet(f"{base}/log")).select("id", "name")


@code("SELECT event_id, event_type FROM events WHERE event_id > 500")
def polled_source(ctx):
    rows, cursor = changelog.poll(lambda since: ctx.frame("events").where("event_id <= 5000"), 500, "event_id")
    more, _ = changelog.poll(lambda since: ctx.frame("events"), cursor, "event_id")
    return rows.unionByName(more).select("event_id", "event_type")


@code("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def webhook_rows(ctx):
    good, bad = changelog.webhook(ctx.frame("events").select("event_id", "props"), "props", "k string")
    return good.select("event_id", "k")


@code("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"at.region\":' || n_regionkey || ',\"at.name\":\"' || n_name || '\"}' AS line FROM nation")
def format_json_flat(ctx):
    return connectors.rendered(
        ctx.frame("nation").select("n_nationkey", F.struct(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name")).alias("at")),
        "json-flat",
    )


@code(
    "SELECT n_nationkey || ',' || n_name AS line FROM nation UNION ALL SELECT n_nationkey || chr(9) || n_name FROM nation "
    "UNION ALL SELECT '{\"data\":{\"node\":{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}}}' "
    "FROM nation"
)
def format_rows(ctx):
    df = ctx.frame("nation").select("n_nationkey", "n_name")
    return connectors.rendered(df, "csv").unionByName(connectors.rendered(df, "raw")).unionByName(connectors.rendered(df, "graphql"))


@code(
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_name || '!' "
    "ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 'equal' WHEN c_custkey % 3 = 0 THEN 'ours by sequence' "
    "WHEN c_custkey % 3 = 1 THEN 'theirs by time' ELSE 'manual' END AS resolution FROM customer"
)
def conflict_cascade(ctx):
    c = ctx.frame("customer")
    ours = c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, "1.2.3").otherwise("1.2").alias("seq"), F.lit(10).alias("at"))
    theirs = c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("!"))).alias("c_name"),
        F.when(F.col("c_custkey") % 3 == 0, "1.2").otherwise("1.5").alias("seq"),
        F.when(F.col("c_custkey") % 3 == 1, 20).otherwise(10).alias("at"),
    )
    return connectors.resolve(ours, theirs, "c_custkey", ["c_name"], "seq", "at")


@code(
    "WITH new AS (SELECT p_type, count(*) AS n FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_partkey <= 3) "
    "GROUP BY p_type) SELECT p_type AS code, 'crm' AS added_by FROM (SELECT * FROM new ORDER BY n DESC, p_type LIMIT 2) "
    "UNION ALL SELECT DISTINCT p_type, NULL FROM part WHERE p_partkey <= 3"
)
def auto_extension(ctx):
    """Codes of a source that the reference lacks extend it, two of a batch."""
    known = ctx.frame("part").where("p_partkey <= 3").select(F.col("p_type").alias("code")).distinct()
    grown, _ = evolution.auto_extend(ctx.frame("part"), "p_type", known, "code", True, "crm", 2)
    return grown.select("code", "added_by")


# --- queues
@code(
    "WITH a AS (SELECT event_type, value, ts FROM events WHERE ts <= TIMESTAMP '2024-01-20' "
    "AND ts > TIMESTAMP '2024-01-10'), r AS (SELECT event_type AS destination, count(*) AS attempts, count(*) FILTER (value > "
    "50) AS failures FROM a GROUP BY 1), w AS (SELECT *, failures / attempts::DOUBLE AS rate FROM r) "
    "SELECT destination, attempts, failures, CASE WHEN rate > 0.1 THEN (least(1000 * power(2, floor((rate - 0.1) * 10)), "
    "60000) * (1000 + ('0x' || substr(md5(destination), 1, 6))::BIGINT % 401 - 200) / 1000)::DECIMAL(18, 3) "
    "ELSE 0 END AS wait_ms FROM w"
)
def failure_backoff(ctx):
    attempts = ctx.frame("events").select(
        F.col("event_type").alias("destination"),
        F.col("ts").alias("attempted_at"),
        F.when(F.col("value") > 50, "failed").alias("error"),
    )
    rates = events.failure_rates(attempts, "2024-01-20 00:00:00", "10 days")
    return events.volume_backoff(rates, 0.1, 1000, 60000).select("destination", "attempts", "failures", F.col("wait_ms").cast("decimal(18,3)").alias("wait_ms"))


# --- functors
@code(
    "SELECT c_custkey, length(c_name) <= 18 AND c_name LIKE 'Customer#%' AS ok, CASE WHEN length(c_name) <= 18 "
    "AND c_name LIKE 'Customer#%' THEN upper(c_name) END AS value, CASE WHEN length(c_name) > 18 THEN 'short failed' "
    "WHEN c_name NOT LIKE 'Customer#%' THEN 'shaped failed' END AS error FROM customer"
)
def functor_chain(ctx):
    """Functions of different shapes, lifted and run one after the other up to the first failure."""
    r = registry.Registry()
    r.register("short", "Text -> Bool", lambda x: F.length(x) <= 18)
    r.register("shaped", "Text -> Maybe Text", lambda x: F.when(F.startswith(x, F.lit("Customer#")), x))
    r.register("loud", "Text -> Text", F.upper)
    out = r.chain(["short", "shaped", "loud"], F.col("c_name"), "Text")
    return ctx.frame("customer").select("c_custkey", out.alias("o")).select("c_custkey", "o.ok", "o.value", "o.error")


@code(
    "SELECT '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS line FROM orders "
    "WHERE o_orderstatus = 'F' AND o_totalprice > 250000"
)
def api_endpoint(ctx):
    """An API functor: the route finds it, its parameters become literals, its format renders the rows."""
    ends = [registry.Endpoint("/orders",
        "orders where o_orderstatus == $status && o_totalprice > $least { o_orderkey, o_orderstatus }",
        "json", ("status", "least")), registry.Endpoint("/", "nation { n_name }")]
    end = registry.route(ends, "/orders/list")
    return connectors.rendered(run(end.text(status="F", least=250000), ctx), end.format)


# --- what the checker refuses, and what it says
def _said(f) -> str:
    """The message of a refusal, or accepted."""
    try:
        out = f()
    except ValueError as e:
        return str(e)
    return "accepted" if not isinstance(out, str) else out


_REFUSALS = [
    ("outer where", (
        "documents >< labels | NoLabel as l where l.toxic == 1 { documents.doc_id }"
    ), (
        "where on l.toxic of the guarded source l: filter before the guard, as in >< (l where ...) | ..."
    )),
    ("clock", "orders where o_orderdate < now 1 { o_orderkey }", "now: a query reads its sample moment, never a clock or a random source"),
    ("secret as a filter", 'customer where "x" `matches` c_name { c_custkey }', (
        "matches applies to one resolved row, after a unique field has narrowed the query; it is no row filter"
    )),
    ("no version", 'orders at "1995-01-01" { o_orderkey }', "orders keeps no versions: it has no state at 1995-01-01"),
    ("unknown token", 'orders at "v9" { o_orderkey }', "'v9' names no version of the schema"),
    ("ambiguous join", "lineitem >< nation { l_orderkey }", "no reference joins nation"),
    ("reverse without as", "customer >< orders | NoEvents { c_custkey }", "a reverse join to orders that is named in the query needs `as`"),
    ("unnamed expression", "orders { o_totalprice * 2 }", "an expression in a projection needs a name: as <name>"),
    ("unknown function", "orders { fly o_orderkey as x }", "unknown function fly"),
]


def _values(rows: list[tuple[str, ...]], *names: str) -> str:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) t({', '.join(names)})"


@code(_values([(name, message) for name, _, message in _REFUSALS], "kind", "message"))
def refused_queries(ctx):
    rows = [(name, _said(lambda q=query: run(q, ctx))) for name, query, _ in _REFUSALS]
    return ctx.spark.createDataFrame(rows, "kind string, message string")


_CHAINS = [
    ("merge", (
        "events as P using ts for 7 days, by day for 40 days, by month forever"
    ), (
        "p90: percentile has no merge; it may only be computed in a chain of one step"
    )),
    ("as is missing", "events using ts for 7 days, by day forever", "`as` names the aggregate if a chain has more than one step, and only then"),
    ("as is too much", "events as S using ts forever", "`as` names the aggregate if a chain has more than one step, and only then"),
    ("no end", "events as S using ts for 7 days, by day for 1 month", "a chain ends, and only ends, in forever or drop"),
    ("finer", "events as S using ts for 40 days, by month for 70 days, by day forever", "each step's grain must be coarser than the one before"),
    ("too short", "events as S using ts for 7 days, by month forever", "rows kept for 7 days do not cover one month"),
    ("branch on a value", (
        "events as S using ts where value > 3 for 7 days, by day forever otherwise forever"
    ), (
        "a branch may only tell rows apart by group fields and the time, not by value"
    )),
    ("fine", "events as S using ts for 7 days, by day forever", "retain events"),
]


@code(_values([(name, message) for name, _, message in _CHAINS], "kind", "message"))
def refused_chains(ctx):
    s = _session(ctx,
        "aggregate S = events group event_type { event_type, value sum as total }",
        "aggregate P = events group event_type { event_type, value percentile 0.9 as p90 }"
    )
    rows = [(name, _said(lambda t=chain: s.execute(f"retain {t}"))) for name, chain, _ in _CHAINS]
    return ctx.spark.createDataFrame(rows, "kind string, message string")


_ASSERTS = [
    ("anchored", "orders.a { self >< customer >< nation }", "orders.a"),
    ("unanchored", "orders.b { self >< part }", "orders.b: part is not reached from self along references"),
    ("pattern from input", "customer.c { c_name =~ c_mktsegment }", "customer.c: the right side of =~ is a literal or a reference value, never input"),
    ("mixed", "customer.d { authed_user == c_name && c_acctbal >= 0 }", (
        "d: a conjunct on c_acctbal does not mention authed_user and is bypassed with the rest; split it into two asserts"
    )),
    ("turned", "orders.a { (self >< customer >< nation) || authed_user == o_orderstatus }", (
        "orders.a is now an ACCESS constraint (mentions authed_user). It will be evaluated on read, and rows failing it will "
        "resolve to Redacted."
    )),
]


@code(_values([(name, message) for name, _, message in _ASSERTS], "kind", "message"))
def assert_reports(ctx):
    s = _session(ctx)

    def tell(text_: str) -> str:
        out = s.execute(f"assert {text_}")
        return s.notes[0] if s.notes else out

    return ctx.spark.createDataFrame([(name, _said(lambda t=body: tell(t))) for name, body, _ in _ASSERTS], "kind string, message string")


# --- absences, unions, sources
text("maybe_functions",
    'documents >< labels | NoLabel as l { documents.doc_id, isNothing l.quality as absent, fromMaybe (0 - 1) l.quality as '
    'quality, contains text "the" as has }',
    "SELECT d.doc_id, l.quality IS NULL AS absent, coalesce(l.quality, -1) AS quality, contains(text, 'the') AS has "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
)


@code(
    "SELECT 'event_type,part' AS key, max(n) AS most FROM (SELECT event_type, part, count(*) AS n "
    "FROM (SELECT DISTINCT event_type, 'low' AS part FROM events WHERE value < 50 UNION SELECT DISTINCT event_type, 'high' "
    "FROM events WHERE value >= 50) GROUP BY 1, 2)"
)
def union_key(ctx):
    """The key of a union of two grouped parts needs the discriminator; it is checked against the rows."""
    from .plans.keys import derive

    part = lambda cond, name: parse(f'(events where {cond} group event_type {{ event_type }}) {{ event_type, "{name}" as part }}')
    rel = part("value < 50", "low") | part("value >= 50", "high")
    key = derive(rel, CATALOG)
    counted = run(rel, ctx).groupBy(*key.columns).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.lit(",".join(key.columns) if key.meaningful else "degenerate").alias("key"), F.max("n").alias("most"))


@code(
    "SELECT table_name AS \"table\", column_name AS \"column\", ordinal_position::INT AS place "
    "FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem', 'events', 'customer')"
)
def shadow_schema(ctx):
    """Tables of a source, as discovered from its own schema."""
    from .plans.model import discover

    found = [discover(ctx.frame(n), n) for n in ("orders", "lineitem", "events", "customer")]
    return ctx.spark.createDataFrame([(t.name, c, i + 1) for t in found for i, c in enumerate(t.columns)], "`table` string, `column` string, place int")


@code("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <= 500")
def export_import(ctx):
    """A log's first transactions to a folder and back."""
    path = f"{_scratch(ctx)}/export"
    log = ctx.frame("orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").alias("tx_seq"))
    connectors.export_log(log, path, 500)
    return connectors.import_log(ctx.spark, path, "o_orderkey long, o_totalprice double, tx_seq long").select("o_orderkey", "o_totalprice")


@code("SELECT o_orderkey, 'differs' AS difference FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 2 = 0")
def verify_outside_latency(ctx):
    """Differences that are older than the source's latency; what is younger may still be on its way."""
    ours = ctx.frame("orders").select("o_orderkey", "o_orderstatus")
    theirs = ours.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.lit("?")).otherwise(F.col("o_orderstatus")))
    return connectors.verify_state(ours, theirs, "o_orderkey", ["o_orderstatus"], F.col("o_orderkey") % 2 == 0)


@code("SELECT c_custkey, c_custkey % 2 = 0 AS ok FROM customer WHERE c_custkey <= 6")
def secret_verify(ctx):
    """A digest is compared for one resolved row at a time."""
    users = ctx.frame("customer").select(
        "c_custkey",
        writes.salted_digest(F.when(F.col("c_custkey") % 2 == 0, "right").otherwise("other"), F.col("c_custkey").cast("string"), 2).alias("secret"),
    )
    rows = [(k, writes.matches(users.where(F.col("c_custkey") == k), "secret", "right", 2)) for k in range(7)]
    return ctx.spark.createDataFrame(rows, "c_custkey long, ok boolean")


# --- queues and streams
_QUEUE = (
    "SELECT o_orderkey AS id, o_orderpriority AS destination, o_orderdate AS scheduled_at, CASE "
    "WHEN o_orderkey % 10 = 0 THEN 'InFlight' ELSE 'Pending' END AS status, o_orderkey % 4 AS attempt_count FROM orders"
)


def _queue(ctx: Context) -> DataFrame:
    o = ctx.frame("orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("destination"),
        F.col("o_orderdate").alias("scheduled_at"),
        F.when(F.col("o_orderkey") % 10 == 0, "InFlight").otherwise("Pending").alias("status"),
        (F.col("o_orderkey") % 4).alias("attempt_count"),
        F.lit(None).cast("string").alias("last_error"),
    )


@code(
    f"WITH q AS ({_QUEUE}), f AS (SELECT destination, count(*) AS n FROM q WHERE status = 'InFlight' "
    f"GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY destination ORDER BY scheduled_at, id) AS n FROM q "
    f"WHERE status = 'Pending' AND scheduled_at <= TIMESTAMP '1998-01-01') SELECT id, destination, 'InFlight' AS status FROM r "
    f"JOIN f USING (destination) WHERE r.n + f.n <= 400"
)
def queue_dispatch(ctx):
    return events.due(_queue(ctx), "1998-01-01 00:00:00", 400).select("id", "destination", "status")


@code(
    f"SELECT id, CASE WHEN id % 3 = 0 THEN 'InFlight' WHEN id % 20 <> 0 THEN 'Done' WHEN attempt_count + 1 < 3 THEN 'Pending' "
    f"ELSE 'Failed' END AS status, CASE WHEN id % 3 <> 0 AND id % 20 = 0 THEN attempt_count + 1 "
    f"ELSE attempt_count END AS attempt_count, CASE WHEN id % 3 <> 0 AND id % 20 = 0 THEN 'boom' END AS last_error "
    f"FROM ({_QUEUE}) WHERE status = 'InFlight'"
)
def queue_settle(ctx):
    """Results of dispatched items: done, again after a wait, or failed for good; those without a result stay in flight."""
    told = ctx.frame("orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 20 == 0, "boom").alias("error"))
    return events.settle(_queue(ctx), told, "1998-01-01 00:00:00", 3, 1000, 60000).select("id", "status", "attempt_count", "last_error")


@code(
    "SELECT date_trunc('hour', ts) AS bucket_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 "
    "HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
)
def stream_buckets(ctx):
    """Hourly buckets of a stream; those that the watermark has not passed are not written yet."""
    base = _scratch(ctx)
    ctx.frame("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(f"{base}/in")
    source = ctx.spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{base}/in")
    template = rollup.Template(("event_type",), (rollup.Measure("n", "count"),), "ts")
    events.stream_rollup(source, template, "hour", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return ctx.spark.read.parquet(f"{base}/out").select("bucket_start", "event_type", "n")


@code(
    "SELECT * FROM (VALUES ('shortened', 'raw'), ('added', 'week'), ('rows moved', (SELECT count(*)::VARCHAR FROM events "
    "WHERE ts < TIMESTAMP '2024-01-24'))) t(effect, what)"
)
def policy_edit_report(ctx):
    """What a changed chain would do, before it is committed: raw rows are kept for less, a level is added."""
    old = [rollup.Step(None, "20 days"), rollup.Step("day", None)]
    new = [rollup.Step(None, "7 days"), rollup.Step("day", "30 days"), rollup.Step("week", None)]
    seen = rollup.policy_edit(_PLAIN, old[:1] + [rollup.Step("day", None)], [new[0], rollup.Step("day", None)], ctx.frame("events"), "2024-01-31 00:00:00")
    more = rollup.policy_edit(_PLAIN, old, new, ctx.frame("events"), "2024-01-31 00:00:00")
    rows = [*[("shortened", g) for g in seen["shortened"]], *[("added", g) for g in more["added"]], ("rows moved", str(seen["raw_rows_moved"]))]
    return ctx.spark.createDataFrame(rows, "effect string, what string")


@code(
    "SELECT o_orderkey, o_totalprice, access FROM (SELECT CASE WHEN ok THEN o_orderkey END AS o_orderkey, CASE "
    "WHEN ok THEN o_totalprice END AS o_totalprice, CASE WHEN ok THEN 'Granted' ELSE 'Redacted' END AS access "
    "FROM (SELECT *, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) OR o_orderstatus = 'P' AS ok "
    "FROM orders))"
)
def access_asserts(ctx):
    """Orders of the requester's nation, or still open, are readable; the others keep their place and nothing else."""
    s = Session(ctx, MOMENT, user=7, users="nation")
    s.execute('assert orders.mine { (self >< customer >< authed_user) || (o_orderstatus == "P" && authed_user == 7) }')
    return s.execute("orders { o_orderkey, o_totalprice, access }")


_MAILS = (
    "SELECT c_custkey, 'u' || c_custkey || '@' || CASE c_custkey % 4 WHEN 0 THEN 'trash.test' WHEN 1 THEN 'free.test' "
    "WHEN 2 THEN 'corp.test' ELSE 'bad host' END AS mail FROM customer"
)


@code(
    f"SELECT c_custkey, c_custkey % 4 = 0 AS disposable, c_custkey % 4 = 2 AS corporate, c_custkey % 4 = 1 AS blocked, "
    f"c_custkey % 4 <> 3 AS valid, c_mktsegment IN ('BUILDING', 'MACHINERY') AS known, lower(c_mktsegment) = 'building' AS "
    f"common FROM ({_MAILS}) JOIN customer USING (c_custkey)"
)
def domain_lists(ctx):
    """The predicates that read a list of the schema's."""
    from .functions import scalars

    scalars.LISTS.update(disposable=["trash.test"], public=["free.test"], blocked=["free.test"], statuses=["BUILDING", "MACHINERY"], common=["building"])
    host = F.element_at(F.array(F.lit("trash.test"), F.lit("free.test"), F.lit("corp.test"), F.lit("bad host")), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = ctx.frame("customer").withColumn("mail", F.concat(F.lit("u"), "c_custkey", F.lit("@"), host))
    t = replace(CATALOG.tables["customer"], columns=(*CATALOG.tables["customer"].columns, "mail"))
    out = run(
        "customer { c_custkey, isDisposableDomain mail as disposable, isCorporateDomain mail as corporate, isBlockedDomain mail "
        "as blocked, isValidEmail mail as valid, isKnownStatus c_mktsegment as known, isCommonWord c_mktsegment as common }",
        replace(ctx, catalog=CATALOG.with_table(t), frames={"customer": rows}))
    return out


text("stdlib",
    'part { p_partkey, take 4 p_name as start, "e" `isInfixOf` p_name as has, "1" `isSuffixOf` p_name as ends, length (strip '
    'p_name) as n, floor p_retailprice as whole, ceiling p_retailprice as up, truncate (0 - p_retailprice) as cut, elem "x" '
    '(words p_name) as x, upper p_brand as brand }',
    "SELECT p_partkey, left(p_name, 4) AS start, contains(p_name, 'e') AS has, ends_with(p_name, '1') AS ends, "
    "length(trim(p_name))::BIGINT AS n, floor(p_retailprice)::BIGINT AS whole, ceil(p_retailprice)::BIGINT AS up, "
    "trunc(-p_retailprice)::BIGINT AS cut, list_contains(string_split_regex(p_name, '\\s+'), 'x') AS x, upper(p_brand) AS "
    "brand FROM part"
)
