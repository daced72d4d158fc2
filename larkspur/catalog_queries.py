"""The registered queries of the engine and their SQL: one entry for each operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import documents, evolution, integrity, rollup, versions
from .plans.expr import Path
from .plans.lower import run
from .plans.model import TESTDATA, Context
from .plans.parser import parse
from .plans.rel import Rel
from .sources import connectors
from .streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CATALOG = TESTDATA.with_absence("Missing", "NoLabel", "NoEvents", "NoNation")


def _ctx(spark: SparkSession, folder: str, **more) -> Context:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Context(spark, folder, CATALOG, **more)


def text(name: str, query: str, sql: str) -> None:
    """Register a query given as text."""
    QUERIES[name] = lambda spark, folder: run(query, _ctx(spark, folder))
    ORACLES[name] = sql


def code(sql: str):
    """Register a function of a context under its own name."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, folder: f(_ctx(spark, folder))
        ORACLES[f.__name__] = sql
        return f

    return put


FLAGSHIP = """
orders >< customer where o_totalprice > 100000
group c_mktsegment { c_mktsegment, o_totalprice sum as revenue, o_orderkey count as n }
order by revenue desc
"""


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return run(FLAGSHIP, _ctx(spark, folder))


# --- filters and projections
text("filter_projection",
    "orders where o_totalprice > 200000 && o_orderstatus == \"O\" { o_orderkey, o_totalprice }",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'"
)
text("computed_alias",
    "lineitem { l_orderkey, l_extendedprice * (1 - l_discount) as net, l_quantity + 1 as more }",
    "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS more FROM lineitem"
)
text("wildcard_override", "nation { *, upper n_name as n_name, n_nationkey * 2 as twice }",
    "SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey, n_nationkey * 2 AS twice FROM nation"
)
text("path_navigation", "customer { c_custkey, c_nationkey.n_name as nation, c_nationkey.n_regionkey.r_name as region }",
    "SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT "
    "JOIN region ON n_regionkey = r_regionkey"
)
text("regex_match",
    'part where p_name =~ "^[a-m].*[0-9]$" || not (p_type =~ "A") { p_partkey, p_name }',
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*[0-9]$') OR NOT regexp_matches(p_type, 'A')"
)
text("if_then_else",
    'orders { o_orderkey, if o_totalprice > 150000 then "large" else if o_totalprice > 50000 then "middle" else "small" as '
    'size }',
    "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' "
    "ELSE 'small' END AS size FROM orders"
)
text("text_predicates",
    'customer where isNotEmpty c_name && maxLen 25 c_name && minLen 3 c_name { c_custkey, isTitleCase c_name as title, '
    'allDigits c_name as digits, containsWhitespace c_name as spaced, length c_name as n }',
    "SELECT c_custkey, c_name = concat(upper(left(c_name, 1)), lower(substr(c_name, 2))) AS title, regexp_full_match(c_name, "
    "'[0-9]+') AS digits, regexp_matches(c_name, '\\s') AS spaced, length(c_name)::BIGINT AS n FROM customer "
    "WHERE length(c_name) BETWEEN 3 AND 25"
)
text("domain_predicates", "customer { c_custkey, isRoundedToCents c_acctbal as cents, isValidEmail (c_name <> \"@mail.example.com\") as email }",
    "SELECT c_custkey, round(c_acctbal, 2) = c_acctbal AS cents, regexp_full_match(c_name || '@mail.example.com', "
    "'[^@\\s]+@[^@\\s]+\\.[^@\\s]+') AS email FROM customer"
)
text("boolean_precedence",
    'orders where not $ o_orderstatus == "F" || o_totalprice < 50000 { o_orderkey, o_orderstatus }',
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)"
)
text("subquery_source",
    "(orders where o_totalprice > 250000 { o_orderkey, o_custkey }) { o_custkey }",
    "SELECT o_custkey FROM orders WHERE o_totalprice > 250000")


@code("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def let_binding(ctx):
    large = parse("orders where o_totalprice > 100000")
    return run(Rel(source=large).where('o_orderstatus == "F"').project("o_orderkey", "o_totalprice"), ctx)


@code("SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'")
def trait_function_filter(ctx):
    solvent = lambda rel: rel.where("c_acctbal >= 0")  # noqa: E731  a function of a trait takes the rows it is applied to
    return run(solvent(parse('customer where c_mktsegment == "BUILDING"')).project("c_custkey", "c_name"), ctx)


@code("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000")
def view_scan(ctx):
    from dataclasses import replace

    catalog = CATALOG.with_view("Large", parse("orders where o_totalprice > 300000"))
    return run("Large { o_orderkey, o_custkey }", replace(ctx, catalog=catalog))


# --- joins
text("natural_join", "orders >< customer { o_orderkey, c_name, c_mktsegment }",
    "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"
)
text("join_via",
    "lineitem >< supplier via l_suppkey { l_orderkey, l_linenumber, s_name }",
    "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
)
text("join_multi_hop", "lineitem >< orders >< customer >< nation where n_regionkey == 1 group n_name { n_name, l_orderkey count as n }",
    "SELECT n_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY n_name"
)
text("reverse_join",
    "customer >< orders as placed { c_custkey, placed.o_orderkey as order_key }",
    "SELECT c_custkey, o_orderkey AS order_key FROM customer JOIN orders ON o_custkey = c_custkey"
)
text("guard_outer_join", "documents >< labels | NoLabel as l { documents.doc_id, l.quality as quality, l.tag as variant }",
    "SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'NoLabel' ELSE 'labels' END AS variant FROM documents d LEFT "
    "JOIN labels l ON l.doc_id = d.doc_id"
)
text("filter_before_guard", "documents >< (labels where toxic == 1) | NoLabel as l { documents.doc_id, l.toxic as toxic, l.tag as variant }",
    "SELECT d.doc_id, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'NoLabel' ELSE 'labels' END AS variant FROM documents d LEFT "
    "JOIN (SELECT * FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id"
)
text("absence_guard_variant",
    "documents >< labels | NoLabel as l where l is NoLabel { documents.doc_id, lang }",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
)
text("reverse_guard", "customer >< events | NoEvents as e { c_custkey, e.event_id as event_id, e.tag as variant }",
    "SELECT c_custkey, event_id, CASE WHEN event_id IS NULL THEN 'NoEvents' ELSE 'events' END AS variant FROM customer LEFT "
    "JOIN events ON user_id = c_custkey"
)


@code(
    "SELECT o.o_orderkey, coalesce(a.c_name, b.c_name) AS name, CASE WHEN a.c_custkey IS NOT NULL THEN 'Rich' "
    "WHEN b.c_custkey IS NOT NULL THEN 'Building' ELSE 'Missing' END AS variant FROM orders o LEFT JOIN (SELECT * "
    "FROM customer WHERE c_acctbal > 5000) a ON o.o_custkey = a.c_custkey LEFT JOIN (SELECT * FROM customer "
    "WHERE c_mktsegment = 'BUILDING') b ON o.o_custkey = b.c_custkey"
)
def fallback_chain(ctx):
    return run(
        Rel("orders").join(*_fallback(), "Missing", alias="who").project("o_orderkey", (Path(("who", "c_name")), "name"), (Path(("who", "tag")), "variant")),
        _tables(ctx),
    )


@code(
    "SELECT o.o_orderkey, CASE WHEN c.c_acctbal > 5000 THEN 'Rich' ELSE 'Building' END AS variant FROM orders o "
    "JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000 OR c.c_mktsegment = 'BUILDING'"
)
def fallback_no_terminal(ctx):
    return run(Rel("orders").join(*_fallback(), alias="who").project("o_orderkey", (Path(("who", "tag")), "variant")), _tables(ctx))


def _fallback():
    return "Rich", "Building"


def _tables(ctx):
    """A context with two tables of some of the customers, each referenced by orders."""
    from dataclasses import replace

    from .plans.model import Edge

    customer = ctx.frame("customer")
    base, orders = CATALOG.tables["customer"], CATALOG.tables["orders"]
    catalog = CATALOG.with_table(replace(base, name="Rich")).with_table(replace(base, name="Building"))
    catalog = catalog.with_table(replace(orders, edges=(Edge("o_custkey", "Rich", "c_custkey"), Edge("o_custkey", "Building", "c_custkey"))))
    return replace(ctx, catalog=catalog, frames={"Rich": customer.where("c_acctbal > 5000"), "Building": customer.where("c_mktsegment = 'BUILDING'")})


@code("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def presence_semi(ctx):
    return ctx.frame("customer").join(
        run("orders where o_totalprice > 300000", ctx),
        F.col("o_custkey") == F.col("c_custkey"),
        "left_semi",
    ).select("c_custkey", "c_name")


@code("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def absence_anti(ctx):
    return ctx.frame("orders").join(ctx.frame("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@code("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9500")
def nonkey_equi_join(ctx):
    return run(parse("customer where c_acctbal > 9500").join("supplier", on=(("c_nationkey", "s_nationkey"),)).project("c_custkey", "s_suppkey"), ctx)


@code("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def nonkey_equi_join_all(ctx):
    return run(parse("customer").join("supplier", on=(("c_nationkey", "s_nationkey"),)).project("c_custkey", "s_suppkey"), ctx)


# --- aggregates
text("group_multi",
    "lineitem group l_returnflag group l_linestatus { l_returnflag, l_linestatus, l_quantity sum as qty, l_orderkey count as "
    "n }",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ALL")
text("group_distinct", "orders group o_orderpriority { o_orderpriority }", "SELECT DISTINCT o_orderpriority FROM orders")
text("global_aggregate",
    "orders { o_orderkey count as n, o_totalprice min as least, o_totalprice max as most }",
    "SELECT count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders"
)
text("agg_min_max",
    "part group p_brand { p_brand, p_size min as small, p_size max as large, p_partkey count as n }",
    "SELECT p_brand, min(p_size) AS small, max(p_size) AS large, count(*) AS n FROM part GROUP BY p_brand"
)
text("having_subquery",
    "(orders group o_custkey { o_custkey, o_orderkey count as n }) where n > 15 { o_custkey, n }",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"
)
text("default_order_topk",
    "orders { o_orderkey, o_totalprice } order by o_totalprice desc, o_orderkey limit 25",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"
)
text("order_by_unprojected", "customer { c_name } order by c_acctbal desc, c_custkey limit 10",
    "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"
)


@code(
    "SELECT c_mktsegment, round(sum(o_totalprice::DECIMAL(38,2))::DOUBLE, 2) AS revenue, count(*) AS n FROM orders "
    "JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY c_mktsegment"
)
def group_sum(ctx):
    joined = run("orders >< customer where o_totalprice > 100000 { c_mktsegment, o_totalprice }", ctx)
    return joined.groupBy("c_mktsegment").agg(
        F.round(F.sum(F.col("o_totalprice").cast("decimal(38,2)")).cast("double"), 2).alias("revenue"),
        F.count(F.lit(1)).alias("n"),
    )


@code("SELECT p_brand, round(avg(p_size), 6) AS mean, round(quantile_cont(p_retailprice, 0.9), 6) AS p90 FROM part GROUP BY p_brand")
def percentile_single_step(ctx):
    out = run("part group p_brand { p_brand, p_size avg as mean, p_retailprice percentile 0.9 as p90 }", ctx)
    return out.select("p_brand", F.round("mean", 6).alias("mean"), F.round("p90", 6).alias("p90"))


@code(
    "SELECT o_orderstatus, count(*)::INT AS n_nested, sha256(string_agg(o_orderkey::VARCHAR, ',' "
    "ORDER BY o_orderkey)) AS keys FROM orders GROUP BY o_orderstatus"
)
def group_nested(ctx):
    """Grouping alone gives nested tables; their sizes and the keys of their rows are compared."""
    keys = F.sort_array(F.transform("rows", lambda r: r["o_orderkey"]))
    out = run("orders group o_orderstatus", ctx)
    return out.select("o_orderstatus", F.size("rows").alias("n_nested"), F.sha2(F.array_join(keys, ","), 256).alias("keys"))


@code("SELECT 'high' AS band, o_orderkey FROM orders WHERE o_totalprice > 300000 UNION SELECT 'low' AS band, o_orderkey FROM orders WHERE o_totalprice < 20000")
def union_discriminator(ctx):
    high = parse('orders where o_totalprice > 300000 { "high" as band, o_orderkey }')
    return run(high | parse('orders where o_totalprice < 20000 { "low" as band, o_orderkey }'), ctx)


# --- rollups and retention
_EVENTS = rollup.Template(
    ("event_type",),
    (rollup.Measure("requests", "count"), rollup.Measure("volume", "sum", "v"), rollup.Measure("least", "min", "v"), rollup.Measure("most", "max", "v")),
    "ts",
)
_MEAN = rollup.Template(("event_type",), (rollup.Measure("mean", "avg", "v"),), "ts")
_STEPS = [rollup.Step(None, "3 days"), rollup.Step("hour", "7 days"), rollup.Step("day", None)]
_MOMENT = "2024-01-30 12:00:00"


def _events(ctx):
    return ctx.frame("events").select("ts", "event_type", F.col("value").cast("decimal(18,4)").alias("v"))


def _doubles(df):
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def _level(grain, where="true"):
    return (
        f"SELECT date_trunc('{grain}', ts)::TIMESTAMP AS bucket_start, event_type, count(*) AS requests, "
        f"sum(value::DECIMAL(18,4))::DOUBLE AS volume, min(value::DECIMAL(18,4))::DOUBLE AS least, "
        f"max(value::DECIMAL(18,4))::DOUBLE AS most FROM events WHERE {where} GROUP BY 1, 2"
    )


@code(_level("hour"))
def rollup_hour(ctx):
    return _doubles(_EVENTS.level(_events(ctx), "hour"))


@code(_level("day"))
def rollup_chain_day_from_hour(ctx):
    return _doubles(_EVENTS.coarser(_EVENTS.level(_events(ctx), "hour"), "day"))


@code(_level("month"))
def rollup_month_from_day(ctx):
    day = _EVENTS.coarser(_EVENTS.level(_events(ctx), "hour"), "day")
    return _doubles(_EVENTS.coarser(day, "month"))


@code(
    "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket_start, event_type, round(sum(value::DECIMAL(18,4))::DOUBLE / "
    "count(value), 6) AS mean FROM events GROUP BY 1, 2"
)
def rollup_avg_as_sum_count(ctx):
    read = _MEAN.read(_MEAN.coarser(_MEAN.level(_events(ctx), "hour"), "day"))
    return read.select("bucket_start", "event_type", F.round(F.col("mean").cast("double"), 6).alias("mean"))


_RAW_CUT, _HOUR_CUT = "TIMESTAMP '2024-01-27 12:00:00'", "TIMESTAMP '2024-01-23 00:00:00'"


@code(
    f"SELECT *, 'hour' AS grain FROM ({_level('hour', f'ts < {_RAW_CUT} AND ts >= {_HOUR_CUT}')}) UNION ALL "
    f"SELECT *, 'day' AS grain FROM ({_level('day', f'ts < {_HOUR_CUT}')})"
)
def rollup_union_view(ctx):
    return _doubles(rollup.union_view(rollup.run_chain(_events(ctx), _EVENTS, _STEPS, _MOMENT)))


@code(f"SELECT *, 'hour' AS grain FROM ({_level('hour', f'ts < {_RAW_CUT} AND ts >= {_HOUR_CUT}')})")
def rollup_grain_select(ctx):
    return _doubles(rollup.union_view(rollup.run_chain(_events(ctx), _EVENTS, _STEPS, _MOMENT)).where("grain = 'hour'"))


@code(f"SELECT ts, event_type, value::DECIMAL(18,4)::DOUBLE AS v FROM events WHERE ts >= {_RAW_CUT}")
def retain_prune(ctx):
    return _doubles(rollup.run_chain(_events(ctx), _EVENTS, _STEPS, _MOMENT)["raw"])


@code("SELECT CASE WHEN value >= 80 THEN 'high' WHEN event_type = 'click' THEN 'click' ELSE 'rest' END AS branch, count(*) AS n FROM events GROUP BY 1")
def retain_branches(ctx):
    parts = rollup.branches(ctx.frame("events"), [F.col("value") >= 80, F.col("event_type") == "click"])
    out = None
    for name, p in zip(("high", "click", "rest"), parts, strict=True):
        one = p.select(F.lit(name).alias("branch"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@code(
    "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket_start, o_orderstatus, count(*) AS n, "
    "sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1, 2"
)
def retain_using(ctx):
    t = rollup.Template(("o_orderstatus",), (rollup.Measure("n", "count"), rollup.Measure("total", "sum", "v")), "o_orderdate")
    orders = ctx.frame("orders").withColumn("v", F.col("o_totalprice").cast("decimal(18,2)"))
    return _doubles(t.coarser(t.level(orders, "day"), "month"))


@code(

        "WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS "
        "bucket_start), l AS (SELECT date_trunc('day', ts)::TIMESTAMP AS b, count(*) AS n FROM events "
        "WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1) SELECT bucket_start::TIMESTAMP AS bucket_start, CASE "
        "WHEN bucket_start >= TIMESTAMP '2024-01-10' THEN coalesce(n, 0) END::BIGINT AS n, CASE "
        "WHEN bucket_start < TIMESTAMP '2024-01-10' THEN 'NotRetained' ELSE 'Value' END AS tag FROM s LEFT "
        "JOIN l ON b = bucket_start"
    
)
def rollup_not_retained_gap(ctx):
    t = rollup.Template((), (rollup.Measure("n", "count"),), "ts")
    level = t.level(ctx.frame("events").where("ts >= timestamp_ntz'2024-01-10'"), "day")
    return rollup.with_gaps(level, "day", "2024-01-01 00:00:00", "2024-02-05 00:00:00", "2024-01-10 00:00:00", ["n"])


# --- time and versions: a log derived from orders (insert; every third row updated; every fifth deleted; every tenth back)
_LOG_SQL = """log AS (
 SELECT o_orderkey AS id, 1 AS tx_seq, 'I' AS op, o_orderdate AS valid_from, o_orderstatus AS status FROM orders
 UNION ALL SELECT o_orderkey, 2, 'U', o_orderdate + INTERVAL 10 DAY, 'X' FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT o_orderkey, 3, 'D', o_orderdate + INTERVAL 20 DAY, NULL FROM orders WHERE o_orderkey % 5 = 0
 UNION ALL SELECT o_orderkey, 4, 'U', o_orderdate + INTERVAL 30 DAY, 'R' FROM orders WHERE o_orderkey % 10 = 0)"""


def _log(ctx):
    o = ctx.frame("orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", F.col("o_orderstatus").alias("s"))
    steps = [("I", 0, F.col("s"), 1), ("U", 10, F.lit("X"), 3), ("D", 20, F.lit(None).cast("string"), 5), ("U", 30, F.lit("R"), 10)]
    each = F.array(*[F.when(
        F.col("id") % m == 0,
        F.struct(
            F.lit(i + 1).cast("long").alias("tx_seq"),
            F.lit(op).alias("op"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(d))).alias("valid_from"),
            v.alias("status"),
        ),
    ) for i, (op, d, v, m) in enumerate(steps)])
    return o.select("id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("v")).select("id", "v.*")


_NEWEST = "SELECT id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tx_seq DESC) AS r FROM log {where}) WHERE r = 1 AND op <> 'D'"


@code(f"WITH {_LOG_SQL} {_NEWEST.format(where='')}")
def latest_version(ctx):
    return versions.current(_log(ctx)).select("id", "status")


@code(f"WITH {_LOG_SQL} {_NEWEST.format(where=chr(32) + 'WHERE valid_from <= TIMESTAMP ' + chr(39) + '1998-06-15' + chr(39))}")
def asof_moment(ctx):
    return versions.current(_log(ctx), moment="1998-06-15").select("id", "status")


@code(
    f"WITH {_LOG_SQL} SELECT count(*) FILTER (op = 'D') AS deleted, count(*) FILTER (op = 'R') AS revived FROM (SELECT id, "
    f"CASE WHEN max(tx_seq) = 3 THEN 'D' WHEN max(tx_seq) = 4 AND count(*) FILTER (op = 'D') > 0 THEN 'R' ELSE '-' END AS op "
    f"FROM log GROUP BY id)"
)
def tombstone_revive(ctx):
    log = _log(ctx)
    alive = versions.current(log).select("id", F.lit(1).alias("alive"))
    seen = log.groupBy("id").agg(F.max((F.col("op") == "D").cast("int")).alias("d")).join(alive, "id", "left")
    return seen.agg(
        F.count_if((F.col("d") == 1) & F.col("alive").isNull()).alias("deleted"),
        F.count_if((F.col("d") == 1) & F.col("alive").isNotNull()).alias("revived"),
    )


@code(
    f"WITH {_LOG_SQL}, l AS (SELECT *, lag(status) OVER w AS before, row_number() OVER w AS r "
    f"FROM log WINDOW w AS (PARTITION BY id ORDER BY tx_seq)) SELECT id, min(valid_from) FILTER (status IS NOT NULL) AS "
    f"created_at, max(valid_from) FILTER (r = 1 OR status IS DISTINCT FROM before) AS updated_at FROM l WHERE op <> 'D' "
    f"GROUP BY id"
)
def field_updated_at(ctx):
    return versions.field_times(_log(ctx), "status")


@code(
    f"WITH {_LOG_SQL}, l AS (SELECT *, coalesce(status = 'X', false) AS c, lag(coalesce(status = 'X', false)) OVER (PARTITION "
    f"BY id ORDER BY tx_seq) AS was FROM log) SELECT id, tx_seq::BIGINT AS tx_seq, 'Pending' AS status FROM l WHERE c "
    f"AND NOT coalesce(was, false)"
)
def event_transition(ctx):
    return events.emit(_log(ctx), F.col("status") == "X", []).select("id", "tx_seq", "status")


@code(f"WITH {_LOG_SQL} SELECT id, max(tx_seq)::BIGINT AS tx_seq FROM log GROUP BY id")
def idempotent_replay(ctx):
    log = _log(ctx)
    return versions.replayed(log.unionByName(log)).groupBy("id").agg(F.max("tx_seq").alias("tx_seq"))


@code("SELECT o_orderkey, round(o_totalprice * (1 + 0.05 * date_diff('day', o_orderdate, TIMESTAMP '2001-09-01') / 365), 4) AS due FROM orders")
def behavior_accrual_at(ctx):
    days = F.timestamp_diff("DAY", "o_orderdate", F.expr("timestamp_ntz'2001-09-01'"))
    return ctx.frame("orders").select("o_orderkey", F.round(F.col("o_totalprice") * (1 + 0.05 * days / 365), 4).alias("due"))


@code(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey "
    "ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS ordinal FROM lineitem"
)
def component_ordinal(ctx):
    out = versions.ordinals(ctx.frame("lineitem"), "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "ordinal")


# --- integrity and access
_RULES = lambda: [integrity.Rule("amount", F.col("c_acctbal") >= 0, "c_acctbal"), integrity.Rule("segment", F.col("c_mktsegment") != "MACHINERY", "c_mktsegment"), integrity.Rule("name", F.length("c_name") <= 18, "c_name", secret=True)]
_VIOLATIONS = (
    "SELECT 'customer' AS subject_table, c_custkey::VARCHAR AS subject, 'amount' AS functor, 'Observed' AS origin, "
    "c_acctbal::VARCHAR AS observed, 'Open' AS state FROM customer WHERE c_acctbal < 0 UNION ALL "
    "SELECT 'customer', c_custkey::VARCHAR, 'segment', 'Observed', c_mktsegment, 'Open' FROM customer "
    "WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'name', 'Observed', 'Redacted', 'Open' "
    "FROM customer WHERE length(c_name) > 18"
)


@code(_VIOLATIONS)
def validation_violations(ctx):
    return integrity.violations(ctx.frame("customer"), "customer", "c_custkey", _RULES())


@code(f"SELECT functor, count(*) AS affected FROM ({_VIOLATIONS}) GROUP BY functor")
def violations_report(ctx):
    return integrity.report(integrity.violations(ctx.frame("customer"), "customer", "c_custkey", _RULES()))


@code(
    "SELECT 'orders' AS subject_table, o_orderkey::VARCHAR AS subject, 'orders.o_custkey' AS functor, 'Observed' AS origin, "
    "o_custkey::VARCHAR AS observed, 'Open' AS state FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer "
    "WHERE c_acctbal >= 0)"
)
def fk_orphans(ctx):
    return integrity.orphans(ctx.frame("orders"), "orders", "o_orderkey", "o_custkey", ctx.frame("customer").where("c_acctbal >= 0"), "c_custkey")


@code("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(ctx):
    return integrity.duplicates(ctx.frame("lineitem"), "l_orderkey", "l_linenumber")


@code(
    "SELECT l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey AND l_quantity > 48"
)
def assert_equality(ctx):
    rows = run("lineitem where l_quantity > 48 { l_orderkey, l_partkey, l_orderkey.o_custkey.c_nationkey as a, l_suppkey.s_nationkey as b }", ctx)
    return integrity.paths_equal(rows, F.col("a"), F.col("b")).select("l_orderkey", "l_partkey")


@code(
    "SELECT l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey"
)
def assert_equality_all(ctx):
    rows = run("lineitem { l_orderkey, l_partkey, l_orderkey.o_custkey.c_nationkey as a, l_suppkey.s_nationkey as b }", ctx)
    return integrity.paths_equal(rows, F.col("a"), F.col("b")).select("l_orderkey", "l_partkey")


@code("SELECT CASE WHEN c_acctbal >= 0 THEN 'accepted' ELSE 'refused' END AS side, count(*) AS n FROM customer GROUP BY 1")
def mode_split(ctx):
    ok, bad = integrity.split(ctx.frame("customer"), F.col("c_acctbal") >= 0, "enforce always")
    return ok.select(F.lit("accepted").alias("side")).unionByName(bad.select(F.lit("refused").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@code("SELECT count(*) FILTER (c_acctbal < 1000) AS failing, count(*) AS total FROM customer")
def blast_radius(ctx):
    return integrity.blast_radius(ctx.frame("customer"), F.col("c_acctbal") >= 1000)


@code(
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'amount' WHEN c_mktsegment = 'MACHINERY' THEN 'segment' "
    "WHEN length(c_name) > 18 THEN 'name' END AS failed FROM customer"
)
def first_failing_address(ctx):
    return ctx.frame("customer").select("c_custkey", integrity.first_failing(_RULES()).alias("failed"))


@code(
    "SELECT CASE WHEN ok THEN c_custkey END AS c_custkey, CASE WHEN ok THEN c_name END AS c_name, CASE "
    "WHEN ok THEN c_nationkey END AS c_nationkey, CASE WHEN ok THEN 'Granted' ELSE 'Redacted' END AS access "
    "FROM (SELECT *, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AS ok FROM customer)"
)
def access_redaction(ctx):
    mine = ctx.frame("nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return integrity.redact(ctx.frame("customer").select("c_custkey", "c_name", "c_nationkey"), mine, ["c_nationkey"])


@code("SELECT c_custkey, c_name, 'Granted' AS access FROM customer")
def bypass_access(ctx):
    return integrity.redact(ctx.frame("customer").select("c_custkey", "c_name"), ctx.frame("customer").limit(0), ["c_custkey"], bypass=True)


# --- documents
@code(
    "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE "
    "WHEN json_extract(props, '$.nothing') IS NULL THEN 'NotFound' ELSE 'Value' END AS missing FROM events"
)
def doc_path(ctx):
    return ctx.frame("events").select(
        "event_id",
        documents.value_at(F.col("props"), "k", "string").alias("k"),
        documents.tag_at(F.col("props"), "nothing").alias("missing"),
    )


@code(
    "SELECT event_id, fullkey AS path, CASE WHEN type IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' "
    "WHEN type = 'VARCHAR' THEN 'STRING' ELSE type END AS kind, CASE "
    "WHEN type NOT IN ('OBJECT', 'ARRAY') THEN atom ->> '$' END AS value FROM events, json_tree(props)"
)
def doc_shred(ctx):
    return documents.shred(ctx.frame("events"), "event_id", "props")


# --- connectors, queues, evolution
@code(
    "SELECT o_orderkey, floor(least(1000 * power(2, o_orderkey % 9), 60000) * (1000 + ('0x' || "
    "substr(md5(o_orderkey::VARCHAR), 1, 6))::BIGINT % 401 - 200) / 1000)::BIGINT AS wait FROM orders"
)
def queue_backoff(ctx):
    return ctx.frame("orders").select("o_orderkey", events.backoff(F.col("o_orderkey") % 9, 1000, 60000, F.col("o_orderkey")).alias("wait"))


@code("SELECT p_type, count(*) AS n FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_partkey <= 3) GROUP BY p_type")
def unknown_codes(ctx):
    known = ctx.frame("part").where("p_partkey <= 3").select("p_type").distinct().withColumnRenamed("p_type", "code")
    return evolution.unknown_codes(ctx.frame("part"), "p_type", known, "code")


@code(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing there' ELSE 'differs' END AS difference FROM orders "
    "WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0"
)
def state_verification_diff(ctx):
    ours = ctx.frame("orders").select("o_orderkey", "o_orderstatus")
    theirs = ours.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.lit("?")).otherwise(F.col("o_orderstatus")))
    return connectors.verify_state(ours, theirs, "o_orderkey", ["o_orderstatus"])


@code(
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"
)
def conflict_lww(ctx):
    return connectors.last_writer(
        ctx.frame("events").select("user_id", "event_id", "event_type", "ts"),
        "user_id",
        "ts",
        "event_id",
    ).select("user_id", "event_id", "event_type")


@code("SELECT c_custkey, c_name, c_acctbal FROM customer")
def merge_tables(ctx):
    parts = evolution.split_table(ctx.frame("customer"), "c_custkey", names=["c_name"], money=["c_acctbal"])
    return evolution.merge_tables("c_custkey", parts["names"], parts["money"])


@code("SELECT c_custkey, c_name FROM customer")
def split_table(ctx):
    return evolution.split_table(ctx.frame("customer"), "c_custkey", names=["c_name"])["names"]


@code("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'O' ELSE o_orderstatus END AS status FROM orders")
def shrink_variant(ctx):
    return ctx.frame("orders").select("o_orderkey", evolution.shrink_variant(F.col("o_orderstatus"), {"P": "O"}).alias("status"))


@code("SELECT max(n) AS most FROM (SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY o_orderkey)")
def view_key_check(ctx):
    from .plans.keys import derive

    rel = parse("customer >< orders as o")
    key = derive(rel, CATALOG)
    return run(rel, ctx).groupBy(*key.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))


