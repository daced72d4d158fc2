import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from larkspur import catalog_queries as cq
from larkspur.operators import rollup, versions
from larkspur.plans.expr import Bin, Not
from larkspur.plans.keys import derive, describe, refresh_mode
from larkspur.plans.lower import run
from larkspur.plans.model import CheckError, Context, TableDef
from larkspur.plans.parser import parse, parse_expr
from larkspur.sources import connectors

SF = "/root/testdata/sf0.001"


@pytest.fixture
def ctx(spark):
    return Context(spark, SF, cq.CATALOG)


def test_precedence():
    assert parse_expr("not a || b") == Bin("||", Not(parse_expr("a")), parse_expr("b"))
    assert parse_expr("not $ a || b") == Not(parse_expr("a || b"))
    assert parse_expr("1 + 2 * 3") == Bin("+", parse_expr("1"), parse_expr("2 * 3"))


@pytest.mark.parametrize(
    "text, message",
    [
        ("documents >< labels | NoLabel as l where l.toxic == 1", "filter before the guard"),
        ("lineitem >< region", "no reference"),
        ("orders { o_totalprice * 2 }", "needs a name"),
        ("orders where now > 1", "unknown field"),
        ("orders where o_orderkey is Gone", "one variant only"),
        ("orders { now 1 as t }", "clock"),
        ("orders { nothing 1 as t }", "unknown function"),
        ("nowhere", "unknown table"),
        ("orders { o_orderkey", "expected|found"),
        ("customer >< events | NoEvents { c_custkey }", "needs `as`"),
    ],
)
def test_checker(ctx, text, message):
    with pytest.raises(CheckError, match=message):
        run(text, ctx)


def test_keyless_needs_trait():
    with pytest.raises(CheckError, match="candidate key"):
        TableDef("t", ("a",))


def test_keys():
    key = lambda text: derive(parse(text), cq.CATALOG)
    assert key("orders where o_totalprice > 1 { o_orderkey, o_totalprice }").meaningful
    assert not key("orders { o_totalprice }").meaningful
    assert key("customer >< orders as o").columns == ("o_orderkey",)
    assert key("orders >< customer").columns == ("o_orderkey",)
    assert key("orders group o_custkey { o_custkey, o_orderkey count as n }").columns == ("o_custkey",)
    assert key("orders { o_orderkey count as n }").columns == ()
    assert not key("lineitem").meaningful
    assert "degenerate" in describe(parse("lineitem { l_quantity }"), cq.CATALOG)
    assert refresh_mode(parse("orders"), cq.CATALOG) == "incremental"


def test_two_valued_logic(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, x int")
    got = run('t where not (x > 3) { id }', Context(spark, SF, cq.CATALOG, frames={"t": df}))
    assert [r.id for r in got.collect()] == [1]


def test_navigation_shares_joins(ctx):
    plan = run("customer { c_custkey, c_nationkey.n_name as a, c_nationkey.n_regionkey as b }", ctx)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_guard_keeps_left_rows(ctx):
    got = run("documents >< (labels where toxic == 1) | NoLabel as l { documents.doc_id, l.tag as v }", ctx)
    assert got.count() == ctx.frame("documents").count()


def test_chain_checks():
    t = rollup.Template((), (rollup.Measure("p", "percentile", "v"),), "ts")
    step = rollup.Step
    with pytest.raises(CheckError, match="percentile"):
        rollup.check_chain(t, [step(None, "2 days"), step("hour", "3 days"), step("day", None)])
    rollup.check_chain(t, [step(None, "2 days"), step("hour", None)])
    with pytest.raises(CheckError, match="coarser"):
        rollup.check_chain(cq._EVENTS, [step(None, "2 days"), step("day", "30 days"), step("hour", None)])
    with pytest.raises(CheckError, match="ends"):
        rollup.check_chain(cq._EVENTS, [step(None, "2 days"), step("hour", "3 days")])
    with pytest.raises(CheckError, match="cover"):
        rollup.check_chain(cq._EVENTS, [step(None, "1 hour"), step("day", None)])


def test_chain_counts_each_row_once(ctx):
    raw = cq._events(ctx)
    levels = rollup.run_chain(raw, cq._EVENTS, cq._STEPS, cq._MOMENT)
    total = levels["raw"].count() + rollup.union_view(levels).agg(F.sum("requests")).first()[0]
    assert total == raw.count()


def test_replay_and_upsert(spark, ctx):
    log = cq._log(ctx)
    assert versions.replayed(log.unionByName(log)).count() == log.count()
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z")], "k int, v string")
    once = versions.upsert(a, b, "k")
    assert sorted(versions.upsert(once, b, "k").collect()) == sorted(once.collect()) == [(1, "x"), (2, "z")]


def test_formats(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    assert connectors.render(df, "json") == ['{"k":1,"v":null}', '{"k":2,"v":"b"}']
    assert connectors.render(df, "raw") == ["1\t", "2\tb"]
    assert connectors.render(df, "csv")[0] == "k,v"


def test_stream_rollup(spark, tmp_path):
    from larkspur.streaming.events import stream_rollup

    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("v"))
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    t = rollup.Template(("event_type",), (rollup.Measure("n", "count"),), "ts")
    q = stream_rollup(source, t, "day", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    got = {(r.bucket_start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.bucket_start, r.event_type): r.n for r in t.level(events, "day").collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_queue(spark):
    from larkspur.streaming.events import due, settle

    rows = [(1, "a", "Pending", "2024-01-01 00:00:00", 0), (2, "a", "Pending", "2024-01-01 00:00:01", 2), (3, "a", "InFlight", "2024-01-01 00:00:00", 0), (4, "b", "Pending", "2024-01-02 00:00:00", 0), (5, "b", "Pending", "2024-01-01 00:00:00", 0), (6, "c", "Done", "2024-01-01 00:00:00", 0)]
    queue = spark.createDataFrame([(*r, None) for r in rows], "id long, destination string, status string, scheduled_at string, attempt_count int, last_error string").withColumn("scheduled_at", F.col("scheduled_at").cast("timestamp_ntz"))
    now = "2024-01-01 12:00:00"
    assert sorted(r.id for r in due(queue, now, 2).collect()) == [1, 5]
    flying = due(queue, now, 3)
    assert {r.status for r in flying.collect()} == {"InFlight"} and flying.count() == 3
    got = {r.id: r for r in settle(flying, spark.createDataFrame([(1, "slow"), (2, "down"), (5, None)], "id long, error string"), now, 3, 1000, 60000).collect()}
    assert [got[i].status for i in (1, 2, 5)] == ["Pending", "Failed", "Done"]
    assert [got[i].attempt_count for i in (1, 2, 5)] == [1, 3, 0] and got[2].last_error == "down"
    wait = (got[1].scheduled_at - datetime.datetime(2024, 1, 1, 12)).total_seconds()
    assert 0.8 <= wait <= 1.2
    assert settle(flying, spark.createDataFrame([], "id long, error string"), now, 3, 1000, 60000).where("status = 'InFlight'").count() == 3


def test_shred_reaches_every_level(spark):
    from larkspur.operators import documents

    deep, path = "7", ""
    for i in range(11):
        deep, path = (f'{{"a": {deep}}}', ".a" + path) if i % 2 else (f"[{deep}]", "[0]" + path)
    nodes = documents.shred(spark.createDataFrame([(1, deep), (2, '{"b": "x"}'), (3, None)], "id long, body string"), "id", "body").collect()
    assert sorted(n.id for n in nodes) == [1] * 12 + [2] * 2
    assert {(n.path, n.value) for n in nodes if n.value is not None} == {("$" + path, "7"), ("$.b", "x")}


def test_whole_tables_are_audited_and_joined(spark, ctx):
    n = {r.c_nationkey: r.n for r in ctx.frame("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).collect()}
    m = {r.s_nationkey: r.n for r in ctx.frame("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert cq.QUERIES["nonkey_equi_join_all"](spark, SF).count() == sum(k * m.get(x, 0) for x, k in n.items())
    cust = {r.c_custkey: r.c_nationkey for r in ctx.frame("customer").collect()}
    order = {r.o_orderkey: cust[r.o_custkey] for r in ctx.frame("orders").collect()}
    supp = {r.s_suppkey: r.s_nationkey for r in ctx.frame("supplier").collect()}
    want = sum(order[r.l_orderkey] != supp[r.l_suppkey] for r in ctx.frame("lineitem").collect())
    assert cq.QUERIES["assert_equality_all"](spark, SF).count() == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(cq.QUERIES) == set(cq.ORACLES)
