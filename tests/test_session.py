import pytest
from pyspark.sql import functions as F

from larkspur.operators import access, txlog, writes
from larkspur.plans import graph
from larkspur.plans.expr import Bin, Ctor, Lit, Match, Path, lower
from larkspur.plans.lower import fetch, run
from larkspur.plans.model import Catalog, CheckError, Context, TableDef
from larkspur.plans.session import Session
from larkspur.plans.statements import parse_one

SHOP = """
type Amount : Decimal where >= 0
type Email : Text where isValidEmail
type Status = Pending | Shipped | Closed
table Customer {
  email : Email
    where
      minLen 6
      maxLen 40
    , name : Text, tier : Text = "Bronze", unique ref { email }, order by name desc
}
table Queue : LogData { recipient : Text, order_num : Int }
table Order {
  order_num : Int unique, customer :> Customer, total : Amount, status : Status = Pending,
  opened : Timestamp = moment "2026-01-01 00:00:00",
  due : Behavior Amount = \\t -> total * (1 + days (t - opened) / 100),
  on status == "Shipped" emit Queue { recipient = customer, order_num = order_num }
}
view Open = Order >< Customer where status == "Pending" { order_num, customer, total, name }
large self = self where total > 50
twice x = x * 2
"""


@pytest.fixture
def shop(spark):
    s = Session(Context(spark, "/nowhere", Catalog()), "2026-01-01 00:00:00")
    s.execute(SHOP)
    s.execute(""":commit""")
    s.execute("""
      Customer { email = "ann@site.org", name = "Ann" }
      Customer { email = "bob@site.org", name = "Bob", tier = "Gold" }
      Order { order_num = 1, customer = "ann@site.org", total = 40 }
      Order { order_num = 2, customer = "bob@site.org", total = 90 }
    """)
    return s


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rows_are_written_and_read_back(shop):
    assert rows(shop.execute("Customer { name, tier }")) == [("Bob", "Gold"), ("Ann", "Bronze")]  # in declared order
    assert rows(shop.execute("Order { order_num, total }")) == [(1, 40.0), (2, 90.0)]  # by its key
    shop.execute('Order where order_num == 1 { status = "Shipped", total = total + 1 }', "2026-01-02 00:00:00")
    assert rows(shop.execute("Order { order_num, total, status }")) == [(1, 41.0, "Shipped"), (2, 90.0, "Pending")]
    assert rows(shop.ctx.frames["Queue"].where("order_num is not null")) == [("ann@site.org", 1)]
    shop.execute("delete Order where order_num == 2", "2026-01-03 00:00:00")
    assert rows(shop.execute("Order { order_num }")) == [(1,)]
    assert rows(shop.execute('Order at "2026-01-02T12:00:00Z" { order_num, total }')) == [(1, 41.0), (2, 90.0)]
    shop.execute('Order { order_num = 2, customer = "ann@site.org", total = 5 }', "2026-01-04 00:00:00")
    assert rows(shop.execute("Order { order_num, total }")) == [(1, 41.0), (2, 5.0)]
    assert rows(shop.execute("show transactions since seq 5 limit 2").select("tx_seq", "op")) == [(7, "I"), (6, "D")]
    assert shop.execute("show transaction 5").count() == 1


def test_refused_writes(shop):
    for text, why in [
        ('Customer { email = "nobody", name = "X" }', "isValidEmail"),
        ('Customer { email = "a@b.c", name = "X" }', "minLen6"),
        ('Customer { email = "ann@site.org", name = "X" }', "key exists"),
        ('Customer { email = "new@site.org" }', "no value and no default"),
        ('Customer { email = "new@site.org", name = "X", size = 3 }', "no stored field"),
        ('Order { order_num = 3, customer = "eve@site.org", total = 1 }', "no Customer has that key"),
        ('Order { order_num = 3, customer = "ann@site.org", total = 0 - 1 }', ">= 0"),
        ("Order where order_num == 1 { due = 3 }", "no stored field"),
    ]:
        with pytest.raises(CheckError, match=why):
            shop.execute(text)
    assert shop.execute("Customer").count() == 2


def test_modes(shop):
    shop.execute("enforce Customer.email / maxLen40 forward")
    shop.execute("monitor Order.total")
    shop.execute('Order { order_num = 3, customer = "ann@site.org", total = 0 - 1 }')
    assert [(r.subject, r.functor, r.observed) for r in shop.execute("show violations for Order.total").collect()] == [("3", "Order.total / >= 0", "-1.0")]
    shop.execute("repair Order.total into Fixes")
    shop.execute('Order { order_num = 4, customer = "ann@site.org", total = 0 - 2 }')
    assert [r.order_num for r in shop.ctx.frames["Fixes"].collect()] == [4]


def test_functions_views_and_behaviors(shop):
    assert rows(shop.execute("large (Order) { order_num }")) == [(2,)]
    assert rows(shop.execute("large Order { order_num, twice total as t, (\\a -> a + 1) total as u, let k = 3 in k * total as v }")) == [(2, 180.0, 91.0, 270.0)]
    assert sorted(rows(shop.execute("Open { order_num, name }"))) == [(1, "Ann"), (2, "Bob")]
    assert rows(shop.execute('Order at "2026-01-11T00:00:00Z" { order_num, due }')) == [(1, pytest.approx(44.0)), (2, pytest.approx(99.0))]
    with pytest.raises(CheckError, match="behavior"):
        shop.execute("Order order by due { order_num }")
    shop.execute("let rich = Customer where tier == \"Gold\"")
    assert rows(shop.execute("rich { name }")) == [("Bob",)]
    with pytest.raises(CheckError, match="itself"):
        shop.execute("loop x = loop x\nOrder { loop total as y }")


def test_presence_and_absence(shop):
    shop.execute('Customer { email = "cyd@site.org", name = "Cyd" }')
    assert rows(shop.execute("Customer where self >< Order where total > 50 { name }")) == [("Bob",)]
    assert rows(shop.execute("Customer where not $ self >< Order { name }")) == [("Cyd",)]
    assert sorted(rows(shop.execute('Customer where tier == "Bronze" && (name == "Cyd" || (self >< Order where total < 50)) { name }'))) == [("Ann",), ("Cyd",)]
    with pytest.raises(CheckError, match="no reference"):
        shop.execute("Customer where self >< Queue { name }").count()


def test_write_through(shop):
    shop.execute('Open { order_num = 7, customer = "dan@site.org", total = 3, name = "Dan" }')
    assert ("Dan", "Bronze") in rows(shop.execute("Customer { name, tier }"))
    assert rows(shop.execute("Order where order_num == 7 { customer, status }")) == [("dan@site.org", "Pending")]
    assert "writable: yes" in shop.execute(":describe Open")
    shop.execute("view Names = Order >< Customer { name }")
    assert "degenerate" in shop.execute(":describe Names")
    with pytest.raises(CheckError, match="read-only"):
        shop.execute('Names { name = "X" }')
    with pytest.raises(CheckError, match="degenerate key"):
        shop.execute("deprecate Order")


def test_materialized_views(shop, tmp_path):
    shop.execute("view Totals = Order group customer { customer, total sum as total, order_num count as n }")
    assert shop.execute("refresh view Totals") == "full"
    shop.execute('Order where order_num == 2 { customer = "ann@site.org" }', "2026-01-05 00:00:00")
    assert sorted(rows(shop.materialized["Totals"][2])) == [("ann@site.org", 40.0, 1), ("bob@site.org", 90.0, 1)]
    assert shop.execute("refresh view Totals") == "incremental"
    assert rows(shop.materialized["Totals"][2]) == [("ann@site.org", 130.0, 2)]
    assert shop.execute("show materialized views").count() == 1
    shop.execute("drop materialized view Totals")
    assert shop.execute("show materialized views").count() == 0


def test_history_of_the_schema(shop):
    old = shop.execute(":commit")[0]
    shop.execute(':tag "v1"')
    got = shop.execute("table Customer { email : Email unique, full : Text rename from name, phone : Text | NotGiven }")
    assert (got.added, got.omitted, got.renamed) == (("phone",), ("tier",), (("full", "name"),))
    shop.execute(":commit")
    assert sorted(rows(shop.execute("Customer { full }"))) == [("Ann",), ("Bob",)]
    assert sorted(rows(shop.execute('Customer at "v1" { name, tier }'))) == [("Ann", "Bronze"), ("Bob", "Gold")]
    assert sorted(rows(shop.execute(f'Customer at "{old[:10]}" {{ name }}'))) == [("Ann",), ("Bob",)]
    with pytest.raises(CheckError, match="no version"):
        shop.execute('Customer at "v9" { name }')
    assert len(shop.execute(":history Customer")) >= 2
    shop.execute("table Extra { a : Int unique }")
    shop.execute(":rollback")
    assert "Extra" not in shop.ctx.catalog.tables


def test_branches_merge():
    a, b, c = (TableDef(n, ("k", n), ("k",)) for n in "abc")
    g = graph.Graph().commit(Catalog().with_table(a)).branch("side")
    g = g.commit(g.commits[g.branches["side"]].catalog.with_table(b), "side")
    g = g.commit(g.commits[g.branches["main"]].catalog.with_table(c))
    g = g.merge("side")
    top = g.commits[g.branches["main"]]
    assert set(top.catalog.tables) == {"a", "b", "c"} and len(top.parents) == 2
    other = g.branch("x")
    other = other.commit(top.catalog.with_table(TableDef("a", ("k", "y"), ("k",))), "x")
    other = other.commit(top.catalog.with_table(TableDef("a", ("k", "z"), ("k",))))
    with pytest.raises(CheckError, match="both branches"):
        other.merge("x")
    with pytest.raises(CheckError, match="never move"):
        g.tag("t").tag("t")


def test_evolution(shop):
    assert shop.execute("extend Status with Archived") == 3
    with pytest.raises(CheckError, match="never used again"):
        shop.execute("extend Status with Pending")
    shop.execute("shrink Order.status removing Pending migrate (\\_ -> Closed)", "2026-01-06 00:00:00")
    assert set(rows(shop.execute("Order { status }"))) == {("Closed",)}
    shop.execute("split Customer into { Person { name : Text }, Level { tier : Text } }")
    shop.execute("merge Person, Level into Whole { name : Text, tier : Text }")
    assert sorted(rows(shop.execute("Whole"))) == [("ann@site.org", "Ann", "Bronze"), ("bob@site.org", "Bob", "Gold")]
    with pytest.raises(CheckError, match="in use"):
        shop.execute("prune Customer")
    with pytest.raises(CheckError, match="retain"):
        shop.execute("prune Queue")
    shop.execute("set visibility Order featured")
    assert "(featured)" in shop.execute(":describe Order")
    with pytest.raises(CheckError, match="visibility"):
        shop.execute("set visibility Order loud")


def test_grants(shop):
    g = access.Grants().grant("ann", "app.pm").grant("adm", "app", True)
    assert g.can_read("ann", "app.pm.Doc") and not g.can_read("ann", "app.hr.Pay") and not g.can_read("ann", "app")
    assert g.bypasses("adm", "app.hr.Pay") and not g.bypasses("ann", "app.pm.Doc")
    shop.role = "clerk"
    with pytest.raises(CheckError, match="no grant"):
        shop.execute("Order { order_num }")
    shop.execute("grant clerk on Order")
    assert shop.execute("Order { order_num }").count() == 2
    assert rows(shop.execute("show grants for Order")) == [("clerk", "Order", False)]
    shop.execute("revoke grant clerk on Order")
    with pytest.raises(CheckError, match="no grant"):
        shop.execute("Order { order_num }")


def test_access_asserts_redact(spark):
    s = Session(Context(spark, "/nowhere", Catalog()), "2026-01-01 00:00:00")
    s.execute("""
      table User { name : Text unique, boss : Bool }
      table Project { code : Text unique, owner : Text }
      table Member { num : Int unique, project :> Project, user :> User }
      table Document { title : Text unique, project :> Project, assert readable { (self >< Project >< Member >< authed_user) || authed_user == title } }
      User { name = "ann", boss = True }  User { name = "bob", boss = False }
      Project { code = "p", owner = "ann" }  Project { code = "q", owner = "bob" }
      Member { num = 1, project = "p", user = "ann" }
      Document { title = "one", project = "p" }  Document { title = "two", project = "q" }  Document { title = "bob", project = "q" }
    """)
    got = lambda q="Document { title, project, access }": sorted(map(str, rows(s.execute(q))))
    s.user = "ann"
    hidden = "(None, None, 'Redacted')"
    assert got() == ["('one', 'p', 'Granted')", hidden, hidden]
    assert got('Document where project == "q" { title }') == []  # a filter learns nothing of hidden rows
    s.user = "bob"
    assert got() == ["('bob', 'q', 'Granted')", hidden, hidden]
    s.role = "admin"
    for name in ("Document", "Project", "Member", "User"):
        s.execute(f"grant admin on {name} bypass access")
    assert got("Document { title }") == ["('bob',)", "('one',)", "('two',)"]


def test_asserts(shop):
    with pytest.raises(CheckError, match="not reached"):
        shop.execute("assert Customer.loose { self >< Queue }")
    with pytest.raises(CheckError, match="never input"):
        shop.execute("assert Customer.pattern { name =~ tier }")
    shop.execute("assert Order.small { total < 1000 }")
    with pytest.raises(CheckError, match="assert"):
        shop.execute('Order { order_num = 9, customer = "ann@site.org", total = 5000 }')
    shop.execute("assert Order.mixed { authed_user == customer && total >= 0 }")
    assert "split it into two asserts" in shop.notes[0]
    shop.execute("assert Order.small { total < 1000 || authed_user == customer }")
    assert any("now an ACCESS constraint" in n for n in shop.notes)
    assert "assert mixed (access)" in shop.execute(":describe Order")


def test_retention_as_text(spark):
    raw = spark.sql("select timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, cast(id div 24 as int), cast(id % 24 as int)) as ts, id % 3 as kind, cast(id as double) as v from range(24 * 60)")
    s = Session(Context(spark, "/nowhere", Catalog().with_table(TableDef("Hits", ("ts", "kind", "v"), None, (), "LogData")), frames={"Hits": raw}), "2026-03-01 00:00:00")
    s.execute("aggregate Daily = Hits group kind { kind, v count as n, v sum as total }")
    s.execute("retain Hits as Daily using ts where kind == 1 for 7 days, by day for 40 days, by month forever otherwise for 7 days, drop")
    one, rest = s.levels_of("Hits")
    assert set(one) == {"raw", "day", "month"} and set(rest) == {"raw"}
    assert sum(df.agg(F.sum("n")).first()[0] or 0 for g, df in one.items() if g != "raw") + one["raw"].count() == 480
    for text, why in [
        ("retain Hits using ts for 7 days, by day forever", "as"),
        ("retain Hits as Daily using ts for 7 days, by day for 1 month", "ends"),
        ("retain Hits as Daily using ts for 7 days, by month forever", "cover"),
        ("retain Hits as Daily using ts for 40 days, by month for 70 days, by day forever", "coarser"),
        ("retain Hits as Daily using ts where v > 3 for 7 days, by day forever otherwise forever", "group fields"),
    ]:
        with pytest.raises(CheckError, match=why):
            s.execute(text)


def test_the_log(spark, tmp_path):
    log = txlog.TxLog(spark, str(tmp_path / "log"), "id long, name string", shard=3)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert log.append(one, "I", "2026-01-01 00:00:00", ["id"]) == 1
    assert log.append(one.where("id = 1"), "D", "2026-01-02 00:00:00", ["id"]) == 2
    with pytest.raises(CheckError, match="in the log"):
        log.append(one, "I", "2026-01-03 00:00:00", ["id"], 2)
    assert rows(log.read(1).select("id", "row_pos", "op")) == [(1, 0, "I"), (2, 1, "I")]
    assert rows(log.transactions(limit=1).select("tx_seq", "mutations")) == [(2, 1)]
    assert log.scan(2).count() == 1
    ids = rows(log.with_ids().orderBy("version_id").select("tx_seq", "row_pos", F.octet_length("version_id")))
    assert ids == [(1, 0, 14), (1, 1, 14), (2, 0, 14)]


def test_subtree(spark):
    parts = spark.createDataFrame([("0001",), ("0001.0001",), ("0001.0002",), ("0001.0002.0001",), ("0001.0010",), ("0002",), ("00010",)], "path string")
    assert rows(txlog.subtree(parts, "path", "0001.0002")) == [("0001.0002",), ("0001.0002.0001",)]
    assert [r[0] for r in rows(txlog.subtree(parts, "path", "0001"))] == ["0001", "0001.0001", "0001.0002", "0001.0002.0001", "0001.0010"]


def test_sum_values(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0)], "k long, v double")
    col = lambda p: F.col(p.name)
    made = df.select(F.when(F.col("k") == 1, lower(Ctor("A", Path(("v",))), col, None)).otherwise(lower(Ctor("B", Path(("v",))), col, None)).alias("s"))
    arms = (("A", Bin("+", Path(("x",)), Lit(1))), ("B", Lit(0.0)))
    assert rows(made.select(lower(Match(Path(("s",)), arms, ("A", "B")), col, None))) == [(6.0,), (0.0,)]
    with pytest.raises(CheckError, match="leaves out B"):
        lower(Match(Path(("s",)), arms[:1], ("A", "B")), col, None)
    with pytest.raises(Exception, match="no arm matches"):
        made.select(lower(Match(Path(("s",)), arms[:1]), col, None)).collect()


def test_secrets(spark):
    users = spark.createDataFrame([("ann", "s1", "pw1"), ("bob", "s2", "pw2")], "name string, salt string, pw string").select("name", writes.salted_digest(F.col("pw"), F.col("salt"), 3).alias("secret"))
    ann = users.where("name = 'ann'")
    assert writes.matches(ann, "secret", "pw1", 3) and not writes.matches(ann, "secret", "pw2", 3)
    with pytest.raises(CheckError, match="one resolved row"):
        writes.matches(users, "secret", "pw1", 3)
    ctx = Context(spark, "/nowhere", Catalog().with_table(TableDef("User", ("name", "secret"), ("name",))), frames={"User": users})
    with pytest.raises(CheckError, match="row filter"):
        run('User where "pw1" `matches` secret { name }', ctx)


def test_documents_in_the_language(spark):
    t = TableDef("Req", ("id", "body", "raw"), ("id",), docs=frozenset({"body"}), opaque=frozenset({"raw"}))
    data = [(1, '{"a": {"b": "x"}, "n": 5}', "{}"), (2, '{"a": {"b": 1}, "n": "5"}', "{}"), (3, '{"a": null}', "{}"), (4, "not json", "{}")]
    ctx = Context(spark, "/nowhere", Catalog().with_table(t), frames={"Req": spark.createDataFrame(data, "id long, body string, raw string")})
    assert rows(run('Req where body.a.b == "x" { id }', ctx)) == [(1,)]
    assert rows(run("Req where body.n == 5 { id }", ctx)) == [(1,)]  # no coercion of the text "5"
    assert sorted(rows(run("Req where body.n is NotFound { id }", ctx))) == [(3,), (4,)]
    assert rows(run("Req where body.a is JsonNull { id }", ctx)) == [(3,)]
    assert sorted(rows(run("Req { id, body.a.b as b }", ctx))) == [(1, "x"), (2, "1"), (3, None), (4, None)]
    with pytest.raises(CheckError, match="indexed"):
        run("Req { raw.x as y }", ctx)


def test_declared_fallback_and_moment(spark):
    from larkspur.plans.model import Edge

    cat = Catalog().with_table(TableDef("C", ("k", "n"), ("k",))).with_table(TableDef("O", ("o", "c"), ("o",), (Edge("c", "C", "k", ("NoC",)),))).with_absence("NoC")
    ctx = Context(spark, "/nowhere", cat, frames={"C": spark.createDataFrame([(1, "x")], "k long, n string"), "O": spark.createDataFrame([(1, 1), (2, 9)], "o long, c long")})
    assert sorted(rows(run("O >< C as who { o, who.tag as tag }", ctx))) == [(1, "C"), (2, "NoC")]
    with pytest.raises(CheckError, match="keeps no versions"):
        run('O at "1995-01-01" { o }', ctx)
    assert [r[0] for r in fetch("O { c }", ctx).collect()] == [1, 9]


def test_statements():
    assert parse_one("enforce app.U.name / minLen12 forward").mode == "enforce forward"
    with pytest.raises(CheckError):
        parse_one("enforce app.U.name sometimes")
    with pytest.raises(CheckError, match="once, and last"):
        parse_one("retain A for 3 days, drop otherwise forever where x == 1 forever")
