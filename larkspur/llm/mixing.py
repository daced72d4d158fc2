"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document of it is due target / source size copies,
a number from 0 to `cap`. The whole part is certain. The fractional parts are rounded by the
pivotal method: two units meet, probability moves at random from one to the other until one of
them is 0 or 1, and the one that is still fractional meets the next. Expectations are kept
exactly, and the number of copies in any block stays within one of its expectation.

The meetings form a reduction tree: units are hashed into blocks of about `block` units of one
source, a block rounds all but at most one of its units, and the units left over form the next
level, until one block a source remains. A hot source thus only has more blocks. Inside a block
units meet from large to small, so that mass moves between units of about one size and the unit
left over is small; each source's words then stay near its target.

DataFrame functions only. Random numbers are hashes of the seed, the level and the document, so
reruns agree.

Equal rows are combined to one unit before. What a source then misses, or has too much, is made
up by a copy more or less of a few documents that fit.

Defined results: null text has size 0 and takes 0 words; sources are ordered by code point with
null last; a source of size 0 has target 0; repeated rows share their joint copies as evenly as
may be; an empty table gives an empty mix. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import word_count
from .state import aside, cut

WEIGHTS = (5.0, 2.0, 1.0)
EPS = 1e-9
FLIPS = 4


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Targets are proportional to the weights, which repeat over the sources in order, and sum to
    `share` of all sizes; none is above `cap` times its source's size, and what is cut goes to
    the others by weight until none is above. The cut sources are those with the least cap / weight,
    so one sorted pass over the table of sources finds them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("weight", F.get(kinds, (F.row_number().over(order) - 1) % len(weights)))
    every = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    taken = F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))
    weighed = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.lit(share) * F.sum("source_size").over(whole) - taken) / (F.sum("weight").over(whole) - weighed)
    cut_off = ranked.withColumn("level", level).withColumn("over", F.lit(cap) * F.col("source_size") <= F.col("level") * F.col("weight"))
    open_level = F.first(F.when(~F.col("over"), F.col("level")), ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("over") | open_level.isNull(), F.lit(cap) * F.col("source_size")).otherwise(open_level * F.col("weight"))
    return cut_off.select("source", F.col("source_size").cast("long"), target.cast("double").alias("target"))


def _draw(seed: int, level: int, *by: Column) -> Column:
    """A number from 0 to 1 that only depends on its arguments."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *by), 11) / F.lit(float(1 << 53))


def _meet(units: Column) -> Column:
    """Pivotal rounding of an array of (p, u, ...): an array of (at, got), and the unit left over.

    The state carries one fractional unit (its place and probability). A new unit with p meets it
    with c: if c + p < 1 one of them goes to 0, else one goes to 1; which of them is random, so
    that both keep their expectation.
    """
    fields = "array<struct<at:int,got:int>>"
    start = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("c"), F.expr(f"cast(array() as {fields})").alias("done"))

    def settle(done: Column, at: Column, got: int) -> Column:
        return F.concat(done, F.array(F.struct(at.cast("int").alias("at"), F.lit(got).alias("got"))))

    def step(s: Column, x: Column) -> Column:
        c, p, total = s["c"], x["p"], s["c"] + x["p"]
        state = lambda at, c, done: F.struct(at.alias("at"), c.alias("c"), done.alias("done"))
        low = total < 1 - EPS
        old_stays = F.when(low, x["u"] * total < c).otherwise(x["u"] * (2 - total) < 1 - c)
        none = F.lit(-1)
        exact = F.abs(total - 1) <= EPS  # both become integral
        return (
            F.when(s["at"] < 0, state(x["i"], p, s["done"]))
            .when(exact & (x["u"] < c), state(none, F.lit(0.0), settle(settle(s["done"], s["at"], 1), x["i"], 0)))
            .when(exact, state(none, F.lit(0.0), settle(settle(s["done"], s["at"], 0), x["i"], 1)))
            .when(low & old_stays, state(s["at"], total, settle(s["done"], x["i"], 0)))
            .when(low, state(x["i"], total, settle(s["done"], s["at"], 0)))
            .when(old_stays, state(s["at"], total - 1, settle(s["done"], x["i"], 1)))
            .otherwise(state(x["i"], total - 1, settle(s["done"], s["at"], 1)))
        )

    return F.aggregate(units, start, step)


def round_copies(units: DataFrame, seed: int = 0, block: int = 128) -> DataFrame:
    """Round `frac` of (source, doc_id, size, frac, keep...) rows to 0 or 1 in column `got`.

    Each level shuffles the fractional units by block once; a level has about 1 / `block` of the
    units of the one before. Blocks have `block` units on average and stay small in any source.
    """
    cols = units.columns
    row = F.struct(*[F.col(c) for c in cols])
    sure = units.where((F.col("frac") <= EPS) | (F.col("frac") >= 1 - EPS)).withColumn("got", F.when(F.col("frac") > 0.5, 1).otherwise(0))
    live = units.where((F.col("frac") > EPS) & (F.col("frac") < 1 - EPS))
    counts = live.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    live = live.join(counts, live["source"].eqNullSafe(counts["source"]), "left").drop(counts["source"])
    out, level = [sure], 0
    while most > 0:
        n_blocks = F.greatest(F.ceil(F.col("n") / float(block ** (level + 1))), F.lit(1))
        key = F.pmod(F.xxhash64(F.lit(seed), F.lit(~level), "doc_id", "size"), n_blocks)
        unit = F.struct((-F.col("size")).alias("s"), _draw(seed, level, F.col("doc_id"), F.col("size")).alias("u"), F.col("frac").alias("p"), row.alias("row"))
        packed = live.groupBy("source", "n", key.alias("k")).agg(F.sort_array(F.collect_list(unit)).alias("xs"))
        packed = packed.withColumn("ys", F.transform("xs", lambda x, i: F.struct(i.cast("int").alias("i"), x["p"].alias("p"), x["u"].alias("u"))))
        met = cut(packed.select("n", "xs", _meet(F.col("ys")).alias("m")))
        one = lambda c, got: F.get("xs", c)["row"].alias("r") if got is None else F.get("xs", c)["row"]
        done = met.select("xs", F.explode("m.done").alias("d")).select(one(F.col("d.at"), None), F.col("d.got").alias("got"))
        out.append(done.select("r.*", "got"))
        rest = met.where(F.col("m.at") >= 0)
        left = rest.select("n", one(F.col("m.at"), None), F.col("m.c").alias("c"))
        left = left.select(*[(F.col("c") if c == "frac" else F.col(f"r.{c}")).alias(c) for c in cols], "n")
        if most <= block ** (level + 1):  # every source had one block: its last unit is rounded by its own draw
            out.append(left.withColumn("got", F.when(_draw(seed, -1, F.col("doc_id"), F.col("size")) < F.col("frac"), 1).otherwise(0)).select(*cols, "got"))
            break
        live, level = left, level + 1
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total


def _settle(kinds: DataFrame, cap: float, seed: int, by: list[str]) -> DataFrame:
    """`kinds` with `total` changed by one copy of a few documents, so that sources come close to their targets.

    Rounding leaves a source within about one unit of its target, and a unit may be one huge
    document. Of each source's documents at most FLIPS of each power of two in size, those with
    the least hash, are asked in order of size; each that fits into what is missing (or too much)
    gains (or loses) a copy.
    """
    off = kinds.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("total"))).alias("off"))
    off = off.where(F.abs("off") >= 1).withColumnRenamed("source", "__s")
    hashed = F.xxhash64(F.lit(seed), F.lit(-2), "doc_id", "size")
    can = F.when(F.col("off") > 0, F.col("total") + 1 <= cap * F.col("rows")).otherwise(F.col("total") > 0)
    open_ = kinds.join(off, F.col("source").eqNullSafe(F.col("__s"))).where(can & (F.col("size") > 0) & (F.col("size") <= F.abs("off")))
    unit = F.struct(hashed.alias("h"), *by)
    some = open_.groupBy("source", "off", F.floor(F.log2("size")).alias("class"), F.pmod(hashed, F.lit(FLIPS)).alias("of")).agg(F.min(unit).alias("x"))
    named = F.struct("x.size", "x.h", *[F.col(f"x.{c}").alias(f"__{i}") for i, c in enumerate(by)])
    asked = some.groupBy("source", "off").agg(F.sort_array(F.collect_list(named), asc=False).alias("xs"))  # FLIPS * 64 a source at most

    def step(s: Column, x: Column) -> Column:
        fits = x["size"] <= s["left"]
        taken = F.when(fits, F.concat(s["xs"], F.array(x))).otherwise(s["xs"])
        return F.struct((s["left"] - F.when(fits, x["size"]).otherwise(F.lit(0))).alias("left"), taken.alias("xs"))

    start = F.struct(F.abs("off").alias("left"), F.slice("xs", 1, 0).alias("xs"))
    flips = asked.select("source", F.signum("off").cast("long").alias("by"), F.explode(F.aggregate("xs", start, step)["xs"]).alias("x"))
    flips = cut(flips.select("by", *[F.col(f"x.__{i}") for i in range(len(by))]))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & kinds[c].eqNullSafe(flips[f"__{i}"])
    return kinds.join(flips, same, "left").withColumn("total", F.col("total") + F.coalesce("by", F.lit(0))).select(*kinds.columns)


def mix_kinds(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
    block: int = 128,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, keep..., rows, source_size, target, total): equal rows, of which `total` copies are taken.

    Equal rows are one unit: of their joint copies the whole part is certain and one fraction is
    left to round, so that no number of equal rows makes a block large.
    """
    by = ["doc_id", "source", "size", *keep]
    kinds = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep).groupBy(*by).agg(F.count(F.lit(1)).alias("rows")))
    aims = targets(kinds.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, cap)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("rows")
    units = kinds.join(aims.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    units = cut(units.withColumn("sure", F.floor(due + EPS).cast("long")).withColumn("frac", F.greatest(due - F.col("sure"), F.lit(0.0))))
    rounded = round_copies(units, seed, block).withColumn("total", F.col("sure") + F.col("got")).drop("sure", "frac", "got")
    return _settle(cut(rounded.select(*by, "rows", "source_size", "target", "total")), cap, seed, by)


def mix_copies(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, keep...) of every row of `docs`."""
    kinds = mix_kinds(docs, **how)
    each = kinds.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.floor(F.col("total") / F.col("rows")) + F.when(F.col("__i") <= F.col("total") % F.col("rows"), 1).otherwise(0)
    return each.withColumn("copies", copies.cast("int")).drop("__i", "rows", "total")


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """`docs` with each row as often as the mix takes it, none for documents left out.

    Rows equal in doc_id, source and text are joined as one with their copies added up.
    """
    docs, back = aside(docs)
    marked = docs.withColumn("__mark", F.xxhash64("doc_id", "source", "text"))
    taken = cut(mix_kinds(marked, keep=("__mark",), **how).select(
        F.col("doc_id").alias("__id"),
        F.col("__mark").alias("__m"),
        F.col("total").alias("__n"),
        F.col("rows").alias("__rows"),
    ))
    if not taken.where("__rows > 1").isEmpty():
        marked = marked.dropDuplicates(["doc_id", "__mark"])
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__m"))
    both = marked.join(taken.where("__n > 0"), same)
    copies = both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return back(copies.select(*[docs[c] for c in docs.columns]))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
