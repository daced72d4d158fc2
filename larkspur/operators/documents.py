"""Tree-shaped documents queried by path; the text stays authoritative, variants are derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_at(body: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(body), "$." + path, kind)


def tag_at(body: Column, path: str) -> Column:
    """NotFound for an absent path, JsonNull for an explicit null, else the type of what is there."""
    found = F.try_variant_get(F.try_parse_json(body), "$." + path, "variant")
    return F.when(found.isNull(), F.lit("NotFound")).when(F.is_variant_null(found), F.lit("JsonNull")).otherwise(F.schema_of_variant(found))


def census(df: DataFrame, body: str) -> DataFrame:
    """(key, present, share, types) of the top-level keys: their number of documents, part of all, and the types seen."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    each = df.select(F.explode(F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>")).alias("key", "v"))
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("present"), F.sort_array(F.collect_set(kind)).alias("types"))
    return counts.join(F.broadcast(total)).select("key", "present", (F.col("present") / F.col("total")).alias("share"), "types")  # one row


def depth(body: Column) -> Column:
    """A bound of a JSON text's nesting: its deepest run of brackets outside strings."""
    brackets = F.regexp_replace(F.regexp_replace(body, r'"(?:[^"\\\\]|\\\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda s, c: F.struct((s["at"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("at"), F.greatest(s["most"], s["at"] + 1).alias("most"))
    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step)["most"]


def shred(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, path, kind, value) of all nodes of each document.

    One job finds how deep the documents go; then one step a level turns every open container into
    itself and its children, and passes on what is closed, so no level is computed twice.
    """
    levels = df.agg(F.max(depth(F.col(body)))).first()[0] or 0
    node = lambda path, v: F.struct(path.alias("path"), v.alias("v"), F.lit(False).alias("closed"))
    rows = df.select(key, F.explode(F.array(node(F.lit("$"), F.try_parse_json(body)))).alias("n")).where("n.v is not null")
    for _ in range(levels):
        v, path = F.col("n.v"), F.col("n.path")
        fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: node(F.concat(path, F.lit("."), e["key"]), e["value"]))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e, i: node(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), e))
        none = F.slice(F.array(node(path, v)), 1, 0)
        itself = F.array(F.struct(path.alias("path"), v.alias("v"), F.lit(True).alias("closed")))
        grown = F.concat(itself, F.coalesce(fields, none), F.coalesce(items, none))
        rows = rows.select(key, F.explode(F.when(F.col("n.closed"), F.array(F.col("n"))).otherwise(grown)).alias("n"))
    kind = F.schema_of_variant("n.v")
    value = F.when(~kind.rlike("^(OBJECT|ARRAY)"), F.try_variant_get(F.col("n.v"), "$", "string"))
    return rows.select(key, "n.path", F.regexp_extract(kind, "^[A-Z]+", 0).alias("kind"), value.alias("value"))
