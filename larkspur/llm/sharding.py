"""Sharding by fixed virtual slots.

A record's slot is a hash of its key and never changes. Bytes are added up by slot, and a small
versioned table maps slots to shards; the number of shards may change, the slots do not. The
first map gives slots in order of size to the shard with the fewest bytes so far. `rebalance`
edits a map for more shards, or for new sizes, and moves as few bytes as it needs: shards above
the mean give slots to those below. Records then move only with their slot.

Maps are stored under a path, one folder a version; a version is written once and never again,
and one without Spark's mark of success is not read. `shard_documents` works by the stored map:
it makes the first one where there is none, and edits it into the next version where the number
of shards or the sizes have changed.

The table of slots has `n_slots` rows whatever the input, so it may be handled in one task and
broadcast. All else is one aggregation by slot and one window over the parts of slots: a slot of
more than `PART` records is cut into parts by hash, so that no slot is ranked in one task.
DataFrame functions only.

Defined results: a record without key is hashed by its text's checksum and size; null text has no
bytes and the checksum 0; repeated rows are separate records with places of their own; an empty
table gives an empty result, and then all slots have 0 bytes. Extra columns are kept; those made
here replace clashing ones. Equal texts under different keys lie in different slots: a group of
copies may hold a third of all rows, and kept together it would undo the balance of bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .state import aside, cut, shared_folder

N_SLOTS = 8192
OVERHEAD = 16
PART = 1 << 17
#: Columns that shard_documents makes.
MADE = ("size", "text_crc32", "vslot", "map_version", "shard", "slot")


def slot_of(key: Column, n_slots: int = N_SLOTS, instead: Column | None = None) -> Column:
    text = F.coalesce(key.cast("string"), F.concat(F.lit("null:"), F.lit("") if instead is None else instead))
    return F.pmod(F.xxhash64(text), F.lit(n_slots)).cast("int")


def slot_sizes(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(vslot, bytes, rows) for all slots, from records with `vslot` and `size`; empty ones have 0."""
    per = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    full = records.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return full.join(per, "vslot", "left").select("vslot", zero("bytes"), zero("rows"))


def _least_loaded(items: Column, loads: Column) -> Column:
    """Give each (b, vslot) of `items` in turn to the shard with the least load; an array of shards."""

    def step(s: Column, x: Column) -> Column:
        least = (F.array_position(s["loads"], F.array_min(s["loads"])) - 1).cast("int")
        raised = F.transform(s["loads"], lambda v, i: F.when(i == least, v + x["b"]).otherwise(v))
        return F.struct(raised.alias("loads"), F.concat(s["to"], F.array(least)).alias("to"))

    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<int>)").alias("to"))
    return F.aggregate(items, start, step)["to"]


def first_map(sizes: DataFrame, n_shards: int) -> DataFrame:
    """(vslot, shard): largest slots first, each to the least loaded shard."""
    item = F.struct((-F.col("bytes")).alias("nb"), F.col("vslot"), F.col("bytes").alias("b"))
    one = sizes.agg(F.sort_array(F.collect_list(item)).alias("xs"))
    loads = F.array_repeat(F.lit(0).cast("long"), n_shards)
    both = F.arrays_zip(F.col("xs.vslot").alias("vslot"), _least_loaded(F.col("xs"), loads).alias("shard"))
    return one.select(F.explode(both).alias("m")).select("m.vslot", "m.shard")


def rebalance(current: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """`current` (vslot, shard) edited for `n_shards` (no fewer than before).

    In each shard slots stay, largest first, while their sum is within the new mean; the others
    go to the least loaded shard, largest first: mostly a new shard, now and then an old one with
    room left. What stays is untouched, and a new shard only receives.
    """
    held = sizes.join(current.select("vslot", "shard"), "vslot")
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / n_shards
    filled = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0))
    held = cut(held.select("vslot", "shard", "bytes", (filled <= mean).alias("stays")))
    loads = held.where("stays").groupBy("shard").agg(F.sum("bytes").alias("b"))
    base = held.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(loads, "shard", "left")
    base = base.agg(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("b", F.lit(0)).cast("long").alias("b")))).alias("at"))
    item = F.struct((-F.col("bytes")).alias("nb"), F.col("vslot"), F.col("bytes").alias("b"))
    one = held.where("not stays").agg(F.sort_array(F.collect_list(item)).alias("xs")).crossJoin(base)  # one row each
    both = F.arrays_zip(F.col("xs.vslot").alias("vslot"), _least_loaded(F.col("xs"), F.col("at.b")).alias("shard"))
    moved = one.select(F.explode(both).alias("m")).select("m.vslot", "m.shard")
    return held.where("stays").select("vslot", "shard").unionByName(moved)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions stored under `path` that were written to the end."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    marks = files.Path(f"{path}/version=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found or ())


def save_map(slots: DataFrame, path: str) -> int:
    """Store (vslot, shard) as the next version under `path`, and return its number. A version that exists is never written again."""
    version = max(versions(slots.sparkSession, path), default=0) + 1
    slots.select("vslot", "shard").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version (version, vslot, shard) of the map, by default the last."""
    known = versions(spark, path)
    version = max(known, default=0) if version is None else version
    if version not in known:
        raise ValueError(f"no version {version} of the map under {path}")
    return spark.read.parquet(f"{path}/version={version}").select(F.lit(version).alias("version"), "vslot", "shard")


def current_map(sizes: DataFrame, n_shards: int, path: str, tolerance: float = 0.05) -> DataFrame:
    """The stored map, first made or edited into a next version if need be.

    It is edited if it has another number of shards, or if the fullest shard is above the mean by
    more than `tolerance` and an edit makes it less full.
    """
    spark = sizes.sparkSession
    if not versions(spark, path):
        save_map(first_map(sizes, n_shards), path)
        return load_map(spark, path)
    last = load_map(spark, path)

    def fullest(slots: DataFrame) -> tuple[int, float, float]:
        per = slots.join(sizes, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b"))
        n, most, total = per.agg(F.max("shard"), F.max("b"), F.sum("b")).first()  # one row
        return n + 1, most, total / n_shards

    n, most, mean = fullest(last)
    if n > n_shards:
        raise ValueError(f"the map under {path} has {n} shards, {n_shards} are asked for")
    if n < n_shards or most > (1 + tolerance) * mean:
        edited = cut(rebalance(last, sizes, n_shards))
        if n < n_shards or fullest(edited)[1] < most:
            save_map(edited, path)
    return load_map(spark, path)


def assign(records: DataFrame, slots: DataFrame, sizes: DataFrame, order: list[str]) -> DataFrame:
    """`records` (with `vslot`) with `map_version`, `shard` and `slot`, the record's place in its shard, gapless from 0.

    A slot's records follow those of the shard's slots before it, and a part's those of the
    slot's parts before it, so places need no window over a shard: offsets come from the small
    tables of slots and parts (a part has about PART records), ranks from a window over a part.
    """
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("rows").over(before("shard").orderBy("vslot")), F.lit(0))
    small = sizes.join(slots, "vslot").select(
        "vslot",
        "shard",
        F.col("version").alias("map_version"),
        offset.alias("__base"),
        F.ceil(F.col("rows") / PART).cast("int").alias("__parts"),
    )
    part = F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.greatest("__parts", F.lit(1))).cast("int")
    known = records.drop("map_version", "shard", "slot").join(F.broadcast(small), "vslot").withColumn("__part", part)  # n_slots rows, whatever the input
    large = small.agg(F.max("__parts")).first()[0] or 0
    if large > 1:
        counts = cut(known.where("__parts > 1").groupBy("vslot", "__part").agg(F.count(F.lit(1)).alias("n")))
        shift = counts.select("vslot", "__part", F.coalesce(F.sum("n").over(before("vslot").orderBy("__part")), F.lit(0)).alias("__shift"))
        known = known.join(shift, ["vslot", "__part"], "left")
    else:
        known = known.withColumn("__shift", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("vslot", "__part").orderBy(*order)) - 1
    slot = F.col("__base") + F.coalesce("__shift", F.lit(0)) + rank
    return known.withColumn("slot", slot.cast("long")).drop("__base", "__parts", "__part", "__shift")


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """`docs` with size, text_crc32, vslot, map_version, shard and slot, by the map stored at `path` (by default a new one in the shared folder)."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + OVERHEAD).cast("long")
    crc = F.crc32(raw)
    vslot = slot_of(F.col("doc_id"), n_slots, F.concat_ws(":", crc.cast("string"), size.cast("string")))
    docs, back = aside(docs)
    rows = docs.drop(*MADE).withColumns({"size": size, "text_crc32": crc, "vslot": vslot})
    sizes = cut(slot_sizes(rows, n_slots))
    slots = current_map(sizes, n_shards, path or f"{shared_folder(docs.sparkSession)}/shard-map-{uuid.uuid4().hex}")
    return back(assign(rows, slots, sizes, ["doc_id", "size", "text_crc32"]))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Law `bytes`: shards are near equal in bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard_documents(docs, 40)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "map_version",
    )


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict[str, str] = {}
