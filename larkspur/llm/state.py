"""Cutting lineage, and connected components, for the operators of this subpackage."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Nodes that a task holds at once.
STRETCH = 1 << 20
#: Seconds between two collections of garbage, and when the last one was.
EVERY_S = 2.0
_collected = [0.0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is named (tests), one under the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this subpackage has written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(name: str, taken: list[str]) -> str:
    """`name`, or a longer one, that is none of `taken`."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with columns renamed whose names begin as those that operators use inside, and what names them back."""
    names = {c: f"column {i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
    back = {new: c for c, new in names.items()}
    return docs.withColumnsRenamed(names), lambda df: df.withColumnsRenamed(back)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it from there: lost executors lose nothing.

    What is returned knows nothing of the plan behind it. A checkpoint alone keeps the plan's
    estimate of its size, in which every join multiplies; in loops the digits of that number
    double with each round, until the planner does nothing but multiply.

    Then let Spark delete the shuffle files behind it. Spark does so once the driver has collected
    the plan that made them as garbage, which a driver with little to do may not for long; long
    chains of large shuffles then pile up, and so do their plans and generated code on its heap.
    Many small steps in a row are collected together.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    kept = df.checkpoint()
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)
    del df, kept
    if time.monotonic() - _collected[0] > EVERY_S:
        gc.collect()
        sc._jvm.System.gc()
        _collected[0] = time.monotonic()
    return out


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as edges to the least node of what they connect within a stretch of a partition, of at most STRETCH nodes."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, t) for x in list(root) if (t := top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            root[max(a, b)] = min(a, b)
            if len(root) >= STRETCH:
                yield flush()
                root.clear()
    yield flush()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph of long integers, given by its edges.

    Returns (node, root) for every node that an edge between two different nodes touches. First
    every partition flattens what it holds. Then each round hooks every node to its least
    neighbour, jumps pointers until every tree is flat, and contracts the trees; at least half of
    the nodes go in each round. Only joins and combined minima are used, so a hub with millions
    of edges is never gathered in one place.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    live = cut(pairs.mapInArrow(_flat, "u long, v long").distinct())
    found = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")))
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = cut(up.join(over, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = up
        else:
            top = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = cut(found.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        left = up.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = up.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        live = cut(live.join(left, "u").join(right, "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
    return found if found is not None else live.select(F.col("u").alias("node"), F.col("v").alias("root"))
