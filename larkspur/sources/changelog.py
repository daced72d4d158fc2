"""Change sources: a directory of change files read as a stream, and services that are polled.

A change has the source's position, a time, an operation (insert, update, delete), the key and
the row. Positions are remembered by the stream's own checkpoint, so a restart goes on where the
last finished batch ended, and a batch that is run twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions

#: What a connector's log keeps of each change.
LOG = "connector_id string, external_seq long, external_timestamp timestamp, operation string, external_table string, external_key string, external_payload string"
OPS = {"insert": "I", "update": "U", "delete": "D"}


def changes(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The change files of a folder as a stream, in the order in which they arrive."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).json(folder)


def to_log(rows: DataFrame, table: str, fields: str) -> DataFrame:
    """Changes of one table as versions (id, tx_seq, op, valid_from, fields...); unknown operations are left to `unknown`."""
    op = F.coalesce(*[F.when(F.col("operation") == k, F.lit(v)) for k, v in OPS.items()])
    payload = F.from_json("external_payload", fields)
    out = rows.where((F.col("external_table") == table) & op.isNotNull())
    out = out.select(
        F.col("external_key").alias("id"),
        F.col("external_seq").alias("tx_seq"),
        op.alias("op"),
        F.col("external_timestamp").cast("timestamp_ntz").alias("valid_from"),
        payload.alias("__p"),
    )
    return out.select("id", "tx_seq", "op", "valid_from", "__p.*")


def unknown(rows: DataFrame) -> DataFrame:
    """Changes that no version can be made of; a bad change is recorded and never stops the stream."""
    return rows.where(~F.coalesce(F.col("operation").isin(list(OPS)), F.lit(False)) | F.col("external_key").isNull() | F.col("external_seq").isNull())


def follow(source: DataFrame, table: str, fields: str, path: str, checkpoint: str):
    """Append the stream's versions of `table` to the log at `path`, and stop when all files that are there have been read.

    The file sink commits each batch once, so lost executors and restarts neither lose nor repeat versions.
    """
    return to_log(source, table, fields).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(log: DataFrame, moment: str | None = None) -> DataFrame:
    """The rows of a followed table, by position of the source and not by arrival; repeats count once."""
    return versions.current(versions.replayed(log), "id", moment)


def poll(fetch: Callable[[object], DataFrame], cursor: object, column: str) -> tuple[DataFrame, object]:
    """One poll of a service: rows past `cursor`, and the cursor for the next poll (one number or time, so it may be collected)."""
    rows = fetch(cursor)
    if cursor is not None:
        rows = rows.where(F.col(column) > F.lit(cursor))
    last = rows.agg(F.max(column)).first()[0]
    return rows, cursor if last is None else last


def webhook(bodies: DataFrame, column: str, fields: str) -> tuple[DataFrame, DataFrame]:
    """Delivered bodies as rows, and those that can't be read, which are recorded and not refused."""
    parsed = bodies.withColumn("__p", F.from_json(column, f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    good = F.col("__p").isNotNull() & F.col("__p._bad").isNull()
    kept = [c for c in bodies.columns if c != column]
    return parsed.where(good).select(*kept, "__p.*").drop("_bad"), parsed.where(~good).select(*bodies.columns)
