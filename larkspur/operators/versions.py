"""Version logs: rows (id, tx_seq, op I/U/D, valid_from, fields), appended and never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOOK = ("tx_seq", "op", "valid_from")


def replayed(log: DataFrame, key: str = "id") -> DataFrame:
    """The log with transactions that were applied twice counted once."""
    return log.dropDuplicates([key, "tx_seq"])


def current(log: DataFrame, key: str = "id", moment: str | Column | None = None) -> DataFrame:
    """The newest version of each row at `moment`; deleted rows are hidden, rows written again are back.

    One aggregation: max_by combines before the shuffle, so long version chains do not travel.
    """
    if moment is not None:
        log = log.where(F.col("valid_from") <= (F.expr(f"timestamp_ntz'{moment}'") if isinstance(moment, str) else moment))
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), "tx_seq").alias("v"))
    return newest.select(key, "v.*").where("op <> 'D'")


def field_times(log: DataFrame, field: str, key: str = "id", absent: Column | None = None) -> DataFrame:
    """(key, created_at, updated_at) of a field: its first present value, and its last change of value."""
    over = Window.partitionBy(key).orderBy("tx_seq")
    before = F.lag(field).over(over)
    changed = (F.row_number().over(over) == 1) | ~F.col(field).eqNullSafe(before)
    present = ~absent if absent is not None else F.col(field).isNotNull()
    marked = log.where("op <> 'D'").select(key, "valid_from", changed.alias("changed"), present.alias("present"))
    return marked.groupBy(key).agg(
        F.min(F.when(F.col("present"), F.col("valid_from"))).alias("created_at"),
        F.max(F.when(F.col("changed"), F.col("valid_from"))).alias("updated_at"),
    )


def append(log: DataFrame, rows: DataFrame, op: str, tx_seq: int, valid_from: str) -> DataFrame:
    """The log with one transaction more that inserts, updates or deletes `rows`."""
    new = rows.withColumns({"tx_seq": F.lit(tx_seq).cast("long"), "op": F.lit(op), "valid_from": F.expr(f"timestamp_ntz'{valid_from}'")})
    return log.unionByName(new, allowMissingColumns=True)


def ordinals(rows: DataFrame, parent: str, *order: str) -> DataFrame:
    """Places of components under their parent, from 1."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def transitions(log: DataFrame, condition: Column, key: str = "id") -> DataFrame:
    """Versions at which `condition` turned from false to true."""
    marked = log.withColumn("__c", F.coalesce(condition, F.lit(False)))
    was = F.coalesce(F.lag("__c").over(Window.partitionBy(key).orderBy("tx_seq")), F.lit(False))
    return marked.withColumn("__w", was).where("__c and not __w").drop("__c", "__w")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """`old` with the rows of `new` in place of those of their keys; applying it twice changes nothing."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)
