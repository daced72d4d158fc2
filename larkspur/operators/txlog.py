"""The transaction log as a table in the store: append, scan, random read, inspection, prune records.

A log is a folder of Parquet, one subfolder a transaction, so that a read of one transaction or
of a stretch of them opens no other file. Rows carry their place in the transaction; a row's
version id is (shard, transaction, place).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import version_id
from ..plans.model import CheckError


class TxLog:
    """The log of one table under `path`; `shard` is the number that its version ids carry."""

    def __init__(self, spark: SparkSession, path: str, schema: str, shard: int = 0):
        self.spark, self.path, self.schema, self.shard = spark, path, schema, shard

    def sequences(self) -> list[int]:
        """The transactions that were written to the end, in order."""
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        marks = files.Path(f"{self.path}/tx_seq=*/_SUCCESS")
        found = marks.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
        return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found or ())

    def append(self, rows: DataFrame, op: str, valid_from: str, order: list[str], seq: int | None = None) -> int:
        """Write one transaction; one that exists is refused, never written again."""
        last = max(self.sequences(), default=0)
        seq = last + 1 if seq is None else seq
        if seq <= last:
            raise CheckError(f"transaction {seq} is in the log; the last is {last}")
        place = (F.row_number().over(Window.orderBy(*order)) - 1).cast("int")  # a transaction's rows are few
        out = rows.withColumns({"row_pos": place, "op": F.lit(op), "valid_from": F.lit(valid_from).cast("timestamp_ntz")})
        out.write.mode("error").parquet(f"{self.path}/tx_seq={seq}")
        return seq

    def scan(self, since: int | None = None, until: int | None = None) -> DataFrame:
        """All versions in log order, or those of a stretch of transactions (other folders are not opened)."""
        df = self.spark.read.schema(f"{self.schema}, row_pos int, op string, valid_from timestamp_ntz, tx_seq long").parquet(self.path)
        if since is not None:
            df = df.where(F.col("tx_seq") >= since)
        return df if until is None else df.where(F.col("tx_seq") <= until)

    def read(self, seq: int) -> DataFrame:
        """The mutations of one transaction, in order."""
        return self.scan(seq, seq).orderBy("row_pos")

    def transactions(self, since: int | None = None, limit: int | None = None) -> DataFrame:
        """(tx_seq, valid_from, op, mutations) of the transactions, the newest first."""
        out = self.scan(since).groupBy("tx_seq", "op").agg(F.min("valid_from").alias("valid_from"), F.count(F.lit(1)).alias("mutations"))
        out = out.orderBy(F.desc("tx_seq"), "op")
        return out if limit is None else out.limit(limit)

    def with_ids(self) -> DataFrame:
        """All versions with their 14-byte ids."""
        return self.scan().withColumn("version_id", version_id(F.lit(self.shard), F.col("tx_seq"), F.col("row_pos")))


def subtree(components: DataFrame, path: str, root: str) -> DataFrame:
    """The components at and below `root` in document order: one contiguous range of the materialized path.

    A path is places joined by dots, each of fixed width, so that its text order is document order.
    """
    below = (F.col(path) >= f"{root}.") & (F.col(path) < f"{root}/")  # "/" follows "." in code points
    return components.where((F.col(path) == root) | below).orderBy(path)


def tree_path(*places, width: int = 8):
    """The materialized path of a component from its places, level by level."""
    return F.concat_ws(".", *[F.lpad(p.cast("string"), width, "0") for p in places])


def prune_record(log: DataFrame, table: str, before: str, moment: str) -> DataFrame:
    """What a chain's prune node says: the table, the stretch of transactions and the number of rows that it drops."""
    gone = log.where(F.col("valid_from") < F.lit(before).cast("timestamp_ntz"))
    return gone.agg(
        F.lit(table).alias("pruned_table"),
        F.min("tx_seq").alias("first_seq"),
        F.max("tx_seq").alias("last_seq"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(moment).cast("timestamp_ntz").alias("pruned_at"),
    )
