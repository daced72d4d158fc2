"""Events: queues of transitions, retry backoff, and streaming rollups with checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rollup import Template
from ..operators.versions import transitions, upsert


def emit(log: DataFrame, condition: Column, fields: list[str], key: str = "id") -> DataFrame:
    """Queue rows, pending, for each false-to-true transition of `condition`."""
    return transitions(log, condition, key).select(key, "tx_seq", *fields, F.lit("Pending").alias("status"))


def backoff(failures: Column, base_ms: int, cap_ms: int, seed: Column) -> Column:
    """base * 2 ** failures up to the cap, and up to a fifth more or less by a hash of `seed`."""
    plain = F.least(F.lit(base_ms) * F.pow(F.lit(2), failures), F.lit(cap_ms))
    jitter = F.conv(F.substring(F.md5(seed.cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 401 - 200
    return (plain * (F.lit(1000) + jitter) / 1000).cast("long")


def failure_rates(attempts: DataFrame, moment: str, window: str) -> DataFrame:
    """(destination, attempts, failures, rate) of the attempts in the window before `moment`."""
    at = F.lit(moment).cast("timestamp_ntz")
    recent = attempts.where((F.col("attempted_at") <= at) & (F.col("attempted_at") > at - F.expr(f"interval {window}")))
    out = recent.groupBy("destination").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("error").isNotNull()).alias("failures"))
    return out.withColumn("rate", F.col("failures") / F.col("attempts"))


def volume_backoff(rates: DataFrame, threshold: float, base_ms: int, cap_ms: int) -> DataFrame:
    """`rates` with `wait_ms`: none up to the threshold of failures, then base * 2 ** n for each further tenth, with jitter."""
    over = F.floor((F.col("rate") - F.lit(threshold)) * 10)
    wait = F.when(F.col("rate") > threshold, backoff(over, base_ms, cap_ms, F.col("destination"))).otherwise(0)
    return rates.withColumn("wait_ms", wait.cast("long"))


def due(queue: DataFrame, moment: str, depth: int) -> DataFrame:
    """The items to dispatch at `moment`, in flight: pending and due, at most `depth` a destination, the earliest first.

    Items of a destination that are in flight already count against its depth.
    """
    at = F.expr(f"timestamp_ntz'{moment}'")
    flying = queue.where("status = 'InFlight'").groupBy("destination").agg(F.count(F.lit(1)).alias("__f"))
    ready = queue.where((F.col("status") == "Pending") & (F.col("scheduled_at") <= at))
    turn = F.row_number().over(Window.partitionBy("destination").orderBy("scheduled_at", "id"))
    first = ready.withColumn("__n", turn).where(F.col("__n") <= depth).join(flying, "destination", "left")
    return first.where(F.col("__n") + F.coalesce("__f", F.lit(0)) <= depth).select(*[F.lit("InFlight").alias(c) if c == "status" else c for c in queue.columns])


def settle(items: DataFrame, results: DataFrame, moment: str, max_attempts: int, base_ms: int, cap_ms: int) -> DataFrame:
    """Items in flight after their handler's `results` (id, error; null error: done).

    A failed item is pending again after its backoff, or failed for good at `max_attempts`; items
    without a result stay in flight. Upserting the outcome by id twice changes nothing.
    """
    told = results.select("id", F.col("error").alias("__e"), F.lit(True).alias("__r"))
    both = items.where("status = 'InFlight'").join(told, "id", "left")
    bad, tries = F.col("__e").isNotNull(), F.col("attempt_count") + 1
    wait = F.timestamp_add("MILLISECOND", backoff(F.col("attempt_count"), base_ms, cap_ms, F.col("id")), F.expr(f"timestamp_ntz'{moment}'"))
    again = bad & (tries < max_attempts)
    new = {
        "status": F.when(F.col("__r").isNull(), F.lit("InFlight")).when(~bad, F.lit("Done")).when(again, F.lit("Pending")).otherwise(F.lit("Failed")),
        "attempt_count": F.when(bad, tries).otherwise(F.col("attempt_count")),
        "last_error": F.coalesce("__e", "last_error"),
        "scheduled_at": F.when(again, wait).otherwise(F.col("scheduled_at")),
    }
    return both.select(*[new[c].alias(c) if c in new else c for c in items.columns])


def stream_rollup(source: DataFrame, template: Template, grain: str, path: str, checkpoint: str, late: str = "10 minutes"):
    """Keep the level of `grain` at `path` from a stream.

    Buckets finish when the watermark passes them; each micro-batch appends only finished ones.
    """
    buckets = source.withWatermark(template.time, late).groupBy(F.window(template.time, f"1 {grain}"), *template.groups)
    aggs = {n: c for m in template.measures for n, c in m.first().items()}
    level = buckets.agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("window.start").cast("timestamp_ntz").alias("bucket_start"), *template.groups, *aggs)
    return level.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path).trigger(availableNow=True).start()


def apply_batch(read, write, key: tuple[str, ...]):
    """A foreachBatch function that upserts by key; replaying a batch changes nothing.

    `read(batch_id)` gives the table before the batch, `write(df, batch_id)` stores the one after.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        write(upsert(read(batch_id), batch.dropDuplicates(list(key)), *key), batch_id)

    return run
