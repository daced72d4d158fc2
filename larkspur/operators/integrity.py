"""Constraints as queries: violations, enforcement modes, redaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import CheckError

COLUMNS = ("subject_table", "subject", "functor", "origin", "observed", "state")


@dataclass(frozen=True)
class Rule:
    """A named condition on rows of a table; a row for which it is not true violates it."""

    name: str
    holds: Column
    observed: str | None = None
    secret: bool = False


def _row(table: str, key: str, functor: str, observed: Column, origin: str = "Observed") -> list[Column]:
    return [
        F.lit(table).alias("subject_table"),
        F.col(key).cast("string").alias("subject"),
        F.lit(functor).alias("functor"),
        F.lit(origin).alias("origin"),
        observed.cast("string").alias("observed"),
        F.lit("Open").alias("state"),
    ]


def violations(df: DataFrame, table: str, key: str, rules: list[Rule]) -> DataFrame:
    """One row for each row and rule that fails; all rules in one pass over the table."""
    hits = F.array(*[F.when(
        ~F.coalesce(r.holds, F.lit(False)),
        F.struct(
            F.lit(r.name).alias("functor"),
            (F.lit("Redacted") if r.secret else F.col(r.observed).cast("string") if r.observed else F.lit(None).cast("string")).alias("observed"),
        ),
    ) for r in rules])
    each = df.select(F.col(key).cast("string").alias("subject"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h"))
    return each.select(
        F.lit(table).alias("subject_table"),
        "subject",
        F.col("h.functor").alias("functor"),
        F.lit("Observed").alias("origin"),
        F.col("h.observed").alias("observed"),
        F.lit("Open").alias("state"),
    )


def orphans(df: DataFrame, table: str, key: str, field: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose reference has no target."""
    found = df.join(target.select(F.col(target_key).alias("__k")), F.col(field) == F.col("__k"), "left_anti")
    return found.select(*_row(table, key, f"{table}.{field}", F.col(field)))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Key values that more than one row has, with their number."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("functor").agg(F.count(F.lit(1)).alias("affected")).orderBy(F.desc("affected"), "functor")


def split(df: DataFrame, holds: Column, mode: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused or reported) rows under `enforce always`, `enforce forward` or `monitor`."""
    ok = F.coalesce(holds, F.lit(False))
    if mode in ("enforce always", "enforce forward"):
        return df.where(ok), df.where(~ok)
    if mode == "monitor":
        return df, df.where(~ok)
    raise CheckError(f"unknown mode {mode}; say enforce always, enforce forward or monitor")


def blast_radius(df: DataFrame, holds: Column) -> DataFrame:
    """How many rows a new rule would fail, of how many; a populated field's rule must say its mode."""
    return df.agg(F.count_if(~F.coalesce(holds, F.lit(False))).alias("failing"), F.count(F.lit(1)).alias("total"))


def first_failing(rules: list[Rule]) -> Column:
    """The name of the first rule that fails, as composition stops there; NULL if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.name)) for r in rules])


def paths_equal(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Rows in which two paths to one fact disagree."""
    return df.where(~left.eqNullSafe(right))


def redact(df: DataFrame, allowed: DataFrame, on: list[str], bypass: bool = False) -> DataFrame:
    """Rows that the requester may not read keep their place, with every field absent and tagged Redacted.

    `allowed` has the readable values of `on`; it is joined as a flag and filters nothing.
    """
    if bypass:
        return df.withColumn("access", F.lit("Granted"))
    flag = allowed.select(*on).distinct().withColumn("__ok", F.lit(True))
    seen = df.join(flag, on, "left")
    ok = F.coalesce("__ok", F.lit(False))
    return seen.select(*[F.when(ok, F.col(c)).alias(c) for c in df.columns], F.when(ok, F.lit("Granted")).otherwise(F.lit("Redacted")).alias("access"))
