"""What happens to a written row, in its fixed order, and what the modes of rules make of failures.

Coerce, validate (the input value), decide (by mode), transform (hash, look up a tag), encode,
resolve references and uniqueness, evaluate asserts, fire events. Validation comes before the
transform, so that no digest is validated and no secret reaches the log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import CheckError

MODES = ("enforce always", "enforce forward", "monitor", "repair into")


@dataclass(frozen=True)
class FieldRule:
    """A predicate on a field, at its address, with the mode of its attachment."""

    address: str
    field: str
    holds: Column
    mode: str = "enforce always"
    queue: str | None = None
    secret: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise CheckError(f"unknown mode {self.mode}; say {', '.join(MODES[:-1])} or repair ... into")
        if self.mode == "repair into" and not self.queue:
            raise CheckError("repair needs a queue: repair <rule> into <queue>")


@dataclass(frozen=True)
class Written:
    """The outcome of a write: rows as they are stored, those refused, violations, and rows for repair queues."""

    accepted: DataFrame
    refused: DataFrame
    violations: DataFrame
    repairs: dict[str, DataFrame]


def _fails(rule: FieldRule) -> Column:
    return ~F.coalesce(rule.holds, F.lit(False))


def binding(rule: FieldRule, unchanged: Column | None) -> Column:
    """Whether a failure refuses the row: always under `enforce always`, under `enforce forward` for new and changed values only."""
    if rule.mode == "enforce always":
        return F.lit(True)
    if rule.mode == "enforce forward":
        return F.lit(True) if unchanged is None else ~unchanged
    return F.lit(False)


def write(
    rows: DataFrame,
    table: str,
    key: str,
    rules: list[FieldRule],
    *,
    kinds: dict[str, str] | None = None,
    transforms: dict[str, Column] | None = None,
    before: DataFrame | None = None,
    node: str = "0",
) -> Written:
    """Steps 1 to 5 for `rows`; `before` has the stored rows, against which `enforce forward` tells changed values."""
    kinds, transforms = kinds or {}, transforms or {}
    typed = rows.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})  # coerce
    unchanged: dict[str, Column] = {}
    if before is not None:
        fields = sorted({r.field for r in rules})
        old = before.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__was_{c}") for c in fields])
        typed = typed.join(old, F.col(key) == F.col("__key"), "left")
        unchanged = {c: F.col("__key").isNotNull() & F.col(c).eqNullSafe(F.col(f"__was_{c}")) for c in fields}
    faults = [F.when(
        _fails(r),
        F.struct(
            F.lit(r.address).alias("functor"),
            F.lit(r.mode).alias("mode"),
            F.lit(r.queue).alias("queue"),
            (F.lit("Redacted") if r.secret else F.col(r.field).cast("string")).alias("observed"),
            binding(r, unchanged.get(r.field)).alias("refuses"),
        ),
    ) for r in rules]
    kind = "array<struct<functor:string,mode:string,queue:string,observed:string,refuses:boolean>>"
    found = F.filter(F.array(*faults), lambda x: x.isNotNull()) if faults else F.expr(f"cast(array() as {kind})")
    judged = typed.withColumn("__faults", found)
    refuses = F.exists("__faults", lambda x: x["refuses"])
    violations = judged.select(F.col(key).cast("string").alias("subject"), F.explode("__faults").alias("f")).select(
        F.lit(table).alias("subject_table"),
        "subject",
        "f.functor",
        F.lit(node).alias("schema_node"),
        F.lit("Derived").alias("origin"),
        "f.observed",
        F.lit("Open").alias("state"),
    )
    stored = [transforms.get(c, F.col(c)).alias(c) for c in rows.columns]  # transform, and what is encoded
    queues = {r.queue for r in rules if r.mode == "repair into"}
    asks = lambda q: F.exists("__faults", lambda x: x["queue"] == q)
    repairs = {q: judged.where(asks(q)).select(*stored) for q in sorted(queues)}
    return Written(judged.where(~refuses).select(*stored), judged.where(refuses).select(*rows.columns), violations, repairs)


def salted_digest(secret: Column, salt: Column, rounds: int = 1) -> Column:
    """salt$digest: what a hashed field stores of its plaintext."""
    digest = F.sha2(F.concat(salt, secret), 256)
    for _ in range(rounds - 1):
        digest = F.sha2(F.concat(salt, digest), 256)
    return F.concat_ws("$", salt, digest)


def matches(row: DataFrame, field: str, attempt: str, rounds: int = 1) -> bool:
    """Whether `attempt` is the secret of a single resolved row; more than one row is an error, as every row would be hashed."""
    got = row.select(F.col(field).alias("s"), (F.col(field) == salted_digest(F.lit(attempt), F.substring_index(field, "$", 1), rounds)).alias("ok")).take(2)
    if len(got) > 1:
        raise CheckError("matches applies to one resolved row, after a unique field has narrowed the query; it is no row filter")
    return bool(got and got[0]["ok"])


def recorded(old: DataFrame | None, found: DataFrame) -> DataFrame:
    """Violations with those found now in place of earlier derived ones; observed and forced ones stay."""
    return found if old is None else old.where("origin <> 'Derived'").unionByName(found)


def decomposed(row: dict[str, object], parts: list[tuple[str, dict[str, str], dict[str, object]]]) -> list[tuple[str, dict[str, object]]]:
    """One row through a view as one row a base table, referenced tables first.

    Each part is (table, {its field: the view's field}, {its field: constant of the view's where}).
    """
    return [(table, {f: row[v] for f, v in fields.items() if v in row} | constants) for table, fields, constants in parts]
