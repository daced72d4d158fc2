"""Aggregate templates over time buckets, and retention chains of them.

A template names its group fields and mergeable aggregates. Level 1 is computed from raw rows,
level k from level k - 1: counts and sums add up, minima and maxima repeat, an average is kept as
sum and count and divided only when read. Levels cover disjoint ages, so the union view of a
chain counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import CheckError

GRAINS = ("minute", "hour", "day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class MergeableAgg:
    """A custom aggregate: `partial` of raw rows, an associative `merge` of partial results, `finish` when read."""

    partial: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    finish: Callable[[Column], Column]


#: Sketches have a merge, so they may stand in chains of any length: distinct values, and quantiles within about 1 %.
SKETCHES = {
    "distinct": lambda arg: MergeableAgg(lambda c: F.hll_sketch_agg(c), lambda c: F.hll_union_agg(c), lambda c: F.hll_sketch_estimate(c)),
    "quantile": lambda arg: MergeableAgg(lambda c: F.kll_sketch_agg_double(c.cast("double")), lambda c: F.kll_merge_agg_double(c), lambda c: F.kll_sketch_get_quantile_double(c, F.lit(arg))),
}


@dataclass(frozen=True)
class Measure:
    """An output column: a function of a field, or a custom aggregate. `percentile` has no merge; `quantile` is its sketch."""

    name: str
    fn: str | MergeableAgg
    field: str | None = None
    arg: float = 0.5

    @property
    def custom(self) -> MergeableAgg | None:
        return self.fn if isinstance(self.fn, MergeableAgg) else SKETCHES[self.fn](self.arg) if self.fn in SKETCHES else None

    def first(self) -> dict[str, Column]:
        c = F.col(self.field) if self.field else None
        if self.custom:
            return {f"{self.name}__part": self.custom.partial(c)}
        return {
            "count": lambda: {self.name: F.count(F.lit(1))},
            "sum": lambda: {self.name: F.sum(c)},
            "min": lambda: {self.name: F.min(c)},
            "max": lambda: {self.name: F.max(c)},
            "avg": lambda: {f"{self.name}__sum": F.sum(c), f"{self.name}__n": F.count(c)},
            "percentile": lambda: {self.name: F.percentile(c, self.arg)},
        }[self.fn]()

    def merged(self) -> dict[str, Column]:
        if self.custom:
            return {f"{self.name}__part": self.custom.merge(F.col(f"{self.name}__part"))}
        if self.fn == "percentile":
            raise CheckError(f"{self.name}: percentile has no merge; it may only be computed in a chain of one step")
        if self.fn == "avg":
            return {f"{self.name}__sum": F.sum(f"{self.name}__sum"), f"{self.name}__n": F.sum(f"{self.name}__n")}
        return {self.name: {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[self.fn](self.name)}

    def read(self) -> Column:
        if self.custom:
            return self.custom.finish(F.col(f"{self.name}__part"))
        return F.col(f"{self.name}__sum") / F.col(f"{self.name}__n") if self.fn == "avg" else F.col(self.name)


@dataclass(frozen=True)
class Template:
    groups: tuple[str, ...]
    measures: tuple[Measure, ...]
    time: str = "created_at"

    def bucket(self, grain: str, column: str) -> Column:
        return F.date_trunc(grain, column).cast("timestamp_ntz").alias("bucket_start")

    def level(self, raw: DataFrame, grain: str) -> DataFrame:
        aggs = {n: c for m in self.measures for n, c in m.first().items()}
        return raw.groupBy(self.bucket(grain, self.time), *self.groups).agg(*[c.alias(n) for n, c in aggs.items()])

    def coarser(self, level: DataFrame, grain: str) -> DataFrame:
        aggs = {n: c for m in self.measures for n, c in m.merged().items()}
        return level.groupBy(self.bucket(grain, "bucket_start"), *self.groups).agg(*[c.alias(n) for n, c in aggs.items()])

    def read(self, level: DataFrame) -> DataFrame:
        return level.select("bucket_start", *self.groups, *[c for c in ("grain",) if c in level.columns], *[m.read().alias(m.name) for m in self.measures])


@dataclass(frozen=True)
class Step:
    """Rows at `grain` (None: raw) for `ttl`, an SQL interval; None keeps them forever, "drop" ends the chain."""

    grain: str | None
    ttl: str | None


def check_chain(template: Template, steps: list[Step]) -> None:
    """Raise unless the chain starts raw, strictly coarsens, ends in forever or drop, and can be merged."""
    if not steps or steps[0].grain is not None:
        raise CheckError("a chain starts with raw rows: its first step has no grain")
    grains = [GRAINS.index(s.grain) for s in steps[1:] if s.grain is not None]
    if any(a >= b for a, b in zip(grains, grains[1:], strict=False)):
        raise CheckError("each step's grain must be coarser than the one before")
    if steps[-1].ttl not in (None, "drop") or any(s.ttl in (None, "drop") for s in steps[:-1]):
        raise CheckError("a chain ends, and only ends, in forever or drop")
    days = {"minute": 1 / 1440, "hour": 1 / 24, "day": 1, "week": 7, "month": 31, "quarter": 92, "year": 366}
    for s, nxt in zip(steps, steps[1:], strict=False):
        if nxt.grain and _days(s.ttl) < days[nxt.grain]:
            raise CheckError(f"rows kept for {s.ttl} do not cover one {nxt.grain}")
    if len(grains) > 1:
        for m in template.measures:
            m.merged()


def _days(ttl: str) -> float:
    n, unit = ttl.split()
    return float(n) * {"minute": 1 / 1440, "hour": 1 / 24, "day": 1, "week": 7, "month": 31, "year": 366}[unit.rstrip("s")]


def _cut(moment: str, ttl: str, grain: str) -> Column:
    """Start of the bucket of `grain` in which rows of that age end: what begins before it has moved on."""
    return F.date_trunc(grain, F.expr(f"timestamp_ntz'{moment}' - interval '{ttl.split()[0]}' {ttl.split()[1].rstrip('s')}")).cast("timestamp_ntz")


def run_chain(raw: DataFrame, template: Template, steps: list[Step], moment: str) -> dict[str, DataFrame]:
    """Levels by grain ("raw" first) as they stand at `moment`, over disjoint ages.

    A row moves on when the bucket of the next grain that holds it is complete and past its time.
    Each level is computed from the one before; the results are lazy and recompute idempotently.
    """
    check_chain(template, steps)
    out, level, source = {}, raw, template.time
    for s, nxt in zip(steps, [*steps[1:], None], strict=True):
        name = s.grain or "raw"
        if s.ttl in (None, "drop") or nxt is None:
            out[name] = level
            break
        edge = _cut(moment, s.ttl, nxt.grain or s.grain or "day")
        out[name] = level.where(F.col(source) >= edge)
        old = level.where(F.col(source) < edge)
        if nxt.grain is None or nxt.ttl == "drop":
            break
        level = template.level(old, nxt.grain) if s.grain is None else template.coarser(old, nxt.grain)
        source = "bucket_start"
    return out


def union_view(levels: dict[str, DataFrame]) -> DataFrame:
    """All levels past raw with their grain; a filter on grain selects one level's plan."""
    parts = [df.withColumn("grain", F.lit(g)) for g, df in levels.items() if g != "raw"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def branches(raw: DataFrame, conditions: list[Column]) -> list[DataFrame]:
    """Disjoint parts: rows of the first condition that holds, and last those of none."""
    out, before = [], F.lit(True)
    for c in conditions:
        hit = F.coalesce(c, F.lit(False))
        out.append(raw.where(before & hit))
        before = before & ~hit
    return [*out, raw.where(before)]


def with_gaps(level: DataFrame, grain: str, first: str, last: str, covered_from: str, measures: list[str]) -> DataFrame:
    """Every bucket from `first` to `last`: real zeros where covered, the absence NotRetained before."""
    spine = level.sparkSession.sql(f"select explode(sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', interval 1 {grain})) as bucket_start")
    tag = F.when(F.col("bucket_start") < F.expr(f"timestamp_ntz'{covered_from}'"), F.lit("NotRetained")).otherwise(F.lit("Value"))
    out = spine.join(level, "bucket_start", "left").withColumn("tag", tag)
    return out.withColumns({m: F.when(F.col("tag") == "Value", F.coalesce(m, F.lit(0))) for m in measures})


def catch_up(level: DataFrame, fresh: DataFrame, template: Template) -> DataFrame:
    """`level` with the buckets that `fresh` has computed anew; doing it twice changes nothing."""
    key = ["bucket_start", *template.groups]
    return level.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def roll_over(raw: DataFrame, level: DataFrame, template: Template, grain: str, before: str, seq: str = "tx_seq") -> tuple[DataFrame, DataFrame]:
    """The two appends of a rollup: rows of the level from what is older than `before`, then the record that prunes those rows.

    The record names the stretch of transactions that it drops. Until it is written the raw rows
    are still there, and writing the first append twice changes nothing, so a crash in between loses nothing.
    """
    old = raw.where(F.col(template.time) < F.lit(before).cast("timestamp_ntz"))
    rows = template.level(old, grain)
    record = old.agg(
        F.lit(grain).alias("grain"),
        F.min(seq).alias("first_seq"),
        F.max(seq).alias("last_seq"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(before).cast("timestamp_ntz").alias("pruned_before"),
    )
    return catch_up(level, rows, template), record


def pruned(raw: DataFrame, records: DataFrame, time: str) -> DataFrame:
    """What is left of raw rows once the records' prunes are applied; the records are a handful, their latest edge is one value."""
    edge = records.agg(F.max("pruned_before").alias("__edge"))
    return raw.join(F.broadcast(edge)).where(F.col("__edge").isNull() | (F.col(time) >= F.col("__edge"))).drop("__edge")


def policy_edit(template: Template, old: list[Step], new: list[Step], raw: DataFrame, moment: str) -> dict[str, object]:
    """What changing a chain would do: what it loses and how many rows that touches."""
    check_chain(template, new)
    ages = lambda steps: {s.grain or "raw": s.ttl for s in steps}
    a, b = ages(old), ages(new)
    shorter = [g for g in a if g not in b or (b[g] is not None and (a[g] is None or b[g] != "drop" and a[g] != "drop" and _days(b[g]) < _days(a[g])))]
    lost = raw.where(F.col(template.time) < _cut(moment, b["raw"], new[1].grain or "day")).count() if "raw" in shorter and b.get("raw") else 0
    return {"shortened": shorter, "added": [g for g in b if g not in a], "raw_rows_moved": lost}
