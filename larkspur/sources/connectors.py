"""Sources and sinks: tables, change logs, verification against an external snapshot, output formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import CheckError


def verify_state(ours: DataFrame, theirs: DataFrame, key: str, columns: list[str], settled: Column | None = None) -> DataFrame:
    """(key, difference) of rows that differ from an external snapshot, outside its latency window."""
    a = ours.select(F.col(key).alias("ka"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = theirs.select(F.col(key).alias("kb"), *[F.col(c).alias(f"b_{c}") for c in columns])
    both = a.join(b, F.col("ka") == F.col("kb"), "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    kind = F.when(F.col("kb").isNull(), "missing there").when(F.col("ka").isNull(), "missing here").when(~same, "differs")
    out = both.select(F.coalesce("ka", "kb").alias(key), kind.alias("difference")).where("difference is not null")
    return out if settled is None else out.where(settled)


def last_writer(versions: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The row with the latest time for each key; equal times go to the larger `tie`."""
    rest = [c for c in versions.columns if c != key]
    best = versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("v"))
    return best.select(key, "v.*")


def resolve(
    ours: DataFrame,
    theirs: DataFrame,
    key: str,
    fields: list[str],
    seq: str,
    time: str,
    semantic: dict[str, Column] | None = None,
    authority: str | None = None,
) -> DataFrame:
    """(key, fields..., resolution) of rows that both sides have changed, by the first rule that decides.

    Equal rows need none; `semantic` merges single fields (columns over o_<field> and t_<field>);
    a side whose sequence has seen the other's is a continuation and wins; then the authority, if
    one is declared; then the later writer; what is still open is left to a person with our values.
    """
    a = ours.select(F.col(key), *[F.col(c).alias(f"o_{c}") for c in (*fields, seq, time)])
    b = theirs.select(F.col(key), *[F.col(c).alias(f"t_{c}") for c in (*fields, seq, time)])
    both = a.join(b, key)
    same = F.lit(True)
    for c in fields:
        if c not in (semantic or {}):
            same = same & F.col(f"o_{c}").eqNullSafe(F.col(f"t_{c}"))
    ahead, behind = F.startswith(F.col(f"o_{seq}"), F.col(f"t_{seq}")), F.startswith(F.col(f"t_{seq}"), F.col(f"o_{seq}"))
    how = F.when(same, F.lit("semantic" if semantic else "equal")).when(ahead, "ours by sequence").when(behind, "theirs by sequence")
    if authority is not None:
        how = how.otherwise(F.lit(f"{authority} by authority"))
    else:
        how = how.when(F.col(f"o_{time}") > F.col(f"t_{time}"), "ours by time").when(F.col(f"o_{time}") < F.col(f"t_{time}"), "theirs by time").otherwise("manual")
    out = both.withColumn("resolution", how)
    theirs_win = F.startswith("resolution", F.lit("theirs"))
    value = lambda c: semantic[c] if semantic and c in semantic else F.when(theirs_win, F.col(f"t_{c}")).otherwise(F.col(f"o_{c}"))
    return out.select(key, *[value(c).alias(c) for c in fields], "resolution")


def export_log(log: DataFrame, path: str, at_seq: int) -> None:
    """Write the log up to a transaction; a folder that exists is refused."""
    log.where(F.col("tx_seq") <= at_seq).write.mode("error").json(path)


def import_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _flat(fields, prefix: str = "") -> list[tuple[str, str]]:
    """(column path, dotted name) of all leaves of a schema."""
    out = []
    for f in fields:
        path = f"{prefix}`{f.name}`"
        out += _flat(f.dataType.fields, f"{path}.") if hasattr(f.dataType, "fields") else [(path, path.replace("`", ""))]
    return out


def rendered(df: DataFrame, fmt: str) -> DataFrame:
    """A result as one column `line` of text, in parallel: json, json-flat, graphql, csv or raw (tab-separated)."""
    if fmt == "json":
        line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    elif fmt == "json-flat":  # nested fields under dotted names
        line = F.to_json(F.struct(*[F.col(p).alias(n) for p, n in _flat(df.schema.fields)]), {"ignoreNullFields": "false"})
    elif fmt == "graphql":
        line = F.to_json(F.struct(F.struct(F.struct(*df.columns).alias("node")).alias("data")), {"ignoreNullFields": "false"})
    elif fmt == "csv":
        line = F.to_csv(F.struct(*df.columns))
    elif fmt == "raw":
        line = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    else:
        raise CheckError(f"unknown format {fmt}")
    return df.select(line.alias("line"))


def render(df: DataFrame, fmt: str, limit: int | None = None) -> list[str]:
    """A result as text lines for a terminal; all of it, or its first `limit` rows."""
    df = df if limit is None else df.limit(limit)
    if fmt != "table":
        head = [",".join(df.columns)] if fmt == "csv" else []
        return head + [r[0] for r in rendered(df, fmt).toLocalIterator()]
    rows = [["" if v is None else str(v) for v in r] for r in df.collect()]
    widths = [max(len(x) for x in col) for col in zip(df.columns, *rows, strict=True)]
    return [" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in [df.columns, *rows]]
