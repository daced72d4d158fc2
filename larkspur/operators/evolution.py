"""Schema evolution as projections: reading old rows, splitting, merging, renaming variants, unknown codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_as(df: DataFrame, fields: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """`df` under a newer schema: a field that it lacks reads as its default, else as NotFound (tag column)."""
    defaults = defaults or {}
    out = []
    for name, kind in fields.items():
        if name in df.columns:
            out.append(F.col(name).cast(kind).alias(name))
        else:
            out += [F.lit(defaults.get(name)).cast(kind).alias(name), F.lit("Value" if name in defaults else "NotFound").alias(f"{name}__tag")]
    return df.select(*out)


def split_table(df: DataFrame, key: str, **targets: list[str]) -> dict[str, DataFrame]:
    return {name: df.select(key, *columns) for name, columns in targets.items()}


def merge_tables(key: str, first: DataFrame, *rest: DataFrame) -> DataFrame:
    out = first
    for r in rest:
        out = out.join(r, key)
    return out


def shrink_variant(column: Column, moves: dict[str, str]) -> Column:
    """Variants that go are migrated to those that stay."""
    out = column
    for old, new in moves.items():
        out = F.when(column == old, F.lit(new)).otherwise(out)
    return out


def unknown_codes(rows: DataFrame, field: str, reference: DataFrame, code: str) -> DataFrame:
    """Codes that the reference table lacks, with their number of rows."""
    return rows.join(reference.select(F.col(code).alias("__c")), F.col(field) == F.col("__c"), "left_anti").groupBy(field).agg(F.count(F.lit(1)).alias("n"))


def auto_extend(rows: DataFrame, field: str, reference: DataFrame, code: str, extensible: bool, connector: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(reference with new codes, violations): unknown codes extend an Extensible table, at most `most` of a batch, else they are violations.

    The codes that extend are those of most rows; each row of the reference that is added says who added it.
    """
    new = unknown_codes(rows, field, reference, code)
    if not extensible:
        return reference, new.select(F.col(field).alias("observed"), "n")
    first = new.where(F.col(field).isNotNull()).orderBy(F.desc("n"), field).limit(most)
    grown = reference.unionByName(first.select(F.col(field).alias(code), F.lit(connector).alias("added_by")), allowMissingColumns=True)
    return grown, new.join(first.select(field), field, "left_anti").select(F.col(field).alias("observed"), "n")
