"""Constraint audits and profiles.  Every group-by here pre-aggregates before its shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.cells import CELL, STORAGE_CLASSES, VALUE, VALUE_KINDS, is_struct_of
from typeloom.functions.lexical import named
from typeloom.functions.types import column_kind

PRIMARY_KEY, UNIQUE, NOT_NULL, FOREIGN_KEY = "PRIMARY KEY", "UNIQUE", "NOT NULL", "FOREIGN KEY"


@dataclass(frozen=True)
class Constraint:
    """A declared rule on a table; ``ref_*`` for foreign keys only."""

    table: str
    rule: str
    columns: tuple[str, ...]
    ref_table: str | None = None
    ref_columns: tuple[str, ...] = field(default=())


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(or_, [named(k).isNull() for k in keys])


def _require(keys: Sequence[str]) -> None:
    if not keys:
        raise ValueError("no key columns given")


def audit_primary_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or hold a NULL, with their row count ``n``."""
    _require(keys)
    counted = df.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") > 1) | _any_null(keys))


def audit_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; rows with a NULL in the key are exempt."""
    _require(columns)
    counted = (
        df.filter(~_any_null(columns))
        .groupBy(*[named(c) for c in columns])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.filter(F.col("n") > 1)


def _as_rows(df: DataFrame, counts: Sequence[tuple[tuple[str, ...], Column]], labels: Sequence[str]) -> DataFrame:
    """One global aggregation of many counts, turned into rows ``(labels..., n)``."""
    totals = df.agg(*[count.alias(f"n{i}") for i, (_, count) in enumerate(counts)])
    entries = [
        F.struct(*[F.lit(v).alias(name) for name, v in zip(labels, label)], F.col(f"n{i}").alias("n"))
        for i, (label, _) in enumerate(counts)
    ]
    return totals.select(F.inline(F.array(*entries)))


def audit_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows hold a NULL, for each listed column that has any."""
    _require(columns)
    counts = [((c,), F.count_if(named(c).isNull())) for c in columns]
    return _as_rows(df, counts, ["column"]).filter(F.col("n") > 0)


def audit_foreign_key(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, ref_columns: Sequence[str]
) -> DataFrame:
    """Child keys without a parent row, with their row count ``n``; rows with a NULL in the key are exempt.

    Both sides are cut to their distinct keys before the join, so a hot key is one row there.
    """
    _require(columns)
    used = (
        child.filter(~_any_null(columns))
        .groupBy(*[named(c) for c in columns])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    refs = [f"__ref_{i}" for i in range(len(ref_columns))]
    known = parent.select(*[named(c).alias(r) for c, r in zip(ref_columns, refs)]).distinct()
    match = reduce(and_, [named(c) == F.col(r) for c, r in zip(columns, refs)])
    return used.join(known, match, "left_anti")


def _tagged_counts(df: DataFrame, f: T.StructField) -> list[tuple[tuple[str, str], Column]]:
    column = named(f.name)
    if is_struct_of(f.dataType, CELL):
        tag, kinds = F.coalesce(column["k"], F.lit("null")), STORAGE_CLASSES
    elif is_struct_of(f.dataType, VALUE):
        tag, kinds = F.coalesce(column["kind"], F.lit("NULL")), VALUE_KINDS
    else:
        kind = column_kind(f) or f.dataType.simpleString().upper()
        tag, kinds = F.when(column.isNull(), "NULL").otherwise(kind), ("NULL", kind)
    return [((f.name, kind), F.count_if(tag == kind)) for kind in dict.fromkeys(kinds)]


def kind_profile(df: DataFrame) -> DataFrame:
    """How many cells of each kind every column holds: ``(column, kind, n)``, kinds that occur only."""
    counts = [entry for f in df.schema.fields for entry in _tagged_counts(df, f)]
    return _as_rows(df, counts, ["column", "kind"]).filter(F.col("n") > 0)


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count of every column: ``(column, n)``."""
    return _as_rows(df, [((c,), F.count_if(named(c).isNull())) for c in df.columns], ["column"])


def reconcile(
    source: Mapping[str, DataFrame], good: Mapping[str, DataFrame], rejects: Mapping[str, DataFrame]
) -> DataFrame:
    """Row counts per table: ``(table, source_rows, loaded_rows, rejected_rows, ok)``.

    ``ok`` when every source row is either loaded or rejected.
    """
    parts = []
    for role, frames in (("source_rows", source), ("loaded_rows", good), ("rejected_rows", rejects)):
        for table, frame in frames.items():
            counted = frame.agg(F.count(F.lit(1)).alias("n"))
            parts.append(counted.select(F.lit(table).alias("table"), F.lit(role).alias("role"), "n"))
    counts = reduce(DataFrame.unionByName, parts)

    def total(role: str) -> Column:
        return F.sum(F.when(F.col("role") == role, F.col("n")).otherwise(0)).alias(role)

    return (
        counts.groupBy("table")
        .agg(total("source_rows"), total("loaded_rows"), total("rejected_rows"))
        .withColumn("ok", F.col("source_rows") == F.col("loaded_rows") + F.col("rejected_rows"))
    )
