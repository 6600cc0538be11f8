"""Parquet tables: opening a directory of them, and writing one with a layout for lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.lexical import named
from typeloom.sources.folders import entry_names
from typeloom.sources.zorder import zordered_layout

SUFFIX = ".parquet"
#: What a file of a given number of files holds at most, about, as rows in memory: one task sorts it.
FILE_BYTES = 256 * 1024 * 1024


def open_catalog(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """Every parquet table of a directory, also registered as a temporary view of its name.

    A missing directory is an error.
    """
    tables = {}
    for name in entry_names(spark, directory):
        if name.endswith(SUFFIX):
            table = name.removesuffix(SUFFIX)
            tables[table] = spark.read.parquet(f"{directory}/{name}")
            tables[table].createOrReplaceTempView(table)
    return tables


def sorted_layout(df: DataFrame, keys: Sequence[str], files: int | None = None) -> DataFrame:
    """Range-partition and sort by ``keys``, so that file and row-group statistics serve key lookups.

    The input partition is a last range column: it cuts the rows of one hot key, copies included, into as many
    pieces as they came in, and stays the same when a lost task is run again.
    """
    salted = df.withColumn("__slice", F.spark_partition_id())
    by = [named(k) for k in keys]
    ranged = (
        salted.repartitionByRange(files, *by, "__slice") if files else salted.repartitionByRange(*by, "__slice")
    )
    return ranged.sortWithinPartitions(*by).drop("__slice")


def enough_files(df: DataFrame, files: int) -> int:
    """``files``, or as many more as keep each below about :data:`FILE_BYTES`."""
    wide = F.lit(8 * (len(df.columns) + 4)).cast("long")
    for field in df.schema.fields:
        column = named(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = column.cast("string")
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            continue
        wide = wide + F.coalesce(F.octet_length(column), F.lit(0))
    total = df.agg(F.sum(wide)).first()[0] or 0
    return max(files, -(-total // FILE_BYTES))


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    sort_by: Sequence[str] | None = None,
    files: int | None = None,
    max_rows_per_file: int = 0,
    zorder_by: Sequence[str] | None = None,
) -> None:
    """Write one parquet table; committed as a whole or not at all.

    ``sort_by`` stands in for an index, ``zorder_by`` for one on each of its columns.  A layout in ``files`` gets more of
    them where so few would be too large for a task to sort.
    """
    if sort_by and zorder_by:
        raise ValueError("a table has one layout: sort_by or zorder_by")
    if files and (sort_by or zorder_by):
        files = enough_files(df, files)
    laid_out = sorted_layout(df, sort_by, files) if sort_by else zordered_layout(df, zorder_by, files) if zorder_by else df
    laid_out.write.mode(mode).option("maxRecordsPerFile", max_rows_per_file).parquet(path)


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, mode: str = "errorifexists") -> None:
    """Save a catalog table bucketed and sorted by ``keys``: joins on them then need no shuffle.

    Rows are first brought together by bucket, so that a bucket is one file; the rebalancing cuts the bucket of
    a hot key into several.
    """
    together = df.hint("rebalance", buckets, *[named(k) for k in keys])
    together.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
