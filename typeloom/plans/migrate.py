"""The migration run: SQLite files in, typed parquet tables, rejects and a report out."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions.types import map_declared_types
from typeloom.operators.audit import reconcile
from typeloom.operators.catalog import create_index_ddl, create_table_ddl, dropped_defaults
from typeloom.operators.coerce import ERRORS, REJECTED, check_types, failing
from typeloom.sources.folders import drop_folder, path_exists, swap_folders
from typeloom.sources.sqlite_cuts import Cuts, plan_cuts
from typeloom.sources.sqlite_files import SPLIT_BYTES, read_cells, sqlite_columns, sqlite_counts, sqlite_indexes
from typeloom.sources.tables import write_table

REPORT_TYPE = (
    "table string, source_rows bigint, loaded_rows bigint, rejected_rows bigint, ok boolean, columns int, "
    "indexes int, warnings array<string>, ddl string, index_ddl array<string>"
)


#: What a migration leaves in its folder.
FOLDERS = ("tables", "rejects", "report")


@dataclass(frozen=True)
class MigrateOptions:
    """``on_error``: ``reject`` keeps bad rows apart, ``fail`` stops at the first.  ``sort``: lay each table out
    by its key, or its first index, as a stand-in for the index.  ``tables_at_once``: small tables would leave
    most of a cluster idle one by one.  ``mode``: ``errorifexists`` refuses a folder that holds a migration,
    ``overwrite`` replaces it whole, once all is loaded."""

    on_error: str = "reject"
    create_indexes: bool = True
    sort: bool = True
    epoch_unit: str | None = None
    split_bytes: int = SPLIT_BYTES
    tables_at_once: int = 4
    mode: str = "errorifexists"


@dataclass(frozen=True)
class _Table:
    name: str
    types: dict[str, str]
    keys: list[str]
    files: list[str]


@dataclass(frozen=True)
class _Loaded:
    source_rows: int
    good: DataFrame
    rejects: DataFrame


def _once(rows: DataFrame, what: str, *identity: str) -> DataFrame:
    """Catalog rows of many files, each once; files that declare one thing differently are an error."""
    distinct = rows.drop("file").distinct().select(F.lit("").alias("database"), "*").persist()
    clash = distinct.groupBy(*identity).count().filter("count > 1").select(identity[0]).distinct().collect()
    if clash:
        raise ValueError(f"files declare these {what} differently: {sorted(r[0] for r in clash)}")
    return distinct


def _plan(declared: DataFrame, held: DataFrame) -> list[_Table]:
    """Every table, with the files that hold it."""
    files = {r["table"]: sorted(r["files"]) for r in held.collect()}
    rows = map_declared_types(declared, "decl").orderBy("table", "cid").collect()
    tables: dict[str, _Table] = {}
    for row in rows:
        table = tables.setdefault(row["table"], _Table(row["table"], {}, [], files[row["table"]]))
        table.types[row["name"]] = row["native_type"]
        if row["pk"]:
            table.keys.append(row["name"])
    return list(tables.values())


def _load(
    spark: SparkSession, path: str, out: str, table: _Table, cuts: Cuts, sort_by: list[str], options: MigrateOptions
) -> _Loaded:
    """One scan of the source into a staged table; the loaded and rejected rows are written from there.

    Staging cuts the lineage at the slow scan: sorting samples its input, and a lost executor must not mean
    reading the source again.
    """
    cells = read_cells(spark, path, table.name, list(table.types), options.split_bytes, cuts=cuts)
    checked = check_types(cells, table.types, options.epoch_unit)
    if options.on_error == "fail":
        checked = failing(checked).withColumns({REJECTED: F.lit(False), ERRORS: F.lit(None).cast("string")})
    staged = f"{out}/_staged/{table.name}"
    schema = checked.schema
    checked.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(schema).parquet(staged)

    good, rejects = f"{out}/tables/{table.name}.parquet", f"{out}/rejects/{table.name}.parquet"
    write_table(rows.filter(~F.col(REJECTED)).drop(REJECTED, ERRORS), good, "overwrite", sort_by or None)
    write_table(rows.filter(REJECTED).drop(REJECTED), rejects, "overwrite")
    counted = sqlite_counts(spark, path, table.name, options.split_bytes, cuts=cuts).agg(F.sum("rows")).first()[0]
    return _Loaded(counted or 0, spark.read.parquet(good), spark.read.parquet(rejects))


def migrate(spark: SparkSession, path: str, out: str, options: MigrateOptions = MigrateOptions()) -> DataFrame:
    """Migrate every table of the SQLite files at ``path``; returns the report, one row per table.

    Files under one path hold parts of one database: a table's rows are read from all files.  Written are
    ``<out>/tables/<table>.parquet``, ``<out>/rejects/<table>.parquet`` and ``<out>/report``.

    All of it is written beside the result first and moved into place in the end; a run that fails leaves what was there.
    """
    if options.on_error not in ("reject", "fail"):
        raise ValueError(f"on_error must be reject or fail, not {options.on_error!r}")
    if options.mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode must be errorifexists or overwrite, not {options.mode!r}")
    columns = sqlite_columns(spark, path)
    declared = _once(columns, "tables", "table", "cid")
    tables = _plan(declared, columns.groupBy("table").agg(F.collect_set("file").alias("files")))
    if not tables:
        raise ValueError(f"no tables in {path!r}")

    index_rows, index_ddl = [], {}
    if options.create_indexes:
        indexes = _once(sqlite_indexes(spark, path), "indexes", "index")
        index_rows = indexes.orderBy("index").collect()
        index_ddl = {r["index"]: r["ddl"] for r in create_index_ddl(indexes).collect()}
        indexes.unpersist()
    by_table = {t.name: [r for r in index_rows if r["table"] == t.name] for t in tables}

    def load(table: _Table) -> _Loaded:
        indexed = by_table[table.name]
        sort_by = table.keys or (list(indexed[0]["columns"]) if indexed else [])
        return _load(spark, path, fresh, table, cuts[table.name], sort_by if options.sort else [], options)

    if options.mode != "overwrite" and any(path_exists(spark, f"{out}/{folder}") for folder in FOLDERS):
        raise FileExistsError(f"{out!r} holds a migration; mode overwrite would replace it")
    fresh, old = (f"{out}/_{kind}-{uuid.uuid4().hex}" for kind in ("loading", "replaced"))
    try:
        cuts = plan_cuts(spark, {t.name: t.files for t in tables}, options.split_bytes)
        with ThreadPoolExecutor(options.tables_at_once) as pool:
            loaded = dict(zip([t.name for t in tables], pool.map(load, tables)))
        result = _report(spark, tables, loaded, declared, by_table, index_ddl)
        result.coalesce(1).write.json(f"{fresh}/report")
        swap_folders(spark, out, fresh, old, FOLDERS)
    finally:
        drop_folder(spark, fresh)
        declared.unpersist()
    drop_folder(spark, old)
    return result


def _report(
    spark: SparkSession,
    tables: list[_Table],
    loaded: dict[str, _Loaded],
    declared: DataFrame,
    by_table: dict[str, list],
    index_ddl: dict[str, str],
) -> DataFrame:
    counts = reconcile({}, {t: x.good for t, x in loaded.items()}, {t: x.rejects for t, x in loaded.items()})
    outcome = {r["table"]: r for r in counts.collect()}
    ddl = {r["table"]: r["ddl"] for r in create_table_ddl(declared).collect()}
    warnings: dict[str, list[str]] = {}
    for row in dropped_defaults(declared).orderBy("table", "warning").collect():
        warnings.setdefault(row["table"], []).append(row["warning"])

    report = []
    for table in tables:
        name, source_rows = table.name, loaded[table.name].source_rows
        good, rejected = outcome[name]["loaded_rows"], outcome[name]["rejected_rows"]
        statements = [index_ddl[r["index"]] for r in by_table[name]]
        report.append(
            (name, source_rows, good, rejected, source_rows == good + rejected, len(table.types), len(statements),
             warnings.get(name, []), ddl[name], statements)
        )
    return spark.createDataFrame(report, REPORT_TYPE)
