"""Reading SQLite files: their catalogs, and their rows as raw cells.

Three Python data sources, all read in parallel with read-only connections made inside the tasks:

``sqlite_catalog``  option ``kind``: ``columns`` or ``indexes`` of every file
``sqlite_raw``      option ``table``: that table's rows over all files, every column a cell struct
``sqlite_counts``   option ``table``: how many rows it has

``path`` is a file, a directory of files, or a glob, on storage that every executor sees.  Files must not change
while they are read.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql import types as T

from typeloom.functions.cells import CELL
from typeloom.functions.lexical import quoted
from typeloom.sources.sqlite_connect import connect, list_files, table_columns
from typeloom.sources.sqlite_cuts import Cuts, Share, pack_conditions, plan_cuts, unpack_conditions, unpack_shares
from typeloom.sources.sqlite_filters import Condition, translated

# Names with this prefix are the file format's own; matched as it stands, so sqlitedata is a user table.
_USER_OBJECT = "lower(substr(name, 1, 7)) <> 'sqlite_'"
# One Arrow batch holds about this much, and never more rows than this.
BATCH_BYTES, BATCH_ROWS = 16 * 1024 * 1024, 16384
SPLIT_BYTES = 128 * 1024 * 1024


def _user_tables(connection: sqlite3.Connection) -> list[str]:
    query = f"SELECT name FROM sqlite_master WHERE type = 'table' AND {_USER_OBJECT} ORDER BY name"
    return [name for (name,) in connection.execute(query)]


def _column_rows(file: str, connection: sqlite3.Connection) -> Iterator[tuple]:
    for table in _user_tables(connection):
        for cid, name, decl, not_null, default, pk in table_columns(connection, table):
            yield file, table, cid, name, decl or "", bool(not_null), pk != 0, default


def _index_rows(file: str, connection: sqlite3.Connection) -> Iterator[tuple]:
    query = (
        "SELECT name, tbl_name FROM sqlite_master "
        f"WHERE type = 'index' AND sql IS NOT NULL AND {_USER_OBJECT} ORDER BY name"
    )
    for index, table in connection.execute(query).fetchall():
        members = connection.execute(f"PRAGMA index_info({quoted(index)})").fetchall()
        columns = [name for _, _, name in sorted(members) if name is not None]
        listed = connection.execute(f"PRAGMA index_list({quoted(table)})").fetchall()
        unique = any(row[1] == index and row[2] for row in listed)
        if columns:
            yield file, index, table, unique, columns


_CATALOGS = {
    "columns": (
        "file string, table string, cid int, name string, decl string, not_null boolean, pk boolean, default string",
        _column_rows,
    ),
    "indexes": ("file string, index string, table string, unique boolean, columns array<string>", _index_rows),
}


@dataclass
class FileGroup(InputPartition):
    """Files read by one task."""

    files: list[str]


class SqliteCatalogSource(DataSource):
    """Catalog rows of SQLite files."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_catalog"

    def schema(self) -> str:
        return _CATALOGS[self.options.get("kind", "columns")][0]

    def reader(self, schema: T.StructType) -> "SqliteCatalogReader":
        return SqliteCatalogReader(self.options)


class SqliteCatalogReader(DataSourceReader):
    """One task per file, or per group of files when there are very many."""

    def __init__(self, options) -> None:
        self.path = options["path"]
        self.kind = options.get("kind", "columns")
        self.max_tasks = int(options.get("max_tasks", "10000"))

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.path)
        tasks = min(self.max_tasks, len(files))
        return [FileGroup(files[n::tasks]) for n in range(tasks)]

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        for file in partition.files:
            with closing(connect(file)) as connection:
                yield from _CATALOGS[self.kind][1](file, connection)


def _catalog(spark: SparkSession, path: str, kind: str) -> DataFrame:
    spark.dataSource.register(SqliteCatalogSource)
    return spark.read.format("sqlite_catalog").option("kind", kind).load(path)


def sqlite_columns(spark: SparkSession, path: str) -> DataFrame:
    """``(file, table, cid, name, decl, not_null, pk, default)`` of every user table of every file."""
    return _catalog(spark, path, "columns")


def sqlite_indexes(spark: SparkSession, path: str) -> DataFrame:
    """``(file, index, table, unique, columns)`` of every index made by a statement, on columns."""
    return _catalog(spark, path, "indexes")


# --- rows ---------------------------------------------------------------------------------------------------

@dataclass
class Scan(InputPartition):
    """One task's share: whole files, or some conditions on a single large one."""

    files: list[str]
    conditions: list[Condition] | None = None


def chosen_files(options) -> list[str]:
    """The files that the options name one by one, or all of their path."""
    return json.loads(options["files"]) if "files" in options else list_files(options["path"])


def _without_plan(options) -> dict[str, str]:
    """Options as tasks get them: each has its share, and what lists all shares would grow with their number in every one."""
    return {name: value for name, value in options.items() if name not in ("cuts", "files")}


class SqliteRawSource(DataSource):
    """Rows of one table as cells, from every file that has the table.

    Options: ``table``; ``columns`` (a JSON list, default all); ``split_bytes`` (what one task reads, about); ``files``
    (a JSON list of the files to read, default all of ``path``); ``cuts`` (shares as :func:`plan_cuts` makes them, larger
    than ``split_bytes`` where there would be very many; without them large files are not cut); ``where`` (conditions on rows); ``push`` (whether to
    take a query's filters).
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_raw"

    def _columns(self) -> list[str]:
        if "columns" in self.options:
            return json.loads(self.options["columns"])
        for file in chosen_files(self.options):
            with closing(connect(file)) as connection:
                names = [row[1] for row in table_columns(connection, self.options["table"])]
            if names:
                return names
        raise ValueError(f"no table {self.options['table']!r} in {self.options['path']!r}")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(name, CELL) for name in self._columns()])

    def reader(self, schema: T.StructType) -> "SqliteRawReader":
        kind = SqlitePushingReader if self.options.get("push") == "true" else SqliteRawReader
        reader = kind(self.options, schema.fieldNames())
        # From here on Spark sends the source along with the reader.
        self.options = _without_plan(self.options)
        return reader


class SqliteRawReader(DataSourceReader):
    """Reads shares that were planned, small ones in groups; whole files where nothing was planned."""

    def __init__(self, options, columns: list[str]) -> None:
        self.options, self.table, self.columns = dict(options), options["table"], columns
        self.split_bytes = int(options.get("split_bytes", str(SPLIT_BYTES)))
        self.filters = list(unpack_conditions(options.get("where", "[]")))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "options": _without_plan(self.options)}

    def partitions(self) -> list[InputPartition]:
        if "cuts" in self.options:
            shares = unpack_shares(self.options["cuts"])
        else:
            shares = [Share(file, None, os.path.getsize(file)) for file in chosen_files(self.options)]
        scans: list[Scan] = []
        held = 0
        for share in shares:
            last = scans[-1] if scans else None
            fits = last is not None and held + share.bytes <= self.split_bytes
            if share.conditions is None:
                if fits and last.conditions is None:
                    last.files.append(share.file)
                    held += share.bytes
                    continue
                scans.append(Scan([share.file]))
            elif fits and last.conditions is not None and last.files == [share.file]:
                last.conditions.extend(share.conditions)
                held += share.bytes
                continue
            else:
                scans.append(Scan([share.file], list(share.conditions)))
            held = share.bytes
        return scans or [Scan([])]

    def read(self, partition: Scan) -> Iterator[pa.RecordBatch]:
        listed = ", ".join(quoted(c) for c in self.columns)
        for cursor, _ in self._cursors(partition, listed):
            yield from self._batches(cursor)

    def _cursors(self, partition: Scan, selected: str) -> Iterator[tuple[sqlite3.Cursor, str]]:
        """A cursor over each part of the share, with the part's file; files without the table have none."""
        for file in partition.files:
            with closing(connect(file)) as connection:
                known = {row[1] for row in table_columns(connection, self.table)}
                if not known:
                    continue
                missing = [c for c in self.columns if c not in known]
                if missing:
                    raise ValueError(f"table {self.table!r} of {file!r} lacks columns {missing}")
                query = f"SELECT {selected} FROM {quoted(self.table)}"
                for condition in [Condition("1")] if partition.conditions is None else partition.conditions:
                    tests = [condition, *self.filters]
                    kept = " AND ".join(f"({t.sql})" for t in tests)
                    yield connection.execute(f"{query} WHERE {kept}", tuple(b for t in tests for b in t.bound)), file

    def _batches(self, cursor: sqlite3.Cursor) -> Iterator[pa.RecordBatch]:
        """Batches that close as soon as they hold enough bytes, so that none is larger by more than one row."""
        rows, held = [], 0
        for row in cursor:
            rows.append(row)
            held += 16 * len(row) + sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if held >= BATCH_BYTES or len(rows) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([cell_array(values) for values in zip(*rows)], self.columns)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([cell_array(values) for values in zip(*rows)], self.columns)


class SqlitePushingReader(SqliteRawReader):
    """Also takes the filters of the query that reads it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for filter in filters:
            condition = translated(filter)
            if condition is None:
                yield filter
            else:
                self.filters.append(condition)


class SqliteCountSource(DataSource):
    """Row counts of one table, per file and share.  Options as for ``sqlite_raw``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_counts"

    def schema(self) -> str:
        return "file string, rows bigint"

    def reader(self, schema: T.StructType) -> "SqliteCountReader":
        reader = SqliteCountReader(self.options, [])
        self.options = _without_plan(self.options)
        return reader


class SqliteCountReader(SqliteRawReader):
    """Counts where :class:`SqliteRawReader` would read, in the same shares."""

    def read(self, partition: Scan) -> Iterator[tuple]:
        for cursor, file in self._cursors(partition, "count(*)"):
            yield file, cursor.fetchone()[0]


_CLASS_OF = {type(None): "null", int: "integer", float: "real", str: "text", bytes: "blob"}
_FIELDS = (("i", int, pa.int64()), ("r", float, pa.float64()), ("t", str, pa.string()), ("b", bytes, pa.binary()))
_CELL_NAMES = ["k", *[name for name, _, _ in _FIELDS]]


def cell_array(values: tuple) -> pa.StructArray:
    """Cells of the values of one column."""
    present = set(map(type, values)) - {type(None)}
    if len(present) <= 1:
        return _uniform_cells(values, present.pop() if present else None)
    types = [type(v) for v in values]
    fields = [pa.array([_CLASS_OF[t] for t in types], pa.string())]
    for _, cls, arrow in _FIELDS:
        if cls in present:
            fields.append(pa.array([v if t is cls else None for v, t in zip(values, types)], arrow))
        else:
            fields.append(pa.nulls(len(values), arrow))
    return pa.StructArray.from_arrays(fields, _CELL_NAMES)


def _uniform_cells(values: tuple, only: type | None) -> pa.StructArray:
    """Cells of values that are all of one class or NULL."""
    payload = {cls: pa.nulls(len(values), arrow) for _, cls, arrow in _FIELDS}
    classes = pa.repeat("null", len(values))
    if only is not None:
        payload[only] = pa.array(values, payload[only].type)
        held = pa.repeat(_CLASS_OF[only], len(values))
        classes = pc.if_else(payload[only].is_null(), classes, held) if payload[only].null_count else held
    return pa.StructArray.from_arrays([classes, *payload.values()], _CELL_NAMES)


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def planned(
    spark: SparkSession,
    path: str,
    table: str,
    split_bytes: int = SPLIT_BYTES,
    files: list[str] | None = None,
    columns: list[str] | None = None,
) -> Cuts:
    """The shares of a table.  Files that need no cut, of a table whose columns are known, are not opened for it."""
    names = list_files(path) if files is None else files
    sizes = [os.path.getsize(name) for name in names]
    if columns is not None and max(sizes, default=0) <= split_bytes:
        return Cuts(columns, [Share(name, None, size) for name, size in zip(names, sizes)])
    found = plan_cuts(spark, {table: names}, split_bytes).get(table, Cuts([], []))
    return Cuts(found.columns if columns is None else columns, found.shares)


def read_cells(
    spark: SparkSession,
    path: str,
    table: str,
    columns: list[str] | None = None,
    split_bytes: int = SPLIT_BYTES,
    files: list[str] | None = None,
    cuts: Cuts | None = None,
    where: Sequence[Filter] = (),
    push: bool = False,
) -> DataFrame:
    """The rows of a table over all files of ``path``, or some ``files`` of it, every column a cell struct.

    Large files are cut by a Spark job that runs at once; ``cuts`` that were made before save it.

    SQLite evaluates filters on the class and the payload fields of a cell, through its indexes where it has some, if
    their outcome is certain to be Spark's.  ``where`` names filters that all rows must pass, such as
    ``EqualTo(("id", "i"), 7)``; one that Spark would have to evaluate is refused.  With ``push`` Spark hands over the
    filters of the query itself, and evaluates the others.  Spark keeps only one set of them for each frame read, so such
    a frame must not be filtered in two ways within one query: read it twice then.  ``push`` turns on filters of Python
    sources in the session.
    """
    spark.dataSource.register(SqliteRawSource)
    tests = [translated(filter) for filter in where]
    if None in tests:
        raise ValueError(f"SQLite cannot evaluate {[f for f, t in zip(where, tests) if t is None]}")
    if push:
        spark.conf.set(PUSHDOWN, "true")
    cuts = cuts or planned(spark, path, table, split_bytes, files, columns)
    columns = cuts.columns if columns is None else columns
    if not columns:
        raise ValueError(f"no table {table!r} in {path!r}")
    reader = spark.read.format("sqlite_raw").option("table", table).option("split_bytes", split_bytes)
    reader = reader.option("columns", json.dumps(columns)).option("cuts", cuts.packed())
    return reader.option("where", pack_conditions(tests)).option("push", str(push).lower()).load(path)


def sqlite_counts(
    spark: SparkSession,
    path: str,
    table: str,
    split_bytes: int = SPLIT_BYTES,
    files: list[str] | None = None,
    cuts: Cuts | None = None,
) -> DataFrame:
    """``(file, rows)`` of a table; a large file has a row per condition of its shares."""
    spark.dataSource.register(SqliteCountSource)
    cuts = cuts or planned(spark, path, table, split_bytes, files, [])
    reader = spark.read.format("sqlite_counts").option("table", table).option("split_bytes", split_bytes)
    return reader.option("cuts", cuts.packed()).load(path)
