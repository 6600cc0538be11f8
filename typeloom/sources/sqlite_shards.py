"""Writing a table as a directory of SQLite files, one per task."""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from typeloom.functions import types as N
from typeloom.functions.lexical import named, quoted
from typeloom.functions.render import display_text
from typeloom.operators.audit import PRIMARY_KEY, Constraint
from typeloom.sources.sqlite_connect import local_path

SHARD_SUFFIX = ".sqlite"
_STAGED = "_staged-"


def affinity_of(native_type: str) -> str:
    """The storage affinity of a native type known on the driver (the rule table of ``sqlite_affinity``)."""
    for label, words in N.AFFINITY_WORDS:
        if any(word in native_type for word in words):
            return label
    return "TEXT"


def storage_column(column: Column, field: T.StructField) -> Column:
    """A column as it is stored: integers, doubles and blobs as such, booleans as 0 and 1, the rest as text."""
    kind = N.column_kind(field)
    if kind in (N.INT64, N.BOOL):
        return column.cast("bigint")
    if kind == N.FLOAT64:
        return column.cast("double")
    if kind in (N.BLOB, "GEOMETRY", "GEOGRAPHY"):
        return column
    return display_text(column, field)


def table_ddl(schema: T.StructType, table: str, keys: Sequence[str]) -> str:
    """``CREATE TABLE`` text with affinities; NOT NULL and the key are kept."""
    definitions = []
    for field in schema.fields:
        text = f"{quoted(field.name)} {affinity_of(N.native_type_of(field))}"
        if list(keys) == [field.name]:
            text += " PRIMARY KEY"
        elif not field.nullable:
            text += " NOT NULL"
        definitions.append(text)
    if len(keys) > 1:
        definitions.append(f"PRIMARY KEY ({', '.join(quoted(k) for k in keys)})")
    return f"CREATE TABLE {quoted(table)} ({', '.join(definitions)})"


@dataclass
class Shard(WriterCommitMessage):
    staged: str | None
    rows: int


class SqliteShardsSource(DataSource):
    """Options: ``path``, ``table``, and ``ddl``, the statements that make the table in each file."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_shards"

    def writer(self, schema: T.StructType, overwrite: bool) -> "SqliteShardsWriter":
        return SqliteShardsWriter(self.options, schema, overwrite)


class SqliteShardsWriter(DataSourceArrowWriter):
    """Each task fills a hidden file of its own; the commit gives the files of the successful tasks their names.

    A task that is run again, or twice, therefore leaves nothing behind in the result.
    """

    def __init__(self, options, schema: T.StructType, overwrite: bool) -> None:
        self.folder, self.table = local_path(options["path"]), options["table"]
        self.ddl = options.get("ddl") or table_ddl(schema, self.table, json.loads(options.get("keys", "[]")))
        self.width, self.overwrite, self.run = len(schema), overwrite, uuid.uuid4().hex
        os.makedirs(self.folder, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        staged, connection, rows = None, None, 0
        insert = f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * self.width)})"
        for batch in iterator:
            if not batch.num_rows:
                continue
            if connection is None:
                staged = os.path.join(self.folder, f"{_STAGED}{self.run}-{uuid.uuid4().hex}")
                connection = self._open(staged)
            connection.executemany(insert, zip(*[_stored(column) for column in batch.columns]))
            rows += batch.num_rows
        if connection is not None:
            connection.commit()
            connection.close()
        return Shard(staged, rows)

    def _open(self, file: str) -> sqlite3.Connection:
        connection = sqlite3.connect(file)
        connection.execute("PRAGMA journal_mode = OFF")
        connection.execute("PRAGMA synchronous = OFF")
        connection.executescript(self.ddl)
        return connection

    def commit(self, messages: list[Shard | None]) -> None:
        before = self._shards() if self.overwrite else []
        staged = [m.staged for m in messages if m is not None and m.staged]
        if not staged:
            staged = [os.path.join(self.folder, f"{_STAGED}{self.run}-empty")]
            connection = self._open(staged[0])
            connection.commit()
            connection.close()
        for n, file in enumerate(staged):
            os.replace(file, os.path.join(self.folder, f"part-{n:05d}-{self.run}{SHARD_SUFFIX}"))
        for file in before:
            os.unlink(file)
        self._drop_staged()

    def abort(self, messages: list[Shard | None]) -> None:
        self._drop_staged()

    def _shards(self) -> list[str]:
        return [e.path for e in os.scandir(self.folder) if e.name.endswith(SHARD_SUFFIX)]

    def _drop_staged(self) -> None:
        """Remove the files that tasks of this run left without committing them."""
        for entry in list(os.scandir(self.folder)):
            if entry.name.startswith(_STAGED + self.run):
                os.unlink(entry.path)


def _stored(column: pa.Array) -> list:
    """Python values of a column; NaN, which SQLite would store as NULL, as text."""
    values = column.to_pylist()
    if pa.types.is_floating(column.type):
        return ["NaN" if v is not None and v != v else v for v in values]
    return values


def export_sqlite(
    df: DataFrame,
    path: str,
    table: str,
    keys: Sequence[str] = (),
    mode: str = "errorifexists",
    ddl: str | None = None,
) -> None:
    """Write a table as SQLite shards.

    ``keys`` becomes the primary key of each shard's table; ``ddl`` replaces the statements that make it.
    """
    if mode not in ("errorifexists", "append", "overwrite"):
        raise ValueError(f"mode must be errorifexists, append or overwrite, not {mode!r}")
    folder = local_path(path)
    if mode == "errorifexists" and os.path.isdir(folder) and os.listdir(folder):
        raise FileExistsError(f"{folder!r} is not empty")
    df.sparkSession.dataSource.register(SqliteShardsSource)
    stored = df.select(*[storage_column(named(f.name), f).alias(f.name) for f in df.schema.fields])
    (
        stored.write.format("sqlite_shards")
        .mode("overwrite" if mode == "overwrite" else "append")
        .option("table", table)
        .option("ddl", ddl or table_ddl(df.schema, table, keys))
        .save(path)
    )


def export_sqlite_database(
    tables: Mapping[str, DataFrame],
    path: str,
    constraints: Sequence[Constraint] = (),
    mode: str = "errorifexists",
) -> None:
    """Every table as shards under ``<path>/<table>``, with its primary key."""
    keys = {c.table: c.columns for c in constraints if c.rule == PRIMARY_KEY}
    for table, df in tables.items():
        export_sqlite(df, f"{path}/{table}", table, keys.get(table, ()), mode)
