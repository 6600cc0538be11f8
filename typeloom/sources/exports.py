"""Text exports of a table: CSV, JSON lines, Markdown, SQL INSERT statements, and a whole-database dump.

Every export is a directory of part files written in parallel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.functions.lexical import named, quoted
from typeloom.functions.render import display_columns, render_display, render_json, render_literal
from typeloom.operators.audit import Constraint
from typeloom.operators.catalog import columns_of, constraints_of, create_table_ddl, declared_of

# Quote only what needs it, double quotes inside quotes, keep outer blanks, write NULL as nothing.  Naming the
# quote as comment character stops the writer from quoting fields that merely start with a #.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "comment": '"',
    "nullValue": "",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists", short_blobs: bool = False) -> None:
    """CSV of display texts, NULL as an empty field, a header line in every file.

    Blobs are whole; ``short_blobs`` cuts long ones as a display does.
    """
    shown, options = display_columns(df, not short_blobs), dict(CSV_OPTIONS)
    if len(shown.columns) == 1:
        # An empty line would not be a record, so a lone empty field is written as "".
        shown = shown.fillna("")
        options["emptyValue"] = '""'
    shown.write.mode(mode).options(**options).csv(path)


def export_json(df: DataFrame, path: str, mode: str = "errorifexists", short_blobs: bool = False) -> None:
    """JSON lines with explicit nulls; integers, doubles and booleans bare, all else as display text."""
    render_json(df, not short_blobs).write.mode(mode).option("ignoreNullFields", False).json(path)


def markdown_rows(df: DataFrame, short_blobs: bool = False) -> DataFrame:
    """One Markdown table line per row, in column ``line``; NULL shown as the word NULL."""
    shown = render_display(df, not short_blobs)
    cells = [F.replace(F.replace(named(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in shown.columns]
    return shown.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def export_markdown(df: DataFrame, path: str, mode: str = "errorifexists", short_blobs: bool = False) -> None:
    """A Markdown table: its two head lines under ``head/``, its rows under ``rows/``."""
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines = df.sparkSession.createDataFrame([("\n".join(head),)], "line string")
    lines.coalesce(1).write.mode(mode).text(f"{path}/head")
    markdown_rows(df, short_blobs).write.mode(mode).text(f"{path}/rows")


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row, in column ``statement``."""
    columns = ", ".join(quoted(c) for c in df.columns)
    literals = render_literal(df)
    values = F.concat_ws(", ", *[named(c) for c in literals.columns])
    opening = f"INSERT INTO {quoted(table)} ({columns}) VALUES ("
    return literals.select(F.concat(F.lit(opening), values, F.lit(");")).alias("statement"))


def export_sql_insert(df: DataFrame, table: str, path: str, mode: str = "errorifexists") -> None:
    """One INSERT statement per row."""
    insert_statements(df, table).write.mode(mode).text(path)


def export_dump(
    tables: Mapping[str, DataFrame],
    path: str,
    constraints: Sequence[Constraint] = (),
    mode: str = "errorifexists",
    tables_at_once: int = 4,
) -> None:
    """The whole database as SQL: for every table ``ddl/table=<table>`` and ``rows/<table>``."""
    if not tables:
        raise ValueError("no tables to dump")
    spark = next(iter(tables.values())).sparkSession
    declared = declared_of(columns_of(spark, tables), constraints_of(spark, constraints))
    ddl = create_table_ddl(declared).select("table", F.concat("ddl", F.lit(";")).alias("statement"))
    ddl.coalesce(1).write.mode(mode).partitionBy("table").text(f"{path}/ddl")

    def rows(table: str) -> None:
        export_sql_insert(tables[table], table, f"{path}/rows/{table}", mode)

    with ThreadPoolExecutor(tables_at_once) as pool:
        list(pool.map(rows, tables))
