"""Catalogs of columns, constraints and indexes as DataFrames, and the DDL text made from them.

Catalog rows carry their database, so one frame may describe very many databases.  Only the rows of one table
are ever gathered together, and a table has at most 32,767 columns in the source format.

``columns``      database, table, ordinal, column, type, nullable, default
``constraints``  database, table, rule, columns array, ref_table, ref_columns array
``indexes``      database, index, table, unique, columns array
``declared``     database, table, cid, name, decl, not_null, pk, default   (as read from source files)
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions.lexical import quote_identifier
from typeloom.functions.types import is_safe_default, map_declared_types, native_type_of
from typeloom.operators.audit import FOREIGN_KEY, PRIMARY_KEY, UNIQUE, Constraint

COLUMNS_TYPE = (
    "database string, table string, ordinal int, column string, type string, nullable boolean, default string"
)
CONSTRAINTS_TYPE = (
    "database string, table string, rule string, columns array<string>, ref_table string, ref_columns array<string>"
)
# The two keys of a table in a catalog of many databases.
TABLE = ["database", "table"]


def columns_of(spark: SparkSession, tables: Mapping[str, DataFrame], database: str = "main") -> DataFrame:
    """The ``columns`` frame of loaded tables, from their schemas."""
    rows = [
        (database, table, n, f.name, native_type_of(f), f.nullable, None)
        for table, df in tables.items()
        for n, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, COLUMNS_TYPE)


def constraints_of(spark: SparkSession, constraints: Sequence[Constraint], database: str = "main") -> DataFrame:
    """The ``constraints`` frame of constraints known on the driver."""
    rows = [
        (database, c.table, c.rule, list(c.columns), c.ref_table, list(c.ref_columns)) for c in constraints
    ]
    return spark.createDataFrame(rows, CONSTRAINTS_TYPE)


def catalog_columns(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Every column with its key role: ``(database, table, ordinal, column, type, nullable, key, default)``.

    The role is PK before FK before UQ, else empty; only a one-column UNIQUE makes its column unique.
    """
    rank = (
        F.when(F.col("rule") == PRIMARY_KEY, 1)
        .when(F.col("rule") == FOREIGN_KEY, 2)
        .when((F.col("rule") == UNIQUE) & (F.size("columns") == 1), 3)
    )
    roles = (
        constraints.select(*TABLE, rank.alias("rank"), F.explode("columns").alias("column"))
        .groupBy(*TABLE, "column")
        .agg(F.min("rank").alias("rank"))
    )
    key = F.when(F.col("rank") == 1, "PK").when(F.col("rank") == 2, "FK").when(F.col("rank") == 3, "UQ").otherwise("")
    return columns.join(roles, [*TABLE, "column"], "left").select(
        *TABLE,
        "ordinal",
        "column",
        "type",
        F.when(F.col("nullable"), "YES").otherwise("NO").alias("nullable"),
        key.alias("key"),
        F.coalesce("default", F.lit("")).alias("default"),
    )


def catalog_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column count and exact row count of loaded tables: ``(table, n_columns, n_rows)``."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table"), F.lit(len(df.columns)).alias("n_columns"), "n_rows"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def fk_edges(constraints: DataFrame, columns: DataFrame) -> DataFrame:
    """Foreign-key edges ``(database, from_table, from_columns, to_table, to_columns)``.

    An edge to a table that the catalog does not hold is left out.
    """
    targets = columns.select("database", F.col("table").alias("to_table")).distinct()
    edges = constraints.filter(F.col("rule") == FOREIGN_KEY).select(
        "database",
        F.col("table").alias("from_table"),
        F.col("columns").alias("from_columns"),
        F.col("ref_table").alias("to_table"),
        F.col("ref_columns").alias("to_columns"),
    )
    return edges.join(targets, ["database", "to_table"], "left_semi").select(
        "database", "from_table", "from_columns", "to_table", "to_columns"
    )


def catalog_summary(columns: DataFrame, indexes: DataFrame, views: DataFrame) -> DataFrame:
    """How many tables, views and indexes each database holds: ``(database, kind, n)``.

    ``views`` has ``database, view``.
    """
    objects = (
        columns.select(*TABLE)
        .distinct()
        .select("database", F.lit("table").alias("kind"))
        .unionByName(views.select("database", F.lit("view").alias("kind")))
        .unionByName(indexes.select("database", F.lit("index").alias("kind")))
    )
    return objects.groupBy("database", "kind").agg(F.count(F.lit(1)).alias("n"))


def schema_fingerprint(columns: DataFrame) -> DataFrame:
    """A hash of each table's columns (order, name, type): ``(database, table, fingerprint)``."""
    entry = F.concat_ws(":", F.col("ordinal"), F.length("column"), "column", "type")
    entries = F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("entry"))))
    text = F.array_join(entries["entry"], "\n")
    return columns.groupBy(*TABLE).agg(F.sha2(text, 256).alias("fingerprint"))


def register_view(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """Name a DataFrame so that SQL can refer to it; returns it as the session sees it."""
    df.createOrReplaceTempView(name)
    return spark.table(name)


def _column_definition(sole_key: Column, column: Column) -> Column:
    key = sole_key & column["pk"]
    return F.concat(
        quote_identifier(column["name"]),
        F.lit(" "),
        column["native_type"],
        F.when(key, F.lit(" PRIMARY KEY")).otherwise(""),
        F.when(column["not_null"] & ~key, F.lit(" NOT NULL")).otherwise(""),
        F.when(column["safe"], F.concat(F.lit(" DEFAULT "), column["default"])).otherwise(""),
    )


def create_table_ddl(declared: DataFrame) -> DataFrame:
    """``CREATE TABLE`` text of every declared table: ``(database, table, ddl)``.

    A single-column key is marked on its column, which then is never marked NOT NULL; a longer key is a
    clause of its own, in column order.  Defaults that are not safe are left out (:func:`dropped_defaults`).
    """
    typed = map_declared_types(declared, "decl").withColumn("safe", is_safe_default(F.col("default")))
    entry = F.struct("cid", "name", "native_type", "not_null", "pk", "default", "safe")
    gathered = typed.groupBy(*TABLE).agg(F.array_sort(F.collect_list(entry)).alias("columns"))
    keys = F.filter("columns", lambda c: c["pk"])
    definitions = F.transform("columns", lambda c: _column_definition(F.col("n_keys") == 1, c))
    key_clause = F.concat(
        F.lit("PRIMARY KEY ("),
        F.array_join(F.transform(keys, lambda c: quote_identifier(c["name"])), ", "),
        F.lit(")"),
    )
    return (
        gathered.withColumn("n_keys", F.size(keys))
        .withColumn("lines", definitions)
        .withColumn("lines", F.when(F.col("n_keys") > 1, F.array_append("lines", key_clause)).otherwise(F.col("lines")))
        .select(
            *TABLE,
            F.concat(
                F.lit("CREATE TABLE "),
                quote_identifier(F.col("table")),
                F.lit(" (\n  "),
                F.array_join("lines", ",\n  "),
                F.lit("\n)"),
            ).alias("ddl"),
        )
    )


def dropped_defaults(declared: DataFrame) -> DataFrame:
    """A warning for every default that is not carried over: ``(database, table, warning)``."""
    unsafe = declared.filter(F.col("default").isNotNull() & ~is_safe_default(F.col("default")))
    return unsafe.select(
        *TABLE, F.concat(F.lit("Dropped default for "), "table", F.lit("."), "name").alias("warning")
    )


def create_index_ddl(indexes: DataFrame) -> DataFrame:
    """``CREATE INDEX`` text of every index: ``(database, index, ddl)``."""
    columns = F.array_join(F.transform("columns", quote_identifier), ", ")
    return indexes.select(
        "database",
        "index",
        F.concat(
            F.lit("CREATE "),
            F.when(F.col("unique"), F.lit("UNIQUE ")).otherwise(""),
            F.lit("INDEX "),
            quote_identifier(F.col("index")),
            F.lit(" ON "),
            quote_identifier(F.col("table")),
            F.lit(" ("),
            columns,
            F.lit(")"),
        ).alias("ddl"),
    )


def declared_of(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """The ``declared`` frame of native tables, so that their DDL can be made as for source tables."""
    keys = (
        constraints.filter(F.col("rule") == PRIMARY_KEY)
        .select(*TABLE, F.explode("columns").alias("column"), F.lit(True).alias("pk"))
        .distinct()
    )
    return columns.join(keys, [*TABLE, "column"], "left").select(
        *TABLE,
        F.col("ordinal").alias("cid"),
        F.col("column").alias("name"),
        F.col("type").alias("decl"),
        (~F.col("nullable")).alias("not_null"),
        F.coalesce("pk", F.lit(False)).alias("pk"),
        "default",
    )
