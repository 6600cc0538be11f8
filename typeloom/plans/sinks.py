"""Exports: each query writes the whole table in its format and reads the result back."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, In

from typeloom.operators.audit import PRIMARY_KEY, Constraint
from typeloom.operators.coerce import assign_types
from typeloom.operators.numbering import NUMBER, number_rows
from typeloom.plans.migrate import migrate
from typeloom.plans.registry import load, query
from typeloom.plans.values import SECONDS
from typeloom.session import fresh_path, stored
from typeloom.sources.exports import (
    CSV_OPTIONS, export_csv, export_dump, export_json, export_markdown, export_sql_insert,
)
from typeloom.sources.sqlite_files import planned, read_cells, sqlite_columns, sqlite_counts, sqlite_indexes
from typeloom.sources.sqlite_shards import export_sqlite
from typeloom.sources.tables import open_catalog, save_bucketed, write_table

ORDER_TEXTS = f"""CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, nullif(o_orderstatus, 'P') AS s,
    CAST(o_totalprice AS VARCHAR) AS p, strftime(o_orderdate, {SECONDS}) AS d,
    replace(o_orderpriority, '-', '|') AS t FROM orders"""


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with NULLs and pipes in them."""
    return load(spark, sf, "orders").withColumns(
        {
            "o_orderstatus": F.nullif("o_orderstatus", F.lit("P")),
            "o_orderpriority": F.replace("o_orderpriority", F.lit("-"), F.lit("|")),
        }
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


@query(
    "export_csv",
    f"""SELECT k || ',' || c || ',' || coalesce(s, '') || ',' || p || ',' || d
        || ',"' || t || ', ""checked"" "' AS value FROM (SELECT {ORDER_TEXTS})""",
)
def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "export-csv")
    orders = _orders(spark, sf)
    noted = F.concat("o_orderpriority", F.lit(', "checked" '))
    export_csv(orders.withColumn("o_orderpriority", noted), path)
    return _lines(spark, path).filter(F.col("value") != ",".join(orders.columns))


@query("csv_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "export-csv")
    export_csv(load(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    reading = {**CSV_OPTIONS, "comment": "", "multiLine": True, "lineSep": "\n"}
    return spark.read.options(**reading).csv(path)


@query(
    "export_json",
    f"""SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice,
        strftime(o_orderdate, {SECONDS}) AS o_orderdate, 6 AS n_fields FROM orders""",
)
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "export-json")
    export_json(_orders(spark, sf), path)
    lines = _lines(spark, path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string"
    return lines.select(
        F.from_json("value", schema).alias("row"), F.size(F.json_object_keys("value")).alias("n_fields")
    ).select("row.*", "n_fields")


@query(
    "export_markdown",
    f"""SELECT '| ' || k || ' | ' || c || ' | ' || coalesce(s, 'NULL') || ' | ' || p || ' | ' || d || ' | '
        || replace(t, '|', '\\|') || ' |' AS value FROM (SELECT {ORDER_TEXTS})
        UNION ALL SELECT '| o_orderkey | o_custkey | o_orderstatus | o_totalprice | o_orderdate | o_orderpriority |'
        UNION ALL SELECT '| --- | --- | --- | --- | --- | --- |'""",
)
def markdown_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "export-markdown")
    export_markdown(_orders(spark, sf), path)
    return _lines(spark, f"{path}/head").unionByName(_lines(spark, f"{path}/rows"))


INSERTS = f"""SELECT 'INSERT INTO "orders" ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", '
    || '"o_orderpriority") VALUES (' || k || ', ' || c || ', ' || coalesce('''' || s || '''', 'NULL') || ', ' || p
    || ', ''' || d || ''', ''' || t || ''');' AS value FROM (SELECT {ORDER_TEXTS})"""


@query("export_insert", INSERTS)
def insert_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "export-insert")
    export_sql_insert(_orders(spark, sf), "orders", path)
    return _lines(spark, path)


@query(
    "export_dump",
    f"""SELECT 'orders' AS "table", value FROM ({INSERTS})
        UNION ALL SELECT 'nation', 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES ('
            || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ');' FROM nation
        UNION ALL SELECT 'nation', unnest(['CREATE TABLE "nation" (', '  "n_nationkey" INT64 PRIMARY KEY,',
            '  "n_name" TEXT,', '  "n_regionkey" INT64', ');'])
        UNION ALL SELECT 'orders', unnest(['CREATE TABLE "orders" (', '  "o_orderkey" INT64 PRIMARY KEY,',
            '  "o_custkey" INT64,', '  "o_orderstatus" TEXT,', '  "o_totalprice" FLOAT64,',
            '  "o_orderdate" TIMESTAMP,', '  "o_orderpriority" TEXT', ');'])""",
)
def dump_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "export-dump")
    tables = {"orders": _orders(spark, sf), "nation": load(spark, sf, "nation")}
    keys = [Constraint("orders", PRIMARY_KEY, ("o_orderkey",)), Constraint("nation", PRIMARY_KEY, ("n_nationkey",))]
    export_dump(tables, path, keys)
    written = spark.read.option("lineSep", "\n").text(f"{path}/ddl").select("table", "value")
    for table in tables:
        written = written.unionByName(_lines(spark, f"{path}/rows/{table}").select(F.lit(table).alias("table"), "value"))
    return written


BLOB_HEX = "md5(o_orderpriority || '1') || md5(o_orderpriority || '2') || md5(o_orderpriority || '3')"


@query(
    "export_blobs",
    f"""SELECT format, o_orderkey, '0x' || {BLOB_HEX} AS blob FROM orders, (SELECT unnest(['csv', 'json', 'markdown']) AS format)""",
)
def exported_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Blobs of 48 bytes come out whole in every text format."""
    path = fresh_path(spark, "export-blobs")
    orders = load(spark, sf, "orders").select("o_orderkey", F.unhex(F.expr(BLOB_HEX)).alias("blob"))
    export_csv(orders, f"{path}/csv")
    export_json(orders, f"{path}/json")
    export_markdown(orders, f"{path}/markdown")
    schema = "o_orderkey bigint, blob string"
    found = {
        "csv": spark.read.schema(schema).csv(f"{path}/csv", header=True),
        "json": spark.read.schema(schema).json(f"{path}/json"),
        "markdown": _lines(spark, f"{path}/markdown/rows").select(F.split("value", r" ?\| ?").alias("cells")).select(
            F.col("cells")[1].cast("bigint").alias("o_orderkey"), F.col("cells")[2].alias("blob")
        ),
    }
    tagged = [df.select(F.lit(name).alias("format"), "*") for name, df in found.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query("sorted_table", "SELECT * FROM lineitem")
def sorted_table(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "sorted-table")
    write_table(load(spark, sf, "lineitem"), path, sort_by=["l_orderkey", "l_linenumber"])
    return spark.read.parquet(path)


@query("zordered_table", "SELECT * FROM lineitem")
def zordered_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table laid out for lookups by part, by supplier or by date."""
    path = fresh_path(spark, "zordered-table")
    write_table(load(spark, sf, "lineitem"), path, zorder_by=["l_partkey", "l_suppkey", "l_shipdate"])
    return spark.read.parquet(path)


@query(
    "sorted_order",
    """SELECT count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high, true AS files_in_order FROM lineitem""",
)
def sorted_order(spark: SparkSession, sf: str) -> DataFrame:
    """The least and greatest key of each file of a sorted table: none begins before the one before it ends."""
    path = fresh_path(spark, "sorted-table")
    write_table(load(spark, sf, "lineitem"), path, sort_by=["l_orderkey", "l_linenumber"], files=8)
    key = F.struct("l_orderkey", "l_linenumber")
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("file"))
    files = files.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    # One row per file.
    before = F.lag("high").over(Window.partitionBy(F.lit(1)).orderBy("low", "high"))
    in_order = F.coalesce(before <= F.col("low"), F.lit(True))
    files = files.withColumn("in_order", in_order)
    return files.agg(
        F.sum("n").alias("n"), F.min("low.l_orderkey").alias("low"), F.max("high.l_orderkey").alias("high"),
        (F.every("in_order") & (F.count(F.lit(1)) > 1)).alias("files_in_order"),
    )


@query(
    "bucketed_join",
    """SELECT o_orderkey, o_totalprice, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       GROUP BY o_orderkey, o_totalprice""",
)
def bucketed_join(spark: SparkSession, sf: str) -> DataFrame:
    """Tables saved in buckets of their join key, joined as saved."""
    name = uuid.uuid4().hex
    save_bucketed(load(spark, sf, "orders"), f"orders_{name}", ["o_orderkey"], 8)
    save_bucketed(load(spark, sf, "lineitem"), f"lineitem_{name}", ["l_orderkey"], 8)
    orders, lines = spark.table(f"orders_{name}"), spark.table(f"lineitem_{name}")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_totalprice").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "open_catalog",
    """SELECT n_name, r_name, count(*) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey
       JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name""",
)
def opened_catalog(spark: SparkSession, sf: str) -> DataFrame:
    open_catalog(spark, sf)
    return spark.sql(
        """SELECT n_name, r_name, count(*) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey
           JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name"""
    )


ORDER_TYPES = {
    "o_orderkey": "INT64",
    "o_custkey": "INT64",
    "o_orderstatus": "TEXT",
    "o_totalprice": "FLOAT64",
    "o_orderdate": "TIMESTAMP",
    "o_orderpriority": "TEXT",
}


@query("sqlite_round_trip", "SELECT * FROM orders")
def sqlite_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "sqlite-shards")
    export_sqlite(load(spark, sf, "orders"), path, "orders", ["o_orderkey"])
    good, _ = assign_types(read_cells(spark, path, "orders"), ORDER_TYPES, on_error="fail")
    return good


KEYED = """CREATE TABLE "{table}" ("k" {declared}, "line" INTEGER, "price" REAL, PRIMARY KEY ("k", "line")) WITHOUT ROWID"""


@query(
    "sqlite_keyed_tables",
    """WITH lines AS (SELECT l_orderkey AS o, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS line,
            l_extendedprice AS price FROM lineitem)
       SELECT 'number' AS kind, CAST(o AS VARCHAR) AS k, line, price FROM lines
       UNION ALL SELECT 'text', 'https://example.com/a/long/common/path/to/every/one/of/the/orders/of/this/shop/' || o, line, price
           FROM lines
       UNION ALL SELECT 'mixed', CASE WHEN o % 2 = 0 THEN 'o' || o ELSE CAST(o AS VARCHAR) END, line, price FROM lines""",
)
def sqlite_keyed_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables without row id, by number, by long text and by both, cut into many shares and read back."""
    lines = number_rows(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice"])
    lines = lines.select(F.col("l_orderkey").alias("o"), F.col(NUMBER).alias("line"), F.col("l_extendedprice").alias("price"))
    lines = stored(lines, "keyed-lines")
    path = "https://example.com/a/long/common/path/to/every/one/of/the/orders/of/this/shop/"
    keys = {
        "number": ("INTEGER", F.col("o")),
        "text": ("TEXT", F.concat(F.lit(path), "o")),
        "mixed": ("", F.when(F.col("o") % 2 == 0, F.concat(F.lit("o"), "o")).otherwise(F.col("o").cast("string"))),
    }
    found = []
    for kind, (declared, key) in keys.items():
        folder = fresh_path(spark, f"sqlite-{kind}")
        ddl = KEYED.format(table=kind, declared=declared)
        export_sqlite(lines.select(key.alias("k"), "line", "price"), folder, kind, ddl=ddl)
        cells = read_cells(spark, folder, kind, split_bytes=65_536)
        text = F.coalesce(F.col("k.t"), F.col("k.i").cast("string"))
        found.append(cells.select(F.lit(kind).alias("kind"), text.alias("k"), F.col("line.i").alias("line"), F.col("price.r").alias("price")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "sqlite_key_lookup",
    """SELECT 'customer' AS lookup, o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7
       UNION ALL SELECT 'keys', o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (1, 2, 70, 100) AND o_orderkey > 200
       UNION ALL SELECT 'status', o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey BETWEEN 50 AND 60
           AND o_orderstatus = 'O'""",
)
def sqlite_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups by the key of a table without row id: SQLite answers them from its index, in every share."""
    path = fresh_path(spark, "sqlite-lookup")
    ddl = """CREATE TABLE "orders" ("o_custkey" INTEGER, "o_orderkey" INTEGER, "o_orderstatus" TEXT,
        PRIMARY KEY ("o_custkey", "o_orderkey")) WITHOUT ROWID"""
    export_sqlite(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), path, "orders", ddl=ddl)
    cuts = planned(spark, path, "orders", 65_536)
    customer, order, status = F.col("o_custkey.i"), F.col("o_orderkey.i"), F.col("o_orderstatus.t")

    def lookup(name: str, where: Sequence[Filter], *conditions: Column) -> DataFrame:
        cells = read_cells(spark, path, "orders", cuts=cuts, where=where, push=bool(conditions))
        for condition in conditions:
            cells = cells.filter(condition)
        return cells.select(
            F.lit(name).alias("lookup"), customer.alias("o_custkey"), order.alias("o_orderkey"), status.alias("o_orderstatus")
        )

    keys = [In(("o_custkey", "i"), (1, 2, 70, 100)), GreaterThan(("o_orderkey", "i"), 200)]
    found = lookup("customer", [EqualTo(("o_custkey", "i"), 7)]).unionByName(lookup("keys", keys))
    return found.unionByName(lookup("status", [], customer.between(50, 60), status == "O"))


@query(
    "sqlite_storage",
    """SELECT 'o_orderkey' AS "column", 'integer' AS k, count(*) AS n FROM orders
       UNION ALL SELECT 'late', 'integer', count(*) FROM orders
       UNION ALL SELECT 'o_totalprice', 'real', count(*) FROM orders
       UNION ALL SELECT 'cents', CASE WHEN o_totalprice = floor(o_totalprice) THEN 'integer' ELSE 'real' END, count(*)
           FROM orders GROUP BY ALL
       UNION ALL SELECT 'o_orderdate', 'text', count(*) FROM orders
       UNION ALL SELECT 'status', CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE 'blob' END, count(*)
           FROM orders GROUP BY ALL""",
)
def sqlite_storage(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "sqlite-shards")
    orders = load(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") > 700).alias("late"),
        "o_totalprice",
        F.col("o_totalprice").cast("decimal(12,2)").alias("cents"),
        "o_orderdate",
        F.nullif("o_orderstatus", F.lit("P")).cast("binary").alias("status"),
    )
    export_sqlite(orders, path, "orders", ["o_orderkey"])
    cells = read_cells(spark, path, "orders")
    tags = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["k"].alias("k")) for c in cells.columns]))
    return cells.select(tags.alias("tag")).groupBy("tag.column", "tag.k").agg(F.count(F.lit(1)).alias("n"))


# Keys, index and the declared types of what is migrated: richer than the storage affinities of the shards.
DECLARED = {
    "orders": """CREATE TABLE "orders" ("o_orderkey" INTEGER PRIMARY KEY, "o_custkey" BIGINT NOT NULL,
        "o_orderstatus" CHAR(1) DEFAULT 'O', "o_totalprice" DECIMAL(12,2), "o_orderdate" DATETIME,
        "o_orderpriority" INT DEFAULT (abs(-1)));
        CREATE INDEX "ix customer" ON "orders" ("o_custkey", "o_orderdate")""",
    "customer": """CREATE TABLE "customer" ("c_custkey" INTEGER, "c_name" VARCHAR(25), "c_nationkey" INT,
        "c_acctbal" DOUBLE, "c_mktsegment", PRIMARY KEY ("c_custkey", "c_nationkey"))""",
}


def _database(spark: SparkSession, sf: str) -> str:
    """SQLite files of two tables; the priority of every tenth-or-so order is no number, as declared."""
    path = fresh_path(spark, "sqlite-database")
    orders = load(spark, sf, "orders")
    priority = F.when(F.col("o_totalprice") > 50000, F.left("o_orderpriority", F.lit(1)))
    tables = {
        "orders": orders.withColumn("o_orderpriority", F.coalesce(priority, "o_orderpriority")),
        "customer": load(spark, sf, "customer"),
    }
    for table, df in tables.items():
        export_sqlite(df, f"{path}/{table}", table, ddl=DECLARED[table])
    return f"{path}/*/*.sqlite"


@query(
    "sqlite_catalog",
    """WITH sizes AS (SELECT 'orders' AS "table", count(*) AS n_rows, 'ix customer' AS indexes,
            'o_custkey,o_orderdate' AS indexed FROM orders
            UNION ALL SELECT 'customer', count(*), NULL, NULL FROM customer),
        declared AS (SELECT 'orders' AS "table", unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice',
                'o_orderdate', 'o_orderpriority']) AS name,
                unnest(['INTEGER', 'BIGINT', 'CHAR(1)', 'DECIMAL(12,2)', 'DATETIME', 'INT']) AS decl,
                unnest([true, false, false, false, false, false]) AS pk
            UNION ALL SELECT 'customer',
                unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']),
                unnest(['INTEGER', 'VARCHAR(25)', 'INT', 'DOUBLE', '']), unnest([true, false, true, false, false]))
        SELECT * FROM declared JOIN sizes USING ("table")""",
)
def sqlite_catalog(spark: SparkSession, sf: str) -> DataFrame:
    path = _database(spark, sf)
    columns = sqlite_columns(spark, path).select("table", "name", "decl", "pk").distinct()
    indexes = sqlite_indexes(spark, path).select(
        "table", F.col("index").alias("indexes"), F.array_join("columns", ",").alias("indexed")
    )
    counts = [
        sqlite_counts(spark, path, table).select(F.lit(table).alias("table"), "rows") for table in DECLARED
    ]
    sizes = counts[0].unionByName(counts[1]).groupBy("table").agg(F.sum("rows").alias("n_rows"))
    return columns.join(sizes, "table").join(indexes.distinct(), "table", "left")


@query(
    "migrate",
    """SELECT 'orders' AS "table", count(*) AS source_rows, count(*) FILTER (WHERE o_totalprice > 50000) AS loaded_rows,
           count(*) FILTER (WHERE o_totalprice <= 50000) AS rejected_rows, true AS ok, 6 AS columns, 1 AS indexes,
           'Dropped default for orders.o_orderpriority' AS warnings FROM orders
       UNION ALL SELECT 'customer', count(*), count(*), 0, true, 5, 0, '' FROM customer""",
)
def migration_report(spark: SparkSession, sf: str) -> DataFrame:
    report = migrate(spark, _database(spark, sf), fresh_path(spark, "migrated"))
    return report.drop("ddl", "index_ddl").withColumn("warnings", F.array_join("warnings", ","))


@query(
    "migrated_rows",
    """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice,
       o_orderdate, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS o_orderpriority
       FROM orders WHERE o_totalprice > 50000""",
)
def migrated_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = fresh_path(spark, "migrated")
    migrate(spark, _database(spark, sf), out)
    loaded = spark.read.parquet(f"{out}/tables/orders.parquet")
    return loaded.withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
