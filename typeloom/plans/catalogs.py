"""Catalog queries and constraint audits.

The catalogs are derived from the part table, one declared column per part, so that they describe many databases
and grow with the data: ten columns to a table, five tables to a database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions.types import map_declared_types
from typeloom.operators.audit import (
    FOREIGN_KEY, NOT_NULL, PRIMARY_KEY, UNIQUE, Constraint, audit_foreign_key, audit_not_null,
    audit_primary_key, audit_unique,
)
from typeloom.operators.audit_all import audit_catalog
from typeloom.operators.catalog import (
    catalog_columns, catalog_summary, catalog_tables, create_index_ddl, create_table_ddl, dropped_defaults, fk_edges,
    register_view, schema_fingerprint,
)
from typeloom.operators.drift import catalog_drift
from typeloom.plans.registry import load, query

# The given tables and how many columns each has.
TABLES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
}

# One declared column per part; the same expressions serve both engines.
FIELDS = ("database", "table", "cid", "name", "decl", "not_null", "pk", "default")
VALUES = (
    "'db' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING)",
    "'t' || CAST(CAST(floor(p_partkey / 10) AS BIGINT) % 5 AS STRING)",
    "CAST(p_partkey % 10 AS INT)",
    """p_name || CASE WHEN p_partkey % 10 = 7 THEN ' "x" ' ELSE ' ' END || CAST(p_partkey AS STRING)""",
    """CASE p_type WHEN 'ECONOMY' THEN 'DECIMAL(' || CAST(p_size AS STRING) || ',2)' WHEN 'SMALL' THEN 'VARCHAR(20)'
        WHEN 'LARGE' THEN 'BIGINT' WHEN 'STANDARD' THEN 'DATETIME' ELSE 'BLOB' END""",
    "p_size > 25",
    "p_partkey % 10 = 0 OR (p_partkey % 10 = 3 AND p_brand < 'Brand#2')",
    "CASE p_brand WHEN 'Brand#1' THEN '0' WHEN 'Brand#2' THEN 'random()' WHEN 'Brand#3' THEN '''n/a''' END",
)
DECLARED = ", ".join(f'{value} AS "{field}"' for field, value in zip(FIELDS, VALUES))
NATIVE = """CASE WHEN decl LIKE 'DECIMAL%' THEN 'DECIMAL(' || least(CAST(p_size AS INT), 18) || ','
    || least(2, least(CAST(p_size AS INT), 18)) || ')' WHEN decl = 'VARCHAR(20)' THEN 'TEXT'
    WHEN decl = 'BIGINT' THEN 'INT64' WHEN decl = 'DATETIME' THEN 'TIMESTAMP' ELSE 'BLOB' END"""
DECLARED_CTE = f"""declared AS (SELECT {DECLARED}, p_size, p_brand, p_partkey FROM part),
    typed AS (SELECT *, {NATIVE} AS native,
        "default" IS NOT NULL AND "default" <> 'random()' AS safe,
        count(*) FILTER (WHERE pk) OVER (PARTITION BY "database", "table") AS n_keys FROM declared)"""


def declared_parts(spark: SparkSession, sf: str) -> DataFrame:
    columns = [F.expr(value).alias(field) for field, value in zip(FIELDS, VALUES)]
    return load(spark, sf, "part").select(*columns, "p_brand", "p_partkey")


def part_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The derived declarations as a catalog of native columns."""
    return map_declared_types(declared_parts(spark, sf), "decl").select(
        "database",
        "table",
        F.col("cid").alias("ordinal"),
        F.col("name").alias("column"),
        F.col("native_type").alias("type"),
        (~F.col("not_null")).alias("nullable"),
        "default",
        "p_brand",
        "pk",
    )


def part_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """A primary key column, a foreign key, or a UNIQUE on some of the derived columns.

    Foreign keys refer to tables t3 to t7 of the same database, of which t5 to t7 do not exist.
    """
    column = part_columns(spark, sf)
    number = F.element_at(F.split("p_brand", "#"), 2).cast("int")
    rule = F.when(F.col("pk"), PRIMARY_KEY).when(number % 3 == 0, FOREIGN_KEY).when(number % 3 == 1, UNIQUE)
    target = F.concat(F.lit("t"), (3 + number % 5).cast("string"))
    is_foreign = F.col("rule") == FOREIGN_KEY
    return (
        column.withColumn("rule", rule)
        .filter(F.col("rule").isNotNull())
        .select(
            "database",
            "table",
            "rule",
            F.array("column").alias("columns"),
            F.when(is_foreign, target).alias("ref_table"),
            F.when(is_foreign, F.array(F.lit("id"))).alias("ref_columns"),
        )
    )


RULES_CTE = f"""{DECLARED_CTE}, numbered AS (SELECT *, CAST(split_part(p_brand, '#', 2) AS INT) AS b FROM typed),
    ruled AS (SELECT *, CASE WHEN pk THEN 'PK' WHEN b % 3 = 0 THEN 'FK' WHEN b % 3 = 1 THEN 'UQ' ELSE '' END AS "key"
        FROM numbered)"""


@query(
    "catalog_columns",
    f"""WITH {RULES_CTE} SELECT "database", "table", cid AS ordinal, name AS "column", native AS type,
        CASE WHEN not_null THEN 'NO' ELSE 'YES' END AS nullable, "key", coalesce("default", '') AS "default"
        FROM ruled""",
)
def columns_with_keys(spark: SparkSession, sf: str) -> DataFrame:
    return catalog_columns(part_columns(spark, sf), part_constraints(spark, sf))


@query(
    "fk_edges",
    f"""WITH {RULES_CTE} SELECT "database", "table" AS from_table, name AS from_columns,
        't' || CAST(3 + b % 5 AS VARCHAR) AS to_table, 'id' AS to_columns FROM ruled r WHERE "key" = 'FK' AND EXISTS
        (SELECT 1 FROM declared d WHERE d."database" = r."database" AND d."table" = 't' || CAST(3 + b % 5 AS VARCHAR))""",
)
def edges(spark: SparkSession, sf: str) -> DataFrame:
    found = fk_edges(part_constraints(spark, sf), part_columns(spark, sf))
    return found.withColumns(
        {c: F.array_join(c, ",") for c in ("from_columns", "to_columns")}
    )


@query(
    "catalog_tables",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", {n} AS n_columns, (SELECT count(*) FROM {t}) AS n_rows"""
        for t, n in TABLES.items()
    ),
)
def table_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog_tables({t: load(spark, sf, t) for t in TABLES})


@query(
    "catalog_summary",
    f"""WITH {DECLARED_CTE}, objects AS (SELECT DISTINCT "database", 'table' AS kind, "table" AS name FROM declared
        UNION ALL SELECT "database", 'index', name FROM declared WHERE p_brand < 'Brand#2'
        UNION ALL SELECT "database", 'view', name FROM declared WHERE p_brand > 'Brand#3')
        SELECT "database", kind, count(*) AS n FROM objects GROUP BY ALL""",
)
def object_counts(spark: SparkSession, sf: str) -> DataFrame:
    columns = part_columns(spark, sf)
    return catalog_summary(columns, columns.filter("p_brand < 'Brand#2'"), columns.filter("p_brand > 'Brand#3'"))


@query(
    "schema_fingerprint",
    f"""WITH {DECLARED_CTE} SELECT "database", "table", sha256(string_agg(cid || ':' || length(name) || ':' || name || ':'
        || native, chr(10) ORDER BY cid)) AS fingerprint FROM typed GROUP BY ALL""",
)
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return schema_fingerprint(part_columns(spark, sf))


@query(
    "create_table_ddl",
    f"""WITH {DECLARED_CTE}, lines AS (SELECT *, '"' || replace(name, '"', '""') || '"' AS quoted FROM typed),
        defined AS (SELECT *, quoted || ' ' || native || CASE WHEN pk AND n_keys = 1 THEN ' PRIMARY KEY'
            WHEN not_null THEN ' NOT NULL' ELSE '' END || CASE WHEN safe THEN ' DEFAULT ' || "default" ELSE '' END AS line
            FROM lines)
        SELECT "database", "table", 'CREATE TABLE "' || any_value("table") || '" (' || chr(10) || '  '
            || string_agg(line, ',' || chr(10) || '  ' ORDER BY cid)
            || CASE WHEN max(n_keys) > 1 THEN ',' || chr(10) || '  PRIMARY KEY ('
                || string_agg(quoted, ', ' ORDER BY cid) FILTER (WHERE pk) || ')' ELSE '' END
            || chr(10) || ')' AS ddl FROM defined GROUP BY "database", "table" """,
)
def table_ddl(spark: SparkSession, sf: str) -> DataFrame:
    return create_table_ddl(declared_parts(spark, sf))


@query(
    "dropped_defaults",
    f"""WITH {DECLARED_CTE} SELECT "database", "table", 'Dropped default for ' || "table" || '.' || name AS warning
        FROM declared WHERE "default" = 'random()'""",
)
def default_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return dropped_defaults(declared_parts(spark, sf))


@query(
    "create_index_ddl",
    f"""WITH {DECLARED_CTE} SELECT "database", 'ix ' || cid AS "index", 'CREATE ' || CASE WHEN not_null THEN 'UNIQUE '
        ELSE '' END || 'INDEX "ix ' || cid || '" ON "' || "table" || '" ("' || replace(name, '"', '""') || '", "id")' AS ddl
        FROM declared""",
)
def index_ddl(spark: SparkSession, sf: str) -> DataFrame:
    indexes = declared_parts(spark, sf).select(
        "database",
        F.concat(F.lit("ix "), F.col("cid").cast("string")).alias("index"),
        "table",
        F.col("not_null").alias("unique"),
        F.array("name", F.lit("id")).alias("columns"),
    )
    return create_index_ddl(indexes)


@query(
    "register_view",
    """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus""",
)
def view_rows(spark: SparkSession, sf: str) -> DataFrame:
    register_view(spark, "large_orders", load(spark, sf, "orders").filter("o_totalprice > 100000"))
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM large_orders GROUP BY o_orderstatus")


# --- audits -------------------------------------------------------------------------------------------------


@query(
    "audit_primary_key",
    """SELECT l_orderkey, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS l_linenumber, count(*) AS n FROM lineitem
       GROUP BY ALL HAVING count(*) > 1 OR max(l_linenumber) = 7""",
)
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("l_linenumber") < 7, F.col("l_linenumber"))
    return audit_primary_key(load(spark, sf, "lineitem").withColumn("l_linenumber", line), ["l_orderkey", "l_linenumber"])


@query(
    "audit_unique",
    """SELECT l_partkey, nullif(l_returnflag, 'R') AS l_returnflag, count(*) AS n FROM lineitem
       WHERE l_returnflag <> 'R' GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_uniques(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    return audit_unique(lines, ["l_partkey", "l_returnflag"])


@query(
    "audit_not_null",
    """SELECT 'o_orderstatus' AS "column", count(*) AS n FROM orders WHERE o_orderstatus = 'P'
       UNION ALL SELECT 'o_totalprice', count(*) FROM orders WHERE o_totalprice < 50000""",
)
def null_columns(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumns(
        {
            "o_orderstatus": F.nullif("o_orderstatus", F.lit("P")),
            "o_totalprice": F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")),
        }
    )
    return audit_not_null(orders, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query(
    "audit_foreign_key",
    """SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND NOT EXISTS
       (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) GROUP BY o_custkey""",
)
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    known = load(spark, sf, "customer").filter("c_acctbal >= 0")
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    orders = load(spark, sf, "orders").withColumn("o_custkey", key)
    return audit_foreign_key(orders, ["o_custkey"], known, ["c_custkey"])


AUDITED = [
    Constraint("lineitem", PRIMARY_KEY, ("l_orderkey", "l_linenumber")),
    Constraint("lineitem", NOT_NULL, ("l_shipdate", "l_quantity")),
    Constraint("lineitem", FOREIGN_KEY, ("l_orderkey",), "orders", ("o_orderkey",)),
    Constraint("orders", PRIMARY_KEY, ("o_orderkey",)),
    Constraint("orders", NOT_NULL, ("o_custkey",)),
    Constraint("customer", UNIQUE, ("c_acctbal",)),
]


@query(
    "audit_catalog",
    """SELECT 'lineitem' AS "table", 'PRIMARY KEY' AS rule, 'l_orderkey,l_linenumber' AS columns,
           (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS
           violations
       UNION ALL SELECT 'lineitem', 'NOT NULL', 'l_shipdate', 0
       UNION ALL SELECT 'lineitem', 'NOT NULL', 'l_quantity', 0
       UNION ALL SELECT 'lineitem', 'FOREIGN KEY', 'l_orderkey', (SELECT count(*) FROM lineitem WHERE l_orderkey IN
           (SELECT o_orderkey FROM orders WHERE o_totalprice <= 20000))
       UNION ALL SELECT 'orders', 'PRIMARY KEY', 'o_orderkey', 0
       UNION ALL SELECT 'orders', 'NOT NULL', 'o_custkey', 0
       UNION ALL SELECT 'customer', 'UNIQUE', 'c_acctbal',
           (SELECT count(*) FROM (SELECT 1 FROM customer GROUP BY c_acctbal HAVING count(*) > 1))""",
)
def all_audits(spark: SparkSession, sf: str) -> DataFrame:
    tables = {t: load(spark, sf, t) for t in ("lineitem", "customer")}
    tables["orders"] = load(spark, sf, "orders").filter("o_totalprice > 20000")
    return audit_catalog(tables, AUDITED)


@query(
    "catalog_drift",
    """SELECT * FROM VALUES ('lineitem', 'l_discount', 'dropped', 'FLOAT64', NULL),
           ('lineitem', 'l_tax', 'renamed', 'l_tax', 'l_duty'), ('lineitem', 'l_quantity', 'retyped', 'FLOAT64', 'TEXT'),
           ('lineitem', 'l_net', 'added', NULL, 'FLOAT64'), ('lineitem', 'l_returnflag', 'moved', '7', '8'),
           ('lineitem', 'l_linestatus', 'moved', '8', '7')
       AS t("table", "column", change, before, after)""",
)
def drifted_columns(spark: SparkSession, sf: str) -> DataFrame:
    """What a release did to lineitem: a column renamed, one retyped, two exchanged, one dropped, one added."""
    old = load(spark, sf, "lineitem")
    new = old.selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "CAST(l_quantity AS string) AS l_quantity", "l_extendedprice",
        "l_tax AS l_duty", "l_linestatus", "l_returnflag", "l_shipdate", "l_extendedprice * (1 - l_discount) AS l_net",
    )
    return catalog_drift({"lineitem": old}, {"lineitem": new})
