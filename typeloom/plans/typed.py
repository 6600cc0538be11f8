"""Type mapping, coercion, assignment and typed parsing, on columns derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions.cells import coerce_cell, make_cell, parse_for_type
from typeloom.functions.types import is_safe_default, map_declared_types, sqlite_affinity
from typeloom.operators.audit import kind_profile, null_profile, reconcile
from typeloom.operators.coerce import ERRORS, assign_types, coerce_cells
from typeloom.plans.registry import load, query

# Column declarations of many spellings; the same expression serves both engines.
DECLARATION = """CASE l_linenumber
    WHEN 1 THEN 'DECIMAL(' || CAST(CAST(l_quantity AS INT) AS STRING) || ',' || CAST(l_suppkey AS STRING) || ')'
    WHEN 2 THEN 'numeric ( ' || CAST(CAST(l_quantity * 10 AS INT) AS STRING) || ' )'
    WHEN 3 THEN CASE l_returnflag WHEN 'A' THEN 'VARCHAR(' || CAST(l_suppkey AS STRING) || ')'
        WHEN 'N' THEN 'Timestamp With Time Zone' ELSE 'timestamp(6) with time zone' END
    WHEN 4 THEN CASE l_returnflag WHEN 'A' THEN 'BOOLEAN' WHEN 'N' THEN '  datetime ' ELSE 'date' END
    WHEN 5 THEN CASE l_returnflag WHEN 'A' THEN 'FLOATING POINT' WHEN 'N' THEN 'double precision' ELSE 'REAL' END
    WHEN 6 THEN CASE l_returnflag WHEN 'A' THEN 'uuid' WHEN 'N' THEN 'GUID' ELSE 'time' END
    ELSE CASE l_returnflag WHEN 'A' THEN 'UNSIGNED DECIMAL' WHEN 'N' THEN 'VARBINARY(16)' ELSE '' END END"""

NATIVE_TYPE = """CASE WHEN decl LIKE '%BOOL%' THEN 'BOOL'
    WHEN decl LIKE '%UUID%' OR decl LIKE '%GUID%' THEN 'UUID'
    WHEN decl LIKE 'DECIMAL%' OR decl LIKE 'NUMERIC%' THEN 'DECIMAL'
    WHEN decl LIKE '%TIMESTAMPTZ%' OR decl LIKE '%TIMESTAMP WITH TIME ZONE%' THEN 'TIMESTAMPTZ'
    WHEN decl LIKE '%TIMESTAMP%' OR decl LIKE '%DATETIME%' THEN 'TIMESTAMP'
    WHEN decl LIKE '%DATE%' THEN 'DATE'
    WHEN decl LIKE '%TIME%' THEN 'TIME'
    WHEN decl LIKE '%INT%' THEN 'INT64'
    WHEN decl LIKE '%CHAR%' OR decl LIKE '%CLOB%' OR decl LIKE '%TEXT%' THEN 'TEXT'
    WHEN decl LIKE '%BLOB%' OR decl LIKE '%BINARY%' OR decl LIKE '%BYTEA%' THEN 'BLOB'
    WHEN decl LIKE '%REAL%' OR decl LIKE '%FLOA%' OR decl LIKE '%DOUB%' THEN 'FLOAT64'
    ELSE 'TEXT' END"""


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.expr(DECLARATION).alias("decl"))


@query(
    "declared_types",
    f"""WITH declared AS (SELECT l_orderkey, l_partkey, {DECLARATION} AS original FROM lineitem),
        folded AS (SELECT *, upper(trim(original)) AS decl FROM declared),
        kinds AS (SELECT *, {NATIVE_TYPE} AS type,
            TRY_CAST(trim(regexp_extract(decl, '\\(([^,)]*)', 1)) AS INT) AS p,
            TRY_CAST(trim(regexp_extract(decl, ',([^,)]*)', 1)) AS INT) AS s FROM folded),
        sized AS (SELECT *, CASE WHEN p <= 255 THEN greatest(least(p, 18), 1) END AS p18 FROM kinds),
        typed AS (SELECT *, CASE WHEN type = 'DECIMAL' THEN coalesce(p18, 18) END AS precision,
            CASE WHEN type = 'DECIMAL' AND p18 IS NOT NULL
                THEN least(CASE WHEN s <= 255 THEN s ELSE 0 END, p18)
                WHEN type = 'DECIMAL' THEN 6 END AS scale FROM sized)
        SELECT l_orderkey, l_partkey, original AS decl, type, precision, scale,
            CASE WHEN type = 'DECIMAL' THEN 'DECIMAL(' || precision || ',' || scale || ')' ELSE type END
            AS native_type FROM typed""",
)
def declared_types(spark: SparkSession, sf: str) -> DataFrame:
    return map_declared_types(declarations(spark, sf), "decl")


@query(
    "affinity_back",
    f"""WITH folded AS (SELECT l_orderkey, l_partkey, upper(trim({DECLARATION})) AS decl FROM lineitem),
        kinds AS (SELECT l_orderkey, l_partkey, {NATIVE_TYPE} AS type FROM folded)
        SELECT *, CASE WHEN type IN ('INT64', 'BOOL') THEN 'INTEGER' WHEN type = 'FLOAT64' THEN 'REAL'
            WHEN type = 'BLOB' THEN 'BLOB' WHEN type = 'DECIMAL' THEN 'NUMERIC' ELSE 'TEXT' END AS affinity
        FROM kinds""",
)
def affinity_back(spark: SparkSession, sf: str) -> DataFrame:
    typed = map_declared_types(declarations(spark, sf), "decl")
    return sqlite_affinity(typed, "native_type").select("l_orderkey", "l_partkey", "type", "affinity")


# Default expressions; the same expression serves both engines.
DEFAULT = """CASE p_brand WHEN 'Brand#1' THEN 'null' WHEN 'Brand#2' THEN 'Current_Timestamp'
    WHEN 'Brand#3' THEN '  ' || CAST(p_retailprice AS STRING) || ' ' WHEN 'Brand#4' THEN '1e' || CAST(p_size AS STRING)
    WHEN 'Brand#5' THEN 'random()' WHEN 'Brand#6' THEN '''' || p_name || '''' WHEN 'Brand#7' THEN ''''
    WHEN 'Brand#8' THEN '-Infinity' WHEN 'Brand#9' THEN '' WHEN 'Brand#10' THEN '0x1f'
    WHEN 'Brand#11' THEN '.5' WHEN 'Brand#12' THEN '5.' WHEN 'Brand#13' THEN '.' WHEN 'Brand#14' THEN '"a"'
    WHEN 'Brand#15' THEN 'datetime(''now'')' WHEN 'Brand#16' THEN 'TRUE' ELSE p_name END"""


@query(
    "safe_defaults",
    f"""WITH given AS (SELECT p_partkey, {DEFAULT} AS original FROM part),
        cut AS (SELECT *, trim(original) AS d FROM given)
        SELECT p_partkey, original AS default_text,
            upper(d) IN ('NULL', 'TRUE', 'FALSE', 'CURRENT_TIMESTAMP')
            OR regexp_full_match(lower(d), '[+-]?(inf|infinity|nan|([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?)')
            OR (d LIKE '''%' AND d LIKE '%''') AS safe FROM cut""",
)
def safe_defaults(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "part").select("p_partkey", F.expr(DEFAULT).alias("default_text"))
    return parts.withColumn("safe", is_safe_default(F.col("default_text")))


# Cells of all five storage classes, each with a target type; the same expressions serve both engines.
CELLS = """o_orderkey,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'integer' WHEN '2-HIGH' THEN 'real' WHEN '3-MEDIUM' THEN 'text'
        WHEN '4-NOT SPECIFIED' THEN 'blob' ELSE 'null' END AS k,
    o_custkey % 40 AS i,
    CASE WHEN o_totalprice > 400000 AND extract(month FROM o_orderdate) IN (1, 7) THEN o_totalprice * 1e14
        ELSE 250000.5 - o_totalprice END AS r,
    CASE o_custkey % 10 WHEN 0 THEN 'YES' WHEN 1 THEN 'f' WHEN 2 THEN ' 7' WHEN 3 THEN '+' || CAST(o_custkey AS STRING)
        WHEN 4 THEN '1.0d' WHEN 5 THEN '-12.5e2' WHEN 6 THEN CAST(o_totalprice AS STRING) WHEN 7 THEN 'y'
        WHEN 8 THEN '99999999999999999999' ELSE CAST(o_custkey AS STRING) END AS t,
    o_orderstatus AS b,
    CASE extract(month FROM o_orderdate) % 6 WHEN 0 THEN 'BOOL' WHEN 1 THEN 'INT64' WHEN 2 THEN 'FLOAT64'
        WHEN 3 THEN 'TEXT' WHEN 4 THEN 'DATE' ELSE 'DECIMAL' END AS target"""

PARSED = f"""cells AS (SELECT {CELLS} FROM orders),
    parsed AS (SELECT *,
        CASE WHEN k = 'text' AND regexp_full_match(t, '[+-]?[0-9]+') THEN TRY_CAST(t AS BIGINT) END AS as_long,
        CASE WHEN k = 'text' AND regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
            THEN TRY_CAST(t AS DOUBLE) END AS as_double,
        CASE WHEN k = 'text' AND lower(t) IN ('1', 'true', 't', 'yes') THEN true
            WHEN k = 'text' AND lower(t) IN ('0', 'false', 'f', 'no') THEN false END AS as_bool FROM cells),
    coerced AS (SELECT o_orderkey, target, k,
        CASE WHEN k = 'integer' AND target NOT IN ('BOOL', 'FLOAT64', 'TEXT') THEN i
            WHEN k = 'real' AND target = 'INT64' THEN CASE WHEN r >= 9.3e18 THEN 9223372036854775807
                ELSE CAST(trunc(r) AS BIGINT) END
            WHEN target = 'INT64' THEN as_long END AS int64,
        CASE WHEN k = 'integer' AND target = 'FLOAT64' THEN CAST(i AS DOUBLE)
            WHEN k = 'real' AND target NOT IN ('INT64', 'TEXT') THEN r
            WHEN target = 'FLOAT64' THEN as_double END AS float64,
        CASE WHEN target <> 'BOOL' THEN NULL WHEN k = 'integer' THEN i <> 0 ELSE as_bool END AS bool,
        CASE WHEN k = 'integer' AND target = 'TEXT' THEN CAST(i AS VARCHAR)
            WHEN k = 'real' AND target = 'TEXT' THEN regexp_replace(CAST(r AS VARCHAR), '\\.0$', '')
            WHEN k <> 'text' THEN NULL
            WHEN target = 'INT64' AND as_long IS NOT NULL THEN NULL
            WHEN target = 'FLOAT64' AND as_double IS NOT NULL THEN NULL
            WHEN target = 'BOOL' AND as_bool IS NOT NULL THEN NULL ELSE t END AS text,
        CASE WHEN k = 'blob' THEN hex(b) END AS blob_hex FROM parsed),
    tagged AS (SELECT *, CASE WHEN int64 IS NOT NULL THEN 'INT64' WHEN float64 IS NOT NULL THEN 'FLOAT64'
        WHEN bool IS NOT NULL THEN 'BOOL' WHEN text IS NOT NULL THEN 'TEXT'
        WHEN blob_hex IS NOT NULL THEN 'BLOB' ELSE 'NULL' END AS kind FROM coerced)"""


def order_cells(spark: SparkSession, sf: str) -> DataFrame:
    raw = load(spark, sf, "orders").selectExpr(*_listed(CELLS))
    cell = make_cell(F.col("k"), F.col("i"), F.col("r"), F.col("t"), F.col("b").cast("binary"))
    return raw.select("o_orderkey", "target", cell.alias("cell"))


def _listed(expressions: str) -> list[str]:
    """The expressions of a select list, cut at commas outside parentheses."""
    items, depth, start = [], 0, 0
    for n, ch in enumerate(expressions):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(expressions[start:n])
            start = n + 1
    return [*items, expressions[start:]]


@query(
    "coerce_mixed",
    f"WITH {PARSED} SELECT o_orderkey, target, kind, int64, float64, bool, text, blob_hex FROM tagged",
)
def coerce_mixed(spark: SparkSession, sf: str) -> DataFrame:
    cells = order_cells(spark, sf)
    coerced = cells.select("o_orderkey", "target", coerce_cell(F.col("cell"), F.col("target")).alias("v"))
    return coerced.select(
        "o_orderkey", "target", "v.kind", "v.int64", "v.float64", "v.bool", "v.text", F.hex("v.blob").alias("blob_hex")
    )


@query(
    "kind_profile",
    f"""WITH {PARSED},
        profile AS (SELECT 'cell' AS "column", k AS kind FROM tagged UNION ALL SELECT 'value', kind FROM tagged
            UNION ALL SELECT 'o_orderkey', 'INT64' FROM tagged
            UNION ALL SELECT 'short', CASE WHEN length(target) < 5 THEN 'TEXT' ELSE 'NULL' END FROM tagged)
        SELECT "column", kind, count(*) AS n FROM profile GROUP BY ALL""",
)
def kinds(spark: SparkSession, sf: str) -> DataFrame:
    cells = order_cells(spark, sf)
    value = coerce_cell(F.col("cell"), F.col("target"))
    short = F.when(F.length("target") < 5, F.col("target"))
    return kind_profile(cells.select("o_orderkey", "cell", value.alias("value"), short.alias("short")))


@query(
    "null_profile",
    """SELECT 'customer' AS "column", count(*) - count(nullif(c_mktsegment, 'MACHINERY')) AS n FROM customer
       UNION ALL SELECT 'balance', count(*) FILTER (WHERE c_acctbal < 0) FROM customer
       UNION ALL SELECT 'c_custkey', 0 FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)""",
)
def nulls(spark: SparkSession, sf: str) -> DataFrame:
    return null_profile(
        load(spark, sf, "customer").select(
            "c_custkey",
            F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("customer"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        )
    )


# Text columns with values that do not fit their types; the same expressions serve both engines.
NOISY = """o_orderkey,
    CASE WHEN o_totalprice > 450000 THEN 'EUR ' || CAST(o_totalprice AS STRING)
        WHEN o_orderstatus = 'P' THEN ' ' || CAST(o_totalprice AS STRING) || ' '
        ELSE CAST(o_totalprice AS STRING) END AS price,
    CASE WHEN extract(day FROM o_orderdate) = 13 THEN CAST(extract(year FROM o_orderdate) AS STRING)
        WHEN extract(day FROM o_orderdate) = 29 THEN '2001-02-29'
        ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS placed,
    CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN '0' ELSE CASE WHEN o_custkey < 300 THEN 'y' ELSE 'null' END END
        AS done,
    CASE WHEN o_custkey > 1400 THEN '#' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey AS STRING) END AS custkey,
    CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_orderdate AS STRING) || 'Z'
        ELSE substr(CAST(o_orderdate AS STRING), 1, 16) END AS moment"""
NOISY_TYPES = {
    "price": "DECIMAL(12,1)", "placed": "DATE", "done": "BOOL", "custkey": "INT64", "moment": "TIMESTAMP",
}
ASSIGNED = f"""noisy AS (SELECT {NOISY} FROM orders),
    typed AS (SELECT *, TRY_CAST(trim(price) AS DECIMAL(12,1)) AS price_t,
        CASE WHEN regexp_full_match(placed, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(placed AS DATE) END
            AS placed_t,
        CASE done WHEN 'yes' THEN true WHEN '0' THEN false END AS done_t,
        TRY_CAST(custkey AS BIGINT) AS custkey_t,
        CASE WHEN moment NOT LIKE '%Z' THEN TRY_CAST(moment || ':00' AS TIMESTAMP) END AS moment_t FROM noisy),
    checked AS (SELECT *, concat_ws(',', CASE WHEN price_t IS NULL THEN 'price' END,
        CASE WHEN placed_t IS NULL THEN 'placed' END,
        CASE WHEN done_t IS NULL AND done <> 'null' THEN 'done' END,
        CASE WHEN custkey_t IS NULL THEN 'custkey' END,
        CASE WHEN moment_t IS NULL THEN 'moment' END) AS bad FROM typed)"""


def noisy_orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(*_listed(NOISY))


@query(
    "assign_types",
    f"""WITH {ASSIGNED} SELECT o_orderkey, CAST(price_t AS VARCHAR) AS price, placed_t AS placed, done_t AS done,
        custkey_t AS custkey, moment_t AS moment FROM checked WHERE bad = ''""",
)
def assign_good(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = assign_types(noisy_orders(spark, sf), NOISY_TYPES)
    return good.withColumn("price", F.col("price").cast("string"))


@query(
    "assign_rejects",
    f"""WITH {ASSIGNED} SELECT o_orderkey, bad, CASE WHEN bad LIKE 'price%' THEN trim(price)
        WHEN bad LIKE 'placed%' THEN placed WHEN bad LIKE 'done%' THEN done WHEN bad LIKE 'custkey%' THEN custkey
        ELSE moment END AS first_text FROM checked WHERE bad <> ''""",
)
def assign_bad(spark: SparkSession, sf: str) -> DataFrame:
    _, rejects = assign_types(noisy_orders(spark, sf), NOISY_TYPES)
    return rejects.select(
        "o_orderkey",
        F.array_join(F.col(ERRORS)["column"], ",").alias("bad"),
        F.col(ERRORS)[0]["text"].alias("first_text"),
    )


@query(
    "assign_cells",
    f"""WITH {PARSED} SELECT o_orderkey,
        CASE k WHEN 'integer' THEN CAST(CAST(i AS DECIMAL(9,2)) AS VARCHAR)
            WHEN 'real' THEN CAST(TRY_CAST(r AS DECIMAL(9,2)) AS VARCHAR)
            WHEN 'text' THEN CAST(CASE WHEN as_double IS NOT NULL THEN TRY_CAST(as_double AS DECIMAL(9,2)) END AS VARCHAR)
            END AS cell FROM parsed
        WHERE k IN ('null', 'integer') OR (k = 'real' AND abs(r) < 9999999)
            OR (k = 'text' AND abs(as_double) < 9999999)""",
)
def assign_decimal_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = order_cells(spark, sf).drop("target")
    good, _ = assign_types(coerce_cells(cells, {"cell": "DECIMAL(9,2)"}), {"cell": "DECIMAL(9,2)"})
    return good.withColumn("cell", F.col("cell").cast("string"))


@query(
    "reconcile",
    f"""WITH {ASSIGNED} SELECT 'orders' AS "table", count(*) AS source_rows, count(*) FILTER (WHERE bad = '') AS
        loaded_rows, count(*) FILTER (WHERE bad <> '') AS rejected_rows, true AS ok FROM checked
        UNION ALL SELECT 'part', count(*), count(*) FILTER (WHERE p_size < 40), 0,
            count(*) = count(*) FILTER (WHERE p_size < 40) FROM part""",
)
def reconciled(spark: SparkSession, sf: str) -> DataFrame:
    source, part = noisy_orders(spark, sf), load(spark, sf, "part")
    good, rejects = assign_types(source, NOISY_TYPES)
    return reconcile(
        {"orders": source, "part": part}, {"orders": good, "part": part.filter("p_size < 40")}, {"orders": rejects}
    )


# Edited texts and the column types they are read toward; the same expressions serve both engines.
EDITS = """event_id,
    CASE event_type WHEN 'view' THEN 'INTEGER' WHEN 'signup' THEN 'double precision' WHEN 'error' THEN 'Boolean'
        WHEN 'click' THEN 'VARCHAR(20)' ELSE 'BIGINT' END AS type_name,
    CASE user_id % 8 WHEN 0 THEN '  ' || CAST(event_id AS STRING) || ' ' WHEN 1 THEN 'NuLL' WHEN 2 THEN '   '
        WHEN 3 THEN 'yes' WHEN 4 THEN CAST(value AS STRING) WHEN 5 THEN ' 0' WHEN 6 THEN props
        ELSE '1.5e3' END AS edited"""


@query(
    "parse_typed",
    f"""WITH edits AS (SELECT {EDITS} FROM events),
        cut AS (SELECT *, CASE WHEN trim(edited) <> '' AND lower(trim(edited)) <> 'null' THEN trim(edited) END AS t
            FROM edits),
        parsed AS (SELECT *,
            CASE WHEN type_name IN ('INTEGER', 'BIGINT') AND regexp_full_match(t, '[+-]?[0-9]+')
                THEN TRY_CAST(t AS BIGINT) END AS int64,
            CASE WHEN type_name LIKE 'double%' AND regexp_full_match(t, '[0-9]+\\.?[0-9]*(e[0-9]+)?')
                THEN TRY_CAST(t AS DOUBLE) END AS float64,
            CASE WHEN type_name <> 'Boolean' THEN NULL WHEN t IN ('yes', '1', 't', 'true') THEN true
                WHEN t IN ('no', '0', 'f', 'false') THEN false END AS bool FROM cut)
        SELECT event_id, type_name, int64, float64, bool,
            CASE WHEN int64 IS NULL AND float64 IS NULL AND bool IS NULL THEN t END AS text FROM parsed""",
)
def parse_typed(spark: SparkSession, sf: str) -> DataFrame:
    edits = load(spark, sf, "events").selectExpr(*_listed(EDITS))
    value = parse_for_type(F.col("edited"), F.col("type_name"))
    return edits.select("event_id", "type_name", value.alias("v")).select(
        "event_id", "type_name", "v.int64", "v.float64", "v.bool", "v.text"
    )


@query(
    "assign_uuids",
    """WITH named AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)
       SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4)
           || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS id, doc_id % 4 = 3 AS rejected FROM named""",
)
def assigned_uuids(spark: SparkSession, sf: str) -> DataFrame:
    """UUIDs as text and as 16 bytes; blobs of another length are rejected."""
    digits = F.md5(F.col("doc_id").cast("string"))
    dashed = F.upper(F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    part = F.col("doc_id") % 4
    cell = F.struct(
        F.when(part == 0, "text").otherwise("blob").alias("k"),
        F.lit(None).cast("bigint").alias("i"),
        F.lit(None).cast("double").alias("r"),
        F.when(part == 0, dashed).alias("t"),
        F.when(part != 0, F.unhex(F.when(part == 3, F.left(digits, F.lit(30))).otherwise(digits))).alias("b"),
    )
    cells = load(spark, sf, "documents").select("doc_id", cell.alias("id"))
    good, rejects = assign_types(cells, {"id": "UUID"})
    return good.withColumn("rejected", F.lit(False)).unionByName(
        rejects.drop(ERRORS).withColumn("rejected", F.lit(True))
    )
