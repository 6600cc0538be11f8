"""Rendering of typed columns and splitting of scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions.floats import display_double, plain_double
from typeloom.functions.render import preview, render_display, render_json, render_literal
from typeloom.functions.types import KIND_KEY
from typeloom.operators.scripts import split_scripts
from typeloom.plans.registry import load, query

SECONDS = "'%Y-%m-%d %H:%M:%S'"


@query(
    "render_display",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
        coalesce(nullif(o_orderstatus, 'P'), 'NULL') AS o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
        strftime(o_orderdate, {SECONDS}) AS o_orderdate, o_orderpriority,
        strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_custkey > 700 THEN 'true' ELSE 'false' END AS late
        FROM orders""",
)
def display(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumns(
        {
            "o_orderstatus": F.nullif("o_orderstatus", F.lit("P")),
            "day": F.col("o_orderdate").cast("date"),
            "late": F.col("o_custkey") > 700,
        }
    )
    return render_display(orders)


@query(
    "render_literal",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
        CASE WHEN o_orderstatus = 'P' THEN 'NULL' ELSE '''it''''s ' || o_orderstatus || '''' END AS o_orderstatus,
        CAST(o_totalprice AS VARCHAR) AS o_totalprice,
        '''' || strftime(o_orderdate, {SECONDS}) || '''' AS o_orderdate, '''' || o_orderpriority || '''' AS o_orderpriority,
        CASE WHEN o_custkey > 700 THEN 'TRUE' ELSE 'FALSE' END AS late,
        'X''' || lower(hex(o_orderpriority)) || '''' AS raw FROM orders""",
)
def literal(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumns(
        {
            "o_orderstatus": F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("it's "), "o_orderstatus")),
            "late": F.col("o_custkey") > 700,
            "raw": F.col("o_orderpriority").cast("binary"),
        }
    )
    return render_literal(orders)


@query(
    "render_json",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ||
        CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS ts,
        value > 20 AS large, CASE WHEN user_id % 3 <> 0 THEN value END AS ratio,
        CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS amount, props FROM events""",
)
def json_values(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    ratio = F.when(F.col("user_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return render_json(
        events.select(
            "event_id",
            "ts",
            (F.col("value") > 20).alias("large"),
            ratio.alias("ratio"),
            F.col("value").cast("decimal(12,2)").alias("amount"),
            "props",
        )
    )


@query(
    "float_text",
    """SELECT l_orderkey, l_partkey, l_suppkey, CAST(net AS VARCHAR) AS shown,
        regexp_replace(CAST(net AS VARCHAR), '\\.0$', '') AS plain,
        CAST(share AS VARCHAR) AS share_shown
        FROM (SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net, l_quantity / 49 AS share FROM lineitem)""",
)
def float_text(spark: SparkSession, sf: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", net.alias("net"), (F.col("l_quantity") / 49).alias("share")
    )
    return lines.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        display_double(F.col("net")).alias("shown"),
        plain_double(F.col("net")).alias("plain"),
        display_double(F.col("share")).alias("share_shown"),
    )


def _byte_sql(position: int) -> str:
    """DuckDB text of the byte at a 1-based position of the hex digits ``h``."""
    high, low = (f"(instr('0123456789abcdef', substr(h, {2 * position - 1 + n}, 1)) - 1)" for n in (0, 1))
    return f"CAST({high} * 16 + {low} AS VARCHAR)"


_QUAD_SQL = " || '.' || ".join(_byte_sql(n) for n in range(1, 5))
_GROUPS_SQL = " || ':' || ".join(f"regexp_replace(substr(h, {n}, 4), '^0{{1,3}}', '')" for n in range(1, 33, 4))
_MAC_SQL = " || ':' || ".join(f"substr(h, {n}, 2)" for n in range(1, 13, 2))


@query(
    "kinds_display",
    f"""WITH hashed AS (SELECT *, md5(CAST(event_id AS VARCHAR)) AS h FROM events)
        SELECT CAST(event_id AS VARCHAR) AS id,
        substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-'
            || substr(h, 21, 12) AS uuid,
        '0x' || h || h AS short_blob, '0x' || h || '… (48 bytes)' AS long_blob,
        strftime(ts, '%Y-%m-%d %H:%M:%S') ||
            CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || 'Z' AS moment,
        strftime(ts, '%Y-%m-%d') AS day,
        strftime(ts, '%H:%M:%S') ||
            CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS clock,
        CASE WHEN event_type = 'error' THEN 'NULL' ELSE CAST(CAST(-value AS DECIMAL(18,4)) AS VARCHAR) END AS amount,
        CASE event_type WHEN 'view' THEN {_QUAD_SQL} WHEN 'click' THEN {_GROUPS_SQL} ELSE '<invalid ip>' END AS ip,
        {_QUAD_SQL} || '/' || CAST(user_id % 33 AS VARCHAR) AS cidr,
        {_MAC_SQL} AS mac,
        'enum#' || CAST(user_id AS VARCHAR) || ':' || CAST(event_id % 7 AS VARCHAR) AS label,
        CAST(user_id AS VARCHAR) || ' mon ' || CAST(event_id % 31 AS VARCHAR) || ' d ' || CAST(event_id AS VARCHAR)
            || ' us' AS span,
        'GEOMETRY(16 bytes)' AS shape FROM hashed""",
)
def kinds_display(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.unhex(F.md5(F.col("event_id").cast("string")))
    events = load(spark, sf, "events").withColumn("h", digest)
    midnight = F.date_trunc("day", F.col("ts"))
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")

    def kind(column, name: str, label: str):
        return column.alias(name, metadata={KIND_KEY: label})

    def small(column):
        return F.col(column).cast("int")

    family = F.when(F.col("event_type") == "view", 4).when(F.col("event_type") == "click", 6).otherwise(9)
    return render_display(
        events.select(
            F.col("event_id").alias("id"),
            kind(F.col("h"), "uuid", "UUID"),
            F.concat("h", "h").alias("short_blob"),
            F.concat("h", "h", "h").alias("long_blob"),
            F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, "ts")).alias("moment"),
            F.col("ts").cast("date").alias("day"),
            kind(F.timestamp_diff("MICROSECOND", midnight.cast("timestamp_ntz"), F.col("ts")), "clock", "TIME"),
            F.when(F.col("event_type") != "error", -F.col("value").cast("decimal(18,4)")).alias("amount"),
            F.struct(family.alias("family"), F.col("h").alias("addr")).alias("ip"),
            F.struct(
                F.lit(4).alias("family"), (F.col("user_id") % 33).cast("int").alias("prefix_len"), F.col("h").alias("network")
            ).alias("cidr"),
            F.struct(F.lit(6).alias("len"), F.substring("h", 1, 8).alias("bytes")).alias("mac"),
            F.struct(
                small("user_id").alias("enum_type_id"), (F.col("event_id") % 7).cast("int").alias("label_id")
            ).alias("label"),
            F.struct(
                small("user_id").alias("months"), (F.col("event_id") % 31).cast("int").alias("days"),
                F.col("event_id").alias("micros"),
            ).alias("span"),
            kind(F.col("h"), "shape", "GEOMETRY"),
        )
    )


@query(
    "preview",
    """WITH flat AS (SELECT doc_id, replace(replace(text, chr(10), ' '), chr(13), '') AS t, lang FROM documents)
       SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS text,
       lang FROM flat""",
)
def previews(spark: SparkSession, sf: str) -> DataFrame:
    return preview(load(spark, sf, "documents").select("doc_id", "text", "lang"), n=60)


# The statements of one script per document, and how they are put together; the same expressions serve both engines.
SCRIPT_PARTS = (
    "'INSERT INTO docs VALUES (''' || replace(text, '''', '''''') || ''')'",
    "'/* about; ' || lang || ' */ UPDATE docs SET \"a;b\" = 1'",
    "'-- from ' || source || '; a note' || chr(10) || 'SELECT ''x'' || \"c''d\"'",
)
SCRIPT = f"{SCRIPT_PARTS[0]} || '; ;' || chr(10) || {SCRIPT_PARTS[1]} || ';' || {SCRIPT_PARTS[2]} || ' ; '"


@query(
    "split_scripts",
    " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, {part} AS statement FROM documents" for n, part in enumerate(SCRIPT_PARTS, 1)
    ),
)
def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    scripts = load(spark, sf, "documents").select("doc_id", F.expr(SCRIPT).alias("script"))
    return split_scripts(scripts, "doc_id", "script")
