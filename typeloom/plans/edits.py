"""Batches of edits on orders and lineitem, derived from the other given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.operators.audit import FOREIGN_KEY, Constraint
from typeloom.operators.changes import (
    apply_changes, apply_deletes, apply_inserts, apply_updates, change_report, delete_cascade, row_identity,
)
from typeloom.plans.registry import load, query

# One edit per line item: which cell of its order, and the new text; the same expressions serve both engines.
# The sequence number, from price, part and line, is unique per order.
CHANGE_VALUES = {
    "o_orderkey": "l_orderkey",
    "seq": "CAST(round(l_extendedprice * 100) AS BIGINT) * 10000000 + l_partkey * 10 + l_linenumber",
    "column": """CASE l_returnflag WHEN 'A' THEN 'o_totalprice' WHEN 'N' THEN 'o_orderstatus'
        ELSE 'o_orderpriority' END""",
    "value": """CASE l_returnflag WHEN 'A' THEN ' ' || CAST(l_extendedprice AS STRING) WHEN 'N' THEN l_linestatus
        ELSE CASE WHEN l_quantity > 25 THEN 'Null' ELSE 'q' || CAST(l_linenumber AS STRING) END END""",
}
CHANGE = ", ".join(f'{value} AS "{field}"' for field, value in CHANGE_VALUES.items())


def order_changes(spark: SparkSession, sf: str) -> DataFrame:
    columns = [F.expr(value).alias(field) for field, value in CHANGE_VALUES.items()]
    return load(spark, sf, "lineitem").select(*columns)


@query(
    "apply_updates",
    f"""WITH changes AS (SELECT {CHANGE} FROM lineitem),
        last AS (SELECT * FROM changes QUALIFY row_number() OVER
            (PARTITION BY o_orderkey, "column" ORDER BY seq DESC, "value" DESC) = 1)
        SELECT o.o_orderkey, o_custkey, coalesce(s."value", o_orderstatus) AS o_orderstatus,
            coalesce(CAST(trim(p."value") AS DOUBLE), o_totalprice) AS o_totalprice, o_orderdate,
            CASE WHEN r."value" = 'Null' THEN NULL ELSE coalesce(r."value", o_orderpriority) END AS o_orderpriority
        FROM orders o
        LEFT JOIN last s ON s.o_orderkey = o.o_orderkey AND s."column" = 'o_orderstatus'
        LEFT JOIN last p ON p.o_orderkey = o.o_orderkey AND p."column" = 'o_totalprice'
        LEFT JOIN last r ON r.o_orderkey = o.o_orderkey AND r."column" = 'o_orderpriority'""",
)
def updated_orders(spark: SparkSession, sf: str) -> DataFrame:
    return apply_updates(load(spark, sf, "orders"), order_changes(spark, sf), ["o_orderkey"])


@query(
    "apply_deletes",
    """SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000)""",
)
def remaining_orders(spark: SparkSession, sf: str) -> DataFrame:
    gone = load(spark, sf, "customer").filter("c_acctbal < 1000").select(F.col("c_custkey").alias("o_custkey"))
    return apply_deletes(load(spark, sf, "orders"), gone, ["o_custkey"])


@query(
    "row_identity",
    """SELECT l_returnflag, l_linestatus, l_linenumber, l_tax FROM lineitem
       WHERE NOT (l_tax IS NOT DISTINCT FROM 0 AND l_linenumber > 4)""",
)
def delete_by_whole_row(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_tax")
    return apply_deletes(lines, lines.filter("l_tax = 0 AND l_linenumber > 4"), row_identity(lines))


@query(
    "apply_inserts",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
       UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey), c_custkey,
           CASE WHEN c_acctbal < 0 THEN NULL ELSE 'N' END, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END,
           TIMESTAMP '2020-02-02 00:00:00', c_mktsegment FROM customer""",
)
def inserted_orders(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("c_acctbal") < 0, "null").otherwise("")
    price = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal").cast("string"))
    rows = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("seq"),
        F.create_map(
            F.lit("o_custkey"), F.col("c_custkey").cast("string"),
            F.lit("o_orderstatus"), status,
            F.lit("o_totalprice"), price,
            F.lit("o_orderpriority"), F.concat(F.lit(" "), "c_mktsegment"),
        ).alias("set"),
    )
    defaults = {"o_orderstatus": "N", "o_totalprice": 0.0, "o_orderdate": F.lit("2020-02-02 00:00:00")}
    return apply_inserts(load(spark, sf, "orders"), rows, defaults, auto_number="o_orderkey")


# A mixed log on orders and on new keys, one entry per line item; the same expressions serve both engines.
LOG = """l_orderkey + CASE WHEN l_linenumber > 5 THEN 1000000000 ELSE 0 END AS o_orderkey,
    CAST(round(l_extendedprice * 100) AS BIGINT) * 10000000 + l_partkey * 10 + l_linenumber AS seq,
    CASE WHEN l_quantity > 45 THEN 'delete' WHEN l_linenumber IN (1, 6) THEN 'insert' ELSE 'update' END AS op,
    CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS status,
    CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS STRING) END AS price"""


def order_log(spark: SparkSession, sf: str) -> DataFrame:
    entries = load(spark, sf, "lineitem").selectExpr(*LOG.split(",\n"))
    given = F.map_concat(
        F.when(F.col("status").isNotNull(), F.create_map(F.lit("o_orderstatus"), F.col("status"))).otherwise(_nothing()),
        F.when(F.col("price").isNotNull(), F.create_map(F.lit("o_totalprice"), F.col("price"))).otherwise(_nothing()),
    )
    return entries.select("o_orderkey", "seq", "op", given.alias("set"))


def _nothing():
    return F.create_map().cast("map<string,string>")


@query(
    "apply_changes",
    f"""WITH log AS (SELECT {LOG} FROM lineitem),
        ends AS (SELECT o_orderkey, max(seq) FILTER (WHERE op = 'delete') AS deleted FROM log GROUP BY o_orderkey),
        fresh AS (SELECT log.*, coalesce(deleted, -1) AS deleted FROM log JOIN ends USING (o_orderkey)
            WHERE seq > coalesce(deleted, -1)),
        born AS (SELECT o_orderkey, seq AS since, NULL AS o_custkey, status AS o_orderstatus,
                CAST(price AS DOUBLE) AS o_totalprice, NULL AS o_orderdate, 'new' AS o_orderpriority
                FROM fresh WHERE op = 'insert'
            UNION ALL SELECT o_orderkey, -1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
                FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ends WHERE deleted IS NOT NULL))
        SELECT o_orderkey, o_custkey,
            coalesce((SELECT arg_max(u.status, u.seq) FROM fresh u WHERE u.o_orderkey = born.o_orderkey
                AND u.op = 'update' AND u.status IS NOT NULL AND u.seq > born.since), o_orderstatus) AS o_orderstatus,
            coalesce((SELECT CAST(arg_max(u.price, u.seq) AS DOUBLE) FROM fresh u WHERE u.o_orderkey = born.o_orderkey
                AND u.op = 'update' AND u.price IS NOT NULL AND u.seq > born.since), o_totalprice) AS o_totalprice,
            o_orderdate, o_orderpriority FROM born""",
)
def changed_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    return apply_changes(orders, order_log(spark, sf), ["o_orderkey"], {"o_orderpriority": "new"})


@query(
    "change_report",
    f"""WITH log AS (SELECT {LOG} FROM lineitem)
        SELECT 'insert' AS op, count(*) AS affected FROM log WHERE op = 'insert'
        UNION ALL SELECT 'update', count(*) FROM log JOIN orders USING (o_orderkey) WHERE op = 'update'
        UNION ALL SELECT 'delete', count(DISTINCT o_orderkey) FROM log JOIN orders USING (o_orderkey)
            WHERE op = 'delete'""",
)
def affected_orders(spark: SparkSession, sf: str) -> DataFrame:
    return change_report(load(spark, sf, "orders"), order_log(spark, sf), ["o_orderkey"])


CASCADE = [
    Constraint("nation", FOREIGN_KEY, ("n_regionkey",), "region", ("r_regionkey",)),
    Constraint("customer", FOREIGN_KEY, ("c_nationkey",), "nation", ("n_nationkey",)),
    Constraint("supplier", FOREIGN_KEY, ("s_nationkey",), "nation", ("n_nationkey",)),
    Constraint("orders", FOREIGN_KEY, ("o_custkey",), "customer", ("c_custkey",)),
    Constraint("lineitem", FOREIGN_KEY, ("l_orderkey",), "orders", ("o_orderkey",)),
    Constraint("lineitem", FOREIGN_KEY, ("l_suppkey",), "supplier", ("s_suppkey",)),
]
ROW_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "orders": "o_orderkey", "lineitem": "l_orderkey",
}


@query(
    "delete_cascade",
    """WITH r AS (SELECT * FROM region WHERE r_name <> 'ASIA'),
        n AS (SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM r)),
        c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
        s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)),
        o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
        l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)
            AND l_suppkey IN (SELECT s_suppkey FROM s))
        SELECT 'region' AS "table", CAST(r_regionkey AS BIGINT) AS row_key FROM r
        UNION ALL SELECT 'nation', n_nationkey FROM n UNION ALL SELECT 'customer', c_custkey FROM c
        UNION ALL SELECT 'supplier', s_suppkey FROM s UNION ALL SELECT 'orders', o_orderkey FROM o
        UNION ALL SELECT 'lineitem', l_orderkey FROM l""",
)
def cascaded(spark: SparkSession, sf: str) -> DataFrame:
    tables = {t: load(spark, sf, t) for t in ROW_KEYS}
    gone = tables["region"].filter("r_name = 'ASIA'").select("r_regionkey")
    kept = delete_cascade(tables, CASCADE, "region", gone, ["r_regionkey"])
    first, *rest = [
        df.select(F.lit(t).alias("table"), F.col(ROW_KEYS[t]).cast("bigint").alias("row_key")) for t, df in kept.items()
    ]
    for df in rest:
        first = first.unionByName(df)
    return first


# Customers stand for the order that brought them, where there is one: customers and orders refer to each other.
CYCLE = [
    Constraint("orders", FOREIGN_KEY, ("o_custkey",), "customer", ("c_custkey",)),
    Constraint("customer", FOREIGN_KEY, ("c_order",), "orders", ("o_orderkey",)),
    Constraint("lineitem", FOREIGN_KEY, ("l_orderkey",), "orders", ("o_orderkey",)),
]
BROUGHT = "CASE WHEN c_custkey % 2 = 1 THEN c_custkey * 10 END AS c_order"


@query(
    "delete_cascade_cycle",
    f"""WITH RECURSIVE c AS (SELECT c_custkey, c_acctbal, {BROUGHT} FROM customer),
        edge AS (SELECT 'orders' AS t, o_orderkey AS k, 'customer' AS above, o_custkey AS above_k FROM orders
            UNION ALL SELECT 'customer', c_custkey, 'orders', c_order FROM c),
        gone AS (SELECT 'customer' AS t, c_custkey AS k FROM c WHERE c_acctbal < -500
            UNION SELECT edge.t, edge.k FROM edge JOIN gone ON above = gone.t AND above_k = gone.k)
        SELECT 'customer' AS "table", CAST(c_custkey AS BIGINT) AS row_key FROM c
            WHERE c_custkey NOT IN (SELECT k FROM gone WHERE t = 'customer')
        UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT k FROM gone WHERE t = 'orders')
        UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem
            WHERE l_orderkey NOT IN (SELECT k FROM gone WHERE t = 'orders')""",
)
def cascaded_over_a_cycle(spark: SparkSession, sf: str) -> DataFrame:
    tables = {t: load(spark, sf, t) for t in ("orders", "lineitem")}
    tables["customer"] = load(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal", BROUGHT)
    gone = tables["customer"].filter("c_acctbal < -500").select("c_custkey")
    kept = delete_cascade(tables, CYCLE, "customer", gone, ["c_custkey"])
    rows = [
        df.select(F.lit(t).alias("table"), F.col(ROW_KEYS[t]).cast("bigint").alias("row_key")) for t, df in kept.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
