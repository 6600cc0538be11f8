"""Plain SQL-surface queries: projection, filters, joins, aggregation, sorting and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.operators.browse import browse, browse_after
from typeloom.operators.changes import key_predicate
from typeloom.operators.scripts import run_script
from typeloom.plans.registry import load, query


@query("project", "SELECT o_orderkey AS order_id, o_totalprice * 0.1 AS tenth FROM orders")
def project(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    return orders.select(F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice") * 0.1).alias("tenth"))


@query(
    "filter_logic",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
       WHERE (l_quantity > 45 OR l_discount < 0.01) AND NOT l_returnflag = 'R'""",
)
def filter_logic(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ((F.col("l_quantity") > 45) | (F.col("l_discount") < 0.01)) & ~(F.col("l_returnflag") == "R")
    return load(spark, sf, "lineitem").filter(wanted).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "filter_predicates",
    """SELECT p_partkey, p_name, p_size FROM part
       WHERE p_size BETWEEN 5 AND 30 AND p_name LIKE '%ring' AND p_type IN ('ECONOMY', 'SMALL')
         AND p_brand IS NOT NULL""",
)
def filter_predicates(spark: SparkSession, sf: str) -> DataFrame:
    wanted = (
        F.col("p_size").between(5, 30)
        & F.col("p_name").like("%ring")
        & F.col("p_type").isin("ECONOMY", "SMALL")
        & F.col("p_brand").isNotNull()
    )
    return load(spark, sf, "part").filter(wanted).select("p_partkey", "p_name", "p_size")


@query(
    "case_when",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle'
       ELSE 'low' END AS band FROM orders""",
)
def case_when(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    band = F.when(price > 300000, "high").when(price > 100000, "middle").otherwise("low")
    return load(spark, sf, "orders").select("o_orderkey", band.alias("band"))


@query(
    "coalesce_first",
    """SELECT c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), c_name) AS label FROM customer""",
)
def coalesce_first(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.nullif("c_mktsegment", F.lit("MACHINERY"))
    return load(spark, sf, "customer").select("c_custkey", F.coalesce(segment, "c_name").alias("label"))


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "key_predicate",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
       WHERE l_linenumber IS NOT DISTINCT FROM 3 AND nullif(l_returnflag, 'R') IS NOT DISTINCT FROM NULL""",
)
def keyed_rows(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("R")))
    found = lines.filter(key_predicate({"l_linenumber": 3, "flag": None}))
    return found.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query(
    "run_script",
    """SELECT n_name AS name, 'nation;' AS origin FROM nation
       UNION ALL SELECT r_name, 'region;' FROM region
       UNION ALL SELECT c_name, 'customer;' FROM customer""",
)
def script_results(spark: SparkSession, sf: str) -> DataFrame:
    for table in ("nation", "region", "customer"):
        load(spark, sf, table).createOrReplaceTempView(f"script_{table}")
    script = """
        SELECT n_name AS name, 'nation;' AS origin FROM script_nation;
        ; -- a comment; with a semicolon
        SELECT r_name AS name, 'region;' AS origin FROM script_region /* ; */;
        SELECT c_name AS name, 'customer;' AS origin FROM script_customer
    """
    first, second, third = run_script(spark, script)
    return first.unionByName(second).unionByName(third)


@query(
    "join_inner",
    """SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey
       ORDER BY o_orderkey""",
)
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = load(spark, sf, "orders"), load(spark, sf, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.select("o_orderkey", "o_totalprice", "c_name").orderBy("o_orderkey")


@query(
    "join_left",
    """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN
       (SELECT * FROM orders WHERE o_totalprice > 400000) big ON c_custkey = o_custkey""",
)
def join_left(spark: SparkSession, sf: str) -> DataFrame:
    big = load(spark, sf, "orders").filter("o_totalprice > 400000")
    customer = load(spark, sf, "customer")
    return customer.join(big, customer.c_custkey == big.o_custkey, "left").select("c_custkey", "o_orderkey")


@query(
    "join_right",
    """SELECT o_orderkey, c_name FROM (SELECT * FROM customer WHERE c_acctbal < 0) poor
       RIGHT JOIN orders ON c_custkey = o_custkey""",
)
def join_right(spark: SparkSession, sf: str) -> DataFrame:
    poor = load(spark, sf, "customer").filter("c_acctbal < 0")
    orders = load(spark, sf, "orders")
    return poor.join(orders, poor.c_custkey == orders.o_custkey, "right").select("o_orderkey", "c_name")


@query(
    "join_full",
    """SELECT c_custkey, s_suppkey, c_nationkey FROM
       (SELECT * FROM customer WHERE c_mktsegment = 'FURNITURE') c FULL OUTER JOIN supplier
       ON c_custkey = s_suppkey""",
)
def join_full(spark: SparkSession, sf: str) -> DataFrame:
    buyers = load(spark, sf, "customer").filter("c_mktsegment = 'FURNITURE'")
    supplier = load(spark, sf, "supplier")
    joined = buyers.join(supplier, buyers.c_custkey == supplier.s_suppkey, "outer")
    return joined.select("c_custkey", "s_suppkey", "c_nationkey")


@query(
    "join_semi",
    """SELECT c_custkey, c_name FROM customer
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    urgent = load(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    customer = load(spark, sf, "customer")
    return customer.join(urgent, customer.c_custkey == urgent.o_custkey, "left_semi").select("c_custkey", "c_name")


@query(
    "join_anti",
    """SELECT p_partkey, p_name FROM part
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)""",
)
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    large = load(spark, sf, "lineitem").filter("l_quantity > 40")
    part = load(spark, sf, "part")
    return part.join(large, part.p_partkey == large.l_partkey, "left_anti").select("p_partkey", "p_name")


@query(
    "group_by",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity,
       round(avg(l_discount), 6) AS discount, min(l_extendedprice) AS lowest, max(l_shipdate) AS latest
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def group_by(spark: SparkSession, sf: str) -> DataFrame:
    return (
        load(spark, sf, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_quantity").alias("quantity"),
            F.round(F.avg("l_discount"), 6).alias("discount"),
            F.min("l_extendedprice").alias("lowest"),
            F.max("l_shipdate").alias("latest"),
        )
    )


@query(
    "having",
    """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
       GROUP BY o_custkey HAVING count(*) >= 12""",
)
def having(spark: SparkSession, sf: str) -> DataFrame:
    per_customer = (
        load(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )
    return per_customer.filter(F.col("n") >= 12)


@query("global_count", "SELECT count(*) AS n FROM lineitem")
def global_count(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "count_distinct",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
       FROM lineitem GROUP BY l_returnflag""",
)
def count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return (
        load(spark, sf, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))
    )


@query(
    "order_by",
    "SELECT c_custkey, c_acctbal, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey",
)
def order_by(spark: SparkSession, sf: str) -> DataFrame:
    customer = load(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_name")
    return customer.orderBy(F.desc("c_acctbal"), "c_custkey")


@query(
    "top_orders",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey
       LIMIT 25 OFFSET 10""",
)
def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query("browse_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 600")
def browse_page(spark: SparkSession, sf: str) -> DataFrame:
    return browse(load(spark, sf, "orders"), ["o_orderkey"], page=3)


@query(
    "browse_after",
    """SELECT l_returnflag, l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem
       WHERE (l_returnflag, l_orderkey, l_partkey, l_suppkey) > ('N', 700, 0, 0)
       ORDER BY l_returnflag, l_orderkey, l_partkey, l_suppkey, l_extendedprice LIMIT 200""",
)
def page_after(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]
    return browse_after(load(spark, sf, "lineitem").select(*keys), keys, ["N", 700, 0, 0, 0.0])


@query(
    "browse_after_ties",
    """SELECT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem
       ORDER BY l_returnflag NULLS FIRST, l_linestatus, l_quantity, l_discount LIMIT 900""",
)
def pages_of_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Three pages after one another, by a key that a third of the rows share; nothing is lost or shown twice."""
    lines = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    pages, found = browse(lines, ["l_returnflag"], 0, 300), []
    page = pages
    for _ in range(2):
        found += page.collect()
        last = found[-1]
        page = browse_after(lines, ["l_returnflag"], last.asDict(), 300, sum(r == last for r in found))
        pages = pages.unionByName(page)
    return pages
