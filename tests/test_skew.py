"""Plans under skew: one key holds a third of the rows and tables are too large to broadcast."""

import pytest
from pyspark.sql import functions as F

from typeloom.operators.audit import FOREIGN_KEY, Constraint, audit_foreign_key
from typeloom.operators.changes import apply_changes, apply_deletes, apply_updates, delete_cascade

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture(autouse=True)
def small_limits(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture()
def base(spark):
    hot = spark.range(0, 60_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.sha1(F.col("id").cast("string")).alias("note")
    )
    return hot


def final_plan(df):
    """The plan as it ran, with the number of rows."""
    n = len(df.collect())
    return n, df._jdf.queryExecution().executedPlan().toString()


def test_updates_split_the_hot_key(spark, base):
    edits = spark.range(0, 60_000, 4, 4).selectExpr("id AS k", "id AS seq", "'note' AS column", "'x' AS value")
    found = apply_updates(base, edits, ["k"])
    n, plan = final_plan(found)
    assert n == 60_000 and "skew=true" in plan


def test_deletes_split_the_hot_key(spark, base):
    n, plan = final_plan(apply_deletes(base, spark.range(0, 60_000, 4, 4).selectExpr("id AS k"), ["k"]))
    expected = base.filter("k % 4 <> 0").count()
    assert n == expected and "skew=true" in plan


def test_change_log_splits_the_hot_key(spark, base):
    log = spark.range(0, 60_000, 1, 12).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 5 ELSE id + 100000 END AS k", "id AS seq", "'insert' AS op", "map('note', 'x') AS set"
    )
    # With inserts alone there is no state to join.  A third of the deletes void the inserts of single keys.
    gone = spark.range(0, 60_000, 10, 12).selectExpr(
        "CASE WHEN id % 30 = 0 THEN 6 ELSE id + 100000 END AS k", "id + 1 AS seq", "'delete' AS op", "CAST(NULL AS map<string,string>) AS set"
    )
    n, plan = final_plan(apply_changes(base, log.unionByName(gone), ["k"]))
    # Of the table 6 goes, if it is there; of the inserts those of 4,000 keys go.
    held = base.filter("k <> 6").count()
    assert n == held + 60_000 - 4_000 and "skew=true" in plan


def test_cascade_splits_the_hot_parent(spark, base):
    parent = spark.range(0, 60_000, 1, 4).selectExpr("id AS p")
    child = base.withColumnRenamed("k", "p_ref")
    edges = [Constraint("child", FOREIGN_KEY, ("p_ref",), "parent", ("p",))]
    kept = delete_cascade({"parent": parent, "child": child}, edges, "parent", parent.filter("p % 2 = 0"), ["p"])
    n, plan = final_plan(kept["child"])
    assert n == base.filter("k % 2 <> 0").count() and "skew=true" in plan


def test_foreign_key_audit_counts_before_the_join(spark, base):
    orphans = audit_foreign_key(base, ["k"], spark.range(100, 60_000).selectExpr("id AS p"), ["p"])
    found = {r["k"]: r["n"] for r in orphans.collect()}
    assert found[7] == 20_001
    plan = orphans._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("HashAggregate")
