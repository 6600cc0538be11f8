"""All rules of a catalog at once: the same counts as rule by rule, from one pass over each table."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from typeloom.operators.audit import (
    FOREIGN_KEY, NOT_NULL, PRIMARY_KEY, UNIQUE, Constraint, audit_foreign_key, audit_not_null, audit_primary_key,
    audit_unique,
)
from typeloom.operators.audit_all import audit_catalog


@pytest.fixture(scope="module")
def tables(spark):
    # A third of the rows share one key, and every column has NULLs.
    child = spark.range(0, 3000, 1, 6).selectExpr(
        "IF(id % 3 = 0, 7, id) AS `a b`", "NULLIF(id % 11, 10) AS b", "CAST(NULLIF(id % 5, 4) AS string) AS c", "id % 2 = 0 AS d"
    )
    return {"child": child, "parent": spark.range(0, 2000, 2).selectExpr("id AS x", "CAST(id % 3 AS string) AS y")}


def test_as_rule_by_rule(tables):
    child, parent = tables["child"], tables["parent"]
    found = {r[:3]: r[3] for r in rows(audit_catalog(tables, [
        Constraint("child", PRIMARY_KEY, ("a b", "b")), Constraint("child", UNIQUE, ("b", "c")), Constraint("child", UNIQUE, ("d",)),
        Constraint("child", NOT_NULL, ("a b", "c")), Constraint("child", FOREIGN_KEY, ("a b",), "parent", ("x",)),
        Constraint("child", FOREIGN_KEY, ("b", "c"), "parent", ("x", "y")), Constraint("parent", PRIMARY_KEY, ("x",)),
    ]))}
    lost = lambda keys, refs: audit_foreign_key(child, keys, parent, refs).agg(F.sum("n")).first()[0]
    nulls = dict(rows(audit_not_null(child, ["a b", "c"])))
    assert found == {
        ("child", PRIMARY_KEY, "a b,b"): audit_primary_key(child, ["a b", "b"]).count(),
        ("child", UNIQUE, "b,c"): audit_unique(child, ["b", "c"]).count(),
        ("child", UNIQUE, "d"): 2,
        ("child", NOT_NULL, "a b"): nulls.get("a b", 0),
        ("child", NOT_NULL, "c"): nulls["c"],
        ("child", FOREIGN_KEY, "a b"): lost(["a b"], ["x"]),
        ("child", FOREIGN_KEY, "b,c"): lost(["b", "c"], ["x", "y"]),
        ("parent", PRIMARY_KEY, "x"): 0,
    }
    assert found["child", PRIMARY_KEY, "a b,b"] > 0 and found["child", FOREIGN_KEY, "b,c"] > 0


def test_one_scan_a_table(spark, tables, tmp_path):
    path = str(tmp_path / "child")
    tables["child"].write.parquet(path)
    rules = [Constraint("t", PRIMARY_KEY, ("a b", "b")), Constraint("t", UNIQUE, ("c",)), Constraint("t", UNIQUE, ("d",)),
             Constraint("t", NOT_NULL, ("b",))]
    plan = audit_catalog({"t": spark.read.parquet(path)}, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Expand") == 1


def test_empty_tables_and_wrong_rules(tables):
    none = {t: df.limit(0) for t, df in tables.items()}
    rules = [Constraint("child", PRIMARY_KEY, ("b",)), Constraint("child", NOT_NULL, ("c",)),
             Constraint("child", FOREIGN_KEY, ("b",), "parent", ("x",))]
    assert sorted(r[3] for r in rows(audit_catalog(none, rules))) == [0, 0, 0]
    assert rows(audit_catalog(none, [Constraint("child", NOT_NULL, ("c",))])) == [("child", NOT_NULL, "c", 0)]
    for wrong in ([], [Constraint("child", "CHECK", ("b",))], [Constraint("child", UNIQUE, ())]):
        with pytest.raises(ValueError):
            audit_catalog(tables, wrong)
