import pytest

from tests.conftest import rows
from typeloom.operators.audit import (
    FOREIGN_KEY, NOT_NULL, PRIMARY_KEY, UNIQUE, Constraint, audit_foreign_key, audit_not_null,
    audit_primary_key, audit_unique, kind_profile, null_profile, reconcile,
)
from typeloom.operators.audit_all import audit_catalog
from typeloom.operators.catalog import (
    catalog_columns, catalog_summary, catalog_tables, columns_of, constraints_of, create_index_ddl, create_table_ddl,
    declared_of, dropped_defaults, fk_edges, register_view, schema_fingerprint,
)

DECLARED = "database string, table string, cid int, name string, decl string, not_null boolean, pk boolean, default string"


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "stations": spark.createDataFrame([(7, "quay", True, 1.25), (9, "ridge", False, 812.0)],
                                          "id bigint, label string, indoor boolean, metres double"),
        "probes": spark.createDataFrame([(1, 9, "hPa"), (4, 7, "mm")], "id bigint, station bigint, unit string"),
        "alarms": spark.createDataFrame([(1, 4, 5)], "id bigint, probe bigint, level bigint"),
    }


CONSTRAINTS = [
    Constraint("stations", PRIMARY_KEY, ("id",)),
    Constraint("stations", UNIQUE, ("label",)),
    Constraint("stations", UNIQUE, ("indoor", "metres")),
    Constraint("probes", PRIMARY_KEY, ("id",)),
    Constraint("probes", FOREIGN_KEY, ("station",), "stations", ("id",)),
    Constraint("probes", UNIQUE, ("station",)),
    Constraint("alarms", FOREIGN_KEY, ("probe",), "probes", ("id",)),
    Constraint("alarms", FOREIGN_KEY, ("level",), "missing", ("id",)),
]


def test_column_catalog(spark, tables):
    columns, constraints = columns_of(spark, tables), constraints_of(spark, CONSTRAINTS)
    found = catalog_columns(columns, constraints).select("table", "column", "type", "nullable", "key", "default")
    assert rows(found.filter("table <> 'alarms'"), "table", "column") == [
        ("probes", "id", "INT64", "YES", "PK", ""), ("probes", "station", "INT64", "YES", "FK", ""),
        ("probes", "unit", "TEXT", "YES", "", ""),
        ("stations", "id", "INT64", "YES", "PK", ""), ("stations", "indoor", "BOOL", "YES", "", ""),
        ("stations", "label", "TEXT", "YES", "UQ", ""), ("stations", "metres", "FLOAT64", "YES", "", ""),
    ]
    edges = fk_edges(constraints, columns).select("from_table", "from_columns", "to_table", "to_columns")
    assert rows(edges, "from_table") == [("alarms", ["probe"], "probes", ["id"]), ("probes", ["station"], "stations", ["id"])]


def test_sizes_and_counts(spark, tables):
    assert rows(catalog_tables(tables), "table") == [("alarms", 3, 1), ("probes", 3, 2), ("stations", 4, 2)]
    indexes = spark.createDataFrame([("main", "ix")], "database string, index string")
    views = spark.createDataFrame([], "database string, view string")
    found = catalog_summary(columns_of(spark, tables), indexes, views)
    assert rows(found, "kind") == [("main", "index", 1), ("main", "table", 3)]


def test_fingerprint_follows_the_schema(spark, tables):
    def prints(given):
        return {r["table"]: r["fingerprint"] for r in schema_fingerprint(columns_of(spark, given)).collect()}

    first = prints(tables)
    assert first == prints({k: v.limit(0) for k, v in tables.items()})
    changed = prints({**tables, "probes": tables["probes"].withColumnRenamed("unit", "name")})
    assert {t for t in first if first[t] != changed[t]} == {"probes"}


def test_table_ddl(spark, tables):
    declared = spark.createDataFrame(
        [
            ("d", "one", 0, "id", "INTEGER", True, True, None), ("d", "one", 1, "na\"me", "TEXT", True, False, "'x'"),
            ("d", "one", 2, "at", "DATETIME", False, False, "datetime('now')"),
            ("d", "two", 1, "a", "INT", True, True, None), ("d", "two", 0, "b", "", False, True, "5"),
            ("e", "one", 0, "v", "DECIMAL(9,2)", False, False, None),
        ],
        DECLARED,
    )
    assert rows(create_table_ddl(declared), "database", "table") == [
        ("d", "one", 'CREATE TABLE "one" (\n  "id" INT64 PRIMARY KEY,\n  "na""me" TEXT NOT NULL DEFAULT \'x\',\n  "at" TIMESTAMP\n)'),
        ("d", "two", 'CREATE TABLE "two" (\n  "b" TEXT DEFAULT 5,\n  "a" INT64 NOT NULL,\n  PRIMARY KEY ("b", "a")\n)'),
        ("e", "one", 'CREATE TABLE "one" (\n  "v" DECIMAL(9,2)\n)'),
    ]
    assert rows(dropped_defaults(declared)) == [("d", "one", "Dropped default for one.at")]
    native = create_table_ddl(declared_of(columns_of(spark, tables), constraints_of(spark, CONSTRAINTS)))
    assert rows(native.filter("table = 'probes'").select("ddl")) == [
        ('CREATE TABLE "probes" (\n  "id" INT64 PRIMARY KEY,\n  "station" INT64,\n  "unit" TEXT\n)',)
    ]


def test_index_ddl(spark):
    indexes = spark.createDataFrame(
        [("d", "ix", "t", True, ["a", 'b"c']), ("d", "iy", "t", False, ["a"])],
        "database string, index string, table string, unique boolean, columns array<string>",
    )
    assert [r["ddl"] for r in create_index_ddl(indexes).orderBy("index").collect()] == [
        'CREATE UNIQUE INDEX "ix" ON "t" ("a", "b""c")', 'CREATE INDEX "iy" ON "t" ("a")',
    ]


def test_view(spark, tables):
    register_view(spark, "named", tables["stations"].select("label"))
    assert spark.sql("SELECT count(*) FROM named").first()[0] == 2


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (None, "y"), (2, "z")], "a int, b string")


def test_key_audits(spark, keyed):
    assert sorted(rows(audit_primary_key(keyed, ["a", "b"])), key=repr) == sorted(
        [(1, "x", 2), (1, None, 1), (None, "y", 1)], key=repr
    )
    assert rows(audit_unique(keyed, ["a", "b"])) == [(1, "x", 2)]
    assert rows(audit_not_null(keyed, ["a", "b"]), "column") == [("a", 1), ("b", 1)]
    assert rows(null_profile(keyed.withColumn("c", keyed.a * 0 + 1).fillna(1, ["c"]))) == [("a", 1), ("b", 1), ("c", 0)]
    parent = spark.createDataFrame([(2, "z"), (2, "z")], "x int, y string")
    assert rows(audit_foreign_key(keyed, ["a", "b"], parent, ["x", "y"])) == [(1, "x", 2)]
    for audit in (audit_primary_key, audit_unique, audit_not_null):
        with pytest.raises(ValueError):
            audit(keyed, [])


def test_catalog_audit(spark, keyed):
    parent = spark.createDataFrame([(2,)], "id int")
    found = audit_catalog(
        {"t": keyed, "p": parent},
        [
            Constraint("t", PRIMARY_KEY, ("a", "b")), Constraint("t", UNIQUE, ("a",)), Constraint("t", NOT_NULL, ("a", "b")),
            Constraint("t", FOREIGN_KEY, ("a",), "p", ("id",)), Constraint("p", PRIMARY_KEY, ("id",)),
        ],
    )
    assert rows(found, "table", "rule", "columns") == [
        ("p", "PRIMARY KEY", "id", 0), ("t", "FOREIGN KEY", "a", 3), ("t", "NOT NULL", "a", 1), ("t", "NOT NULL", "b", 1),
        ("t", "PRIMARY KEY", "a,b", 3), ("t", "UNIQUE", "a", 1),
    ]


def test_kind_profile(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0.5D, 'x'), (2, NULL, 'y'), (3, 1.5D, NULL) AS t(n, v, s)")
    assert rows(kind_profile(df), "column", "kind") == [
        ("n", "INT64", 3), ("s", "NULL", 1), ("s", "TEXT", 2), ("v", "FLOAT64", 2), ("v", "NULL", 1),
    ]


def test_reconcile(spark, keyed):
    found = reconcile({"t": keyed, "u": keyed}, {"t": keyed.limit(3)}, {"t": keyed.limit(2), "u": keyed.limit(1)})
    assert rows(found, "table") == [("t", 5, 3, 2, True), ("u", 5, 0, 1, False)]
