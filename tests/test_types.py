import pytest

from tests.conftest import rows
from typeloom.functions.types import NativeType, map_declared_types, screen_defaults, sqlite_affinity

DECLARED = [
    ("INTEGER", "INT64"), ("int", "INT64"), ("VARCHAR(255)", "TEXT"), ("TEXT", "TEXT"), ("", "TEXT"), (None, "TEXT"),
    ("BOOLEAN", "BOOL"), ("UUID", "UUID"), ("guid", "UUID"), ("REAL", "FLOAT64"), ("DOUBLE", "FLOAT64"),
    ("DATETIME", "TIMESTAMP"), ("DATE", "DATE"), ("TIME", "TIME"), ("BLOB", "BLOB"), ("bytea", "BLOB"),
    ("DECIMAL(10,2)", "DECIMAL(10,2)"), (" numeric( 5 ) ", "DECIMAL(5,0)"), ("DECIMAL", "DECIMAL(18,6)"),
    ("DECIMAL(30,40)", "DECIMAL(18,18)"), ("DECIMAL(0)", "DECIMAL(1,0)"), ("DECIMAL(300)", "DECIMAL(18,6)"),
    ("DECIMAL(5,x)", "DECIMAL(5,0)"), ("DECIMAL(5,300)", "DECIMAL(5,0)"), ("DECIMAL(-5)", "DECIMAL(18,6)"),
    ("DECIMAL()", "DECIMAL(18,6)"), ("DECIMAL)(", "DECIMAL(18,6)"), ("DECIMAL(+7,+3)", "DECIMAL(7,3)"),
    ("FLOATING POINT", "INT64"), ("INTERVAL", "INT64"), ("TIMESTAMPTZ", "TIMESTAMPTZ"),
    ("timestamp with time zone", "TIMESTAMPTZ"), ("TIMESTAMP(6) WITH TIME ZONE", "TIMESTAMP"),
    ("UNSIGNED DECIMAL", "TEXT"), ("　int ", "INT64"), ("geometry", "TEXT"),
]


def test_declared_types(spark):
    df = spark.createDataFrame([(n, d) for n, (d, _) in enumerate(DECLARED)], "id int, decl string")
    found = [r["native_type"] for r in map_declared_types(df, "decl").orderBy("id").collect()]
    assert found == [native for _, native in DECLARED]


def test_native_types_map_to_themselves(spark):
    names = ["INT64", "FLOAT64", "BOOL", "TEXT", "BLOB", "DECIMAL(10,2)", "UUID", "TIMESTAMP", "TIMESTAMPTZ", "DATE", "TIME"]
    df = spark.createDataFrame([(n,) for n in names], "decl string")
    assert {r["decl"]: r["native_type"] for r in map_declared_types(df, "decl").collect()} == {n: n for n in names}


def test_precision_only_for_decimals(spark):
    df = spark.createDataFrame([("VARCHAR(10)",), ("DECIMAL(9,3)",)], "decl string")
    assert rows(map_declared_types(df, "decl").select("precision", "scale"), "precision") == [(None, None), (9, 3)]


def test_affinity(spark):
    expected = {
        "INT64": "INTEGER", "BOOL": "INTEGER", "INTERVAL": "INTEGER", "FLOAT64": "REAL", "BLOB": "BLOB",
        "GEOMETRY": "BLOB", "GEOGRAPHY": "BLOB", "DECIMAL(10,2)": "NUMERIC", "UUID": "TEXT", "TIMESTAMP": "TEXT",
    }
    df = spark.createDataFrame([(k,) for k in expected], "type string")
    assert {r["type"]: r["affinity"] for r in sqlite_affinity(df, "type").collect()} == expected


def test_safe_defaults(spark):
    expected = {
        "NULL": True, "current_timestamp": True, "True": True, " 1e5 ": True, "inf": True, "-NaN": True, ".5": True,
        "5.": True, "'x'": True, "'": True, "'a' || 'b'": True, "random()": False, "": False, "  ": False, ".": False,
        "1.0d": False, "0x1f": False, '"x"': False, None: False, "1\n2": False,
    }
    df = spark.createDataFrame([(k,) for k in expected], "default string")
    assert {r["default"]: r["safe"] for r in screen_defaults(df, "default").collect()} == expected


def test_native_type_text():
    assert NativeType.parse("DECIMAL(10,2)").spark_type().simpleString() == "decimal(10,2)"
    with pytest.raises(ValueError):
        NativeType.parse("DECIMAL")
    with pytest.raises(ValueError):
        NativeType.parse("INTEGER")
