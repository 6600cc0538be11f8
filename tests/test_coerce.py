import datetime
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from typeloom.functions.cells import coerce_cell, make_cell, parse_for_type
from typeloom.operators.coerce import assign_types, coerce_cells, parse_columns

NULL, MAX, MIN = "null", 2**63 - 1, -(2**63)


def cells(spark, values, **extra):
    """One cell per Python value, its class by the value's type."""
    schema = "id int, k string, i bigint, r double, t string, b binary"
    table = []
    for n, v in enumerate(values):
        kind = {type(None): "null", int: "integer", float: "real", str: "text", bytes: "blob"}[type(v)]
        table.append((n, kind, *[v if kind == k else None for k in ("integer", "real", "text", "blob")]))
    raw = spark.createDataFrame(table, schema)
    return raw.select("id", make_cell(F.col("k"), F.col("i"), F.col("r"), F.col("t"), F.col("b")).alias("cell"))


def payload(row):
    value = row["cell"]
    return (value["kind"], None if value["kind"] == "NULL" else value[value["kind"].lower()])


COERCED = [
    ("INT64", None, ("NULL", None)), ("INT64", 7, ("INT64", 7)), ("INT64", -2.7, ("INT64", -2)),
    ("INT64", 1e19, ("INT64", MAX)), ("INT64", -1e19, ("INT64", MIN)), ("INT64", float("nan"), ("INT64", 0)),
    ("INT64", 9.223372036854775e18, ("INT64", 9223372036854774784)), ("INT64", float("-inf"), ("INT64", MIN)),
    ("INT64", "+7", ("INT64", 7)), ("INT64", " 7", ("TEXT", " 7")), ("INT64", "7\n", ("TEXT", "7\n")),
    ("INT64", "1.0", ("TEXT", "1.0")), ("INT64", "9223372036854775808", ("TEXT", "9223372036854775808")),
    ("INT64", "٣", ("TEXT", "٣")), ("INT64", b"x", ("BLOB", b"x")),
    ("FLOAT64", 7, ("FLOAT64", 7.0)), ("FLOAT64", 0.5, ("FLOAT64", 0.5)), ("FLOAT64", "1e5", ("FLOAT64", 1e5)),
    ("FLOAT64", "1.", ("FLOAT64", 1.0)), ("FLOAT64", ".5", ("FLOAT64", 0.5)), ("FLOAT64", "-INF", ("FLOAT64", -math.inf)),
    ("FLOAT64", "1.0d", ("TEXT", "1.0d")), ("FLOAT64", ".", ("TEXT", ".")), ("FLOAT64", "0x1p3", ("TEXT", "0x1p3")),
    ("BOOL", 0, ("BOOL", False)), ("BOOL", 5, ("BOOL", True)), ("BOOL", 1.0, ("FLOAT64", 1.0)),
    ("BOOL", "YES", ("BOOL", True)), ("BOOL", "f", ("BOOL", False)), ("BOOL", "y", ("TEXT", "y")),
    ("BOOL", " t", ("TEXT", " t")), ("TEXT", 5, ("TEXT", "5")), ("TEXT", 1.0, ("TEXT", "1")),
    ("TEXT", 1e-7, ("TEXT", "0.0000001")), ("TEXT", 1e21, ("TEXT", "1000000000000000000000")),
    ("TEXT", "x", ("TEXT", "x")), ("TEXT", b"x", ("BLOB", b"x")), ("DATE", 5, ("INT64", 5)),
    ("DATE", 1.5, ("FLOAT64", 1.5)), ("UUID", "u", ("TEXT", "u")), ("BLOB", "t", ("TEXT", "t")),
]


@pytest.mark.parametrize("target", sorted({t for t, _, _ in COERCED}))
def test_coerce_known_target(spark, target):
    cases = [(v, want) for t, v, want in COERCED if t == target]
    df = coerce_cells(cells(spark, [v for v, _ in cases]), {"cell": target})
    assert [payload(r) for r in df.orderBy("id").collect()] == [want for _, want in cases]


def test_coerce_target_column(spark):
    df = cells(spark, [v for _, v, _ in COERCED])
    targets = spark.createDataFrame([(n, t) for n, (t, _, _) in enumerate(COERCED)], "id int, target string")
    found = df.join(targets, "id").select("id", coerce_cell(F.col("cell"), F.col("target")).alias("cell"))
    assert [payload(r) for r in found.orderBy("id").collect()] == [want for _, _, want in COERCED]


def test_nan_texts(spark):
    df = coerce_cells(cells(spark, ["NaN", "+nan", "-NAN"]), {"cell": "FLOAT64"})
    assert all(math.isnan(r["cell"]["float64"]) for r in df.collect())


PARSED = [
    ("42", "INTEGER", ("INT64", 42)), ("", "TEXT", ("NULL", None)), ("   ", "INT", ("NULL", None)),
    (" NuLl ", "TEXT", ("NULL", None)), ("true", "BOOL", ("BOOL", True)), ("no", "Boolean", ("BOOL", False)),
    (" 12\t", "BIGINT", ("INT64", 12)), ("1.5", "INT", ("TEXT", "1.5")), ("1.5", "double", ("FLOAT64", 1.5)),
    (" a b ", "TEXT", ("TEXT", "a b")), ("2020-01-01", "DATE", ("TEXT", "2020-01-01")), (None, "INT", ("NULL", None)),
]


def test_parse_for_type(spark):
    df = spark.createDataFrame([(n, t, d) for n, (t, d, _) in enumerate(PARSED)], "id int, t string, d string")
    dynamic = df.select("id", parse_for_type(F.col("t"), F.col("d")).alias("cell"))
    assert [payload(r) for r in dynamic.orderBy("id").collect()] == [want for _, _, want in PARSED]
    for text, declared, want in PARSED:
        one = spark.createDataFrame([(text,)], "cell string")
        assert payload(parse_columns(one, {"cell": declared}).first()) == want


ASSIGNED = [
    ("DECIMAL(10,2)", ["19.995", 5, 0.125, "1e3", "x", 10**9, None, b"x", "99999999.99"],
     [Decimal("20.00"), Decimal(5), Decimal("0.13"), Decimal(1000), "x", 10**9, None, "0x78", Decimal("99999999.99")]),
    ("DATE", ["1815-12-10", "1936", "2001-02-29", 5], [datetime.date(1815, 12, 10), "1936", "2001-02-29", 5]),
    ("TIMESTAMP", ["1843-10-01 09:00:00", "1843-10-01T09:00", "1843-10-01", "1843-10-01 09:00:00Z", "noon"],
     [datetime.datetime(1843, 10, 1, 9), datetime.datetime(1843, 10, 1, 9), datetime.datetime(1843, 10, 1),
      "1843-10-01 09:00:00Z", "noon"]),
    ("TIME", ["09:30", "23:59:59.5", "25:00", "9:30"], [34_200_000_000, 86_399_500_000, "25:00", "9:30"]),
    ("UUID", ["12345678-9ABC-def0-1122-334455667788", "12345678"], ["12345678-9abc-def0-1122-334455667788", "12345678"]),
    ("BLOB", [b"\x00\xff", "text"], [bytearray(b"\x00\xff"), "text"]),
    ("BOOL", ["yes", 0, 1.0], [True, False, "1.0"]),
    ("TEXT", ["a", 5, 0.5, b"\x01"], ["a", "5", "0.5", "0x01"]),
    ("INT64", ["5", 2.9, "x"], [5, 2, "x"]),
]


@pytest.mark.parametrize("target,values,want", ASSIGNED, ids=[t for t, _, _ in ASSIGNED])
def test_assign(spark, target, values, want):
    good, rejects = assign_types(cells(spark, values), {"cell": target})
    found = dict(rows(good))
    texts = {r["id"]: r["errors"][0]["text"] for r in rejects.collect()}
    assert not set(found) & set(texts) and len(found) + len(texts) == len(values)
    for n, expected in enumerate(want):
        if n in texts:
            assert texts[n] == str(expected)
        else:
            assert found[n] == expected


def test_assign_timestamptz_is_utc(spark):
    texts = ["2020-01-01 00:00:00", "2020-01-01 02:00:00+02:00", "2020-01-01T00:00:00Z", "2020-01-01"]
    good, _ = assign_types(cells(spark, texts), {"cell": "TIMESTAMPTZ"})
    assert {r[0] for r in good.select(F.unix_micros("cell")).collect()} == {1_577_836_800_000_000}


def test_epoch_numbers(spark):
    df = cells(spark, [0, 86_400, 1.5, 10**17])
    good, rejects = assign_types(df, {"cell": "TIMESTAMP"}, epoch_unit="s")
    assert rows(good, "id") == [
        (0, datetime.datetime(1970, 1, 1)), (1, datetime.datetime(1970, 1, 2)),
        (2, datetime.datetime(1970, 1, 1, 0, 0, 1, 500000)),
    ]
    assert rejects.count() == 1
    assert rows(assign_types(df, {"cell": "DATE"}, epoch_unit="s")[0].filter("id = 1")) == [(1, datetime.date(1970, 1, 2))]


def test_on_error(spark):
    df = cells(spark, ["1", "x"])
    good, _ = assign_types(df, {"cell": "INT64"}, on_error="null")
    assert rows(good, "id") == [(0, 1), (1, None)]
    good, _ = assign_types(df, {"cell": "INT64"}, on_error="fail")
    with pytest.raises(Exception, match="column cell: not a INT64: x"):
        good.collect()
    with pytest.raises(ValueError):
        assign_types(df, {"cell": "INT64"}, on_error="ignore")


def test_text_columns(spark):
    df = spark.createDataFrame([(1, " 5 ", "null"), (2, "x", "no")], "id int, a string, b string")
    good, rejects = assign_types(df, {"a": "INT64", "b": "BOOL"})
    assert rows(good) == [(1, 5, None)]
    assert [(r["id"], r["b"], r["errors"][0]["column"]) for r in rejects.collect()] == [(2, False, "a")]


def test_filter_on_rejects_parses_once(spark):
    df = spark.createDataFrame([("1",)], "a string")
    good, _ = assign_types(df, {"a": "INT64"})
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert "try_cast" not in plan.split("Filter NOT rejected")[0]
    assert plan.count("try_cast(") == 1
