import datetime
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import rows
from typeloom.functions.floats import display_double, plain_double
from typeloom.functions.render import preview, render_display, render_json, render_literal
from typeloom.functions.types import KIND_KEY


def plain(v):
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "inf" if v > 0 else "-inf"
    return format(Decimal(repr(v)), "f").removesuffix(".0")


def shown(v):
    return f"{v:.1f}" if math.isfinite(v) and abs(v) < 1e15 and v == int(v) else plain(v)


def doubles():
    rng = random.Random(5)
    fixed = [
        0.0, -0.0, 1.0, -1.5, 0.1, 1e-3, 9.99e-4, 1e7, 12345678.0, 123456789.5, 1e15, 999999999999999.0, 1e16, 1e21,
        1e22, 5e-324, 1.7976931348623157e308, 5.684341886080802e-14, 2e-20, math.inf, -math.inf, math.nan,
    ]
    spread = [rng.choice([-1, 1]) * 10 ** rng.uniform(-320, 308) for _ in range(2000)]
    near = [rng.choice([-1, 1]) * 10 ** rng.uniform(-8, 18) for _ in range(4000)]
    money = [round(rng.uniform(-1e6, 1e6), 2) for _ in range(2000)]
    powers = [2.0 ** n for n in range(-200, 200)]
    return fixed + spread + near + money + powers


def test_double_text(spark):
    values = doubles()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", plain_double(F.col("v")).alias("p"), display_double(F.col("v")).alias("d")).collect():
        assert (row["p"], row["d"]) == (plain(row["v"]), shown(row["v"]))


@pytest.fixture(scope="module")
def kinds(spark):
    def field(name, dtype, kind=None):
        return T.StructField(name, dtype, True, {KIND_KEY: kind} if kind else {})

    def struct(ddl):
        return T._parse_datatype_string(f"struct<{ddl}>")

    schema = T.StructType(
        [
            field("n", T.IntegerType()), field("flag", T.BooleanType()), field("text", T.StringType()),
            field("small", T.BinaryType()), field("large", T.BinaryType()), field("amount", T.DecimalType(18, 1)),
            field("uuid", T.BinaryType(), "UUID"), field("at", T.TimestampNTZType()), field("tz", T.TimestampType()),
            field("day", T.DateType()), field("clock", T.LongType(), "TIME"), field("shape", T.BinaryType(), "GEOMETRY"),
            field("label", struct("enum_type_id:int,label_id:int")), field("ip4", struct("family:int,addr:binary")),
            field("ip6", struct("family:int,addr:binary")), field("ipx", struct("family:int,addr:binary")),
            field("net", struct("family:int,prefix_len:int,network:binary")), field("mac", struct("len:int,bytes:binary")),
            field("span", struct("months:int,days:int,micros:bigint")),
        ]
    )
    address = bytes([32, 1, 13, 184, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1])
    full = (
        -5, True, "it's", bytes(32), bytes(33), Decimal("-0.5"),
        bytes.fromhex("123456789abcdef01122334455667788"), datetime.datetime(1969, 12, 31, 23, 59, 59, 500000),
        datetime.datetime(2020, 1, 2, 3, 4, 5, tzinfo=datetime.timezone.utc), datetime.date(987, 6, 5), 34_200_000_001,
        b"abc", (3, 4), (4, bytes([192, 168, 0, 7]) + bytes(12)), (6, address), (5, address),
        (4, 24, bytes([10, 0, 0, 0]) + bytes(12)), (6, bytes([0, 27, 68, 17, 58, 183, 1, 2])), (1, -2, 3),
    )
    return spark.createDataFrame([full, (None,) * len(schema)], schema)


DISPLAYED = {
    "n": "-5", "flag": "true", "text": "it's", "small": "0x" + "00" * 32, "large": "0x" + "00" * 16 + "… (33 bytes)",
    "amount": "-0.5", "uuid": "12345678-9abc-def0-1122-334455667788", "at": "1969-12-31 23:59:59.500000",
    "tz": "2020-01-02 03:04:05Z", "day": "0987-06-05", "clock": "09:30:00.000001", "shape": "GEOMETRY(3 bytes)",
    "label": "enum#3:4", "ip4": "192.168.0.7", "ip6": "2001:db8:0:0:0:0:0:1", "ipx": "<invalid ip>",
    "net": "10.0.0.0/24", "mac": "00:1b:44:11:3a:b7", "span": "1 mon -2 d 3 us",
}


def test_display(kinds):
    full, empty = [r.asDict() for r in render_display(kinds).collect()]
    assert full == DISPLAYED
    assert set(empty.values()) == {"NULL"}


def test_literal(kinds):
    full, empty = [r.asDict() for r in render_literal(kinds).collect()]
    bare = {"n": "-5", "flag": "TRUE", "amount": "-0.5", "text": "'it''s'"}
    blobs = {"small": f"X'{'00' * 32}'", "large": f"X'{'00' * 33}'"}
    quoted = {k: f"'{v}'" for k, v in DISPLAYED.items()}
    assert full == {**quoted, **bare, **blobs}
    assert set(empty.values()) == {"NULL"}


def test_json_columns(spark):
    df = spark.createDataFrame([(1, math.nan, True, Decimal("1.50")), (2, 2.0, None, None)],
                               "a bigint, b double, c boolean, d decimal(5,2)")
    assert rows(render_json(df), "a") == [(1, None, True, "1.50"), (2, 2.0, None, None)]


def test_utc_text_ignores_session_zone(spark, kinds):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert render_display(kinds.select("tz")).first()["tz"] == "2020-01-02 03:04:05Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_far_years(spark):
    df = spark.sql("SELECT timestamp_ntz'+12345-01-02 03:04:05' AS t, date'-0044-03-15' AS d, timestamp_ntz'0001-01-01' AS o")
    assert tuple(render_display(df).first()) == ("12345-01-02 03:04:05", "-044-03-15", "0001-01-01 00:00:00")


def test_time_type(spark):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        df = spark.sql("SELECT TIME '09:30:00' AS a, TIME '23:59:59.000001' AS b")
        assert tuple(render_display(df).first()) == ("09:30:00", "23:59:59.000001")
    finally:
        spark.conf.unset("spark.sql.timeType.enabled")


def test_unsupported_type_is_named(spark):
    with pytest.raises(TypeError, match="'a'"):
        render_display(spark.sql("SELECT array(1) AS a"))


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "x")], ["a.b", "c`d"])
    assert tuple(render_display(df).first()) == ("1.0", "x")


def test_preview(spark):
    df = spark.createDataFrame([("a\r\nb",), ("é" * 6,), (None,)], "s string")
    assert [r[0] for r in preview(df, 5).collect()] == ["a b", "é" * 5 + "…", "NULL"]
