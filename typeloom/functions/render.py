"""Text of typed columns: for display, as SQL literals, and as JSON-ready columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions import types as N
from typeloom.functions.floats import display_double
from typeloom.functions.lexical import named, quote_text

# A blob above the limit shows its first bytes only.
BLOB_LIMIT, BLOB_SHOWN = 32, 16
ELLIPSIS = "…"


def _hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def blob_text(data: Column, full: bool = False) -> Column:
    """``0x`` and hex digits; long blobs are cut unless ``full``."""
    whole = F.concat(F.lit("0x"), _hex(data))
    if full:
        return whole
    size = F.octet_length(data)
    cut = F.concat(
        F.lit("0x"), _hex(F.substring(data, 1, BLOB_SHOWN)), F.lit(ELLIPSIS), F.lit(" ("), size, F.lit(" bytes)")
    )
    return F.when(size <= BLOB_LIMIT, whole).otherwise(cut)


def uuid_text(data: Column) -> Column:
    """Canonical form of 16 bytes."""
    groups = [(1, 4), (5, 2), (7, 2), (9, 2), (11, 6)]
    return F.concat_ws("-", *[_hex(F.substring(data, start, size)) for start, size in groups])


def _plain_year(moment: Column) -> Column:
    """Whether Spark's own text has a bare four-digit year (it signs years outside 0-9999)."""
    return F.year(moment).between(0, 9999)


def _year(moment: Column) -> Column:
    return F.format_string("%04d", F.year(moment))


def timestamp_text(moment: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, with six fraction digits unless they are all zero."""
    bare = moment.cast("string")
    padded = F.when(F.length(bare) == 19, bare).otherwise(F.rpad(bare, 26, "0"))
    rest = F.date_format(moment, "-MM-dd HH:mm:ss")
    fraction = F.date_format(moment, ".SSSSSS")
    far = F.concat(_year(moment), rest, F.when(fraction == ".000000", "").otherwise(fraction))
    return F.when(_plain_year(moment), padded).otherwise(far)


def utc_timestamp_text(moment: Column) -> Column:
    """As :func:`timestamp_text` in UTC whatever the session zone, with a ``Z``."""
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(moment), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    return F.concat(timestamp_text(utc), F.lit("Z"))


def date_text(day: Column) -> Column:
    return F.when(_plain_year(day), day.cast("string")).otherwise(
        F.concat(_year(day), F.date_format(day, "-MM-dd"))
    )


def time_text(micros: Column) -> Column:
    """Time of day from microseconds since midnight."""
    seconds = F.floor(micros / 1_000_000)
    fraction = F.pmod(micros, F.lit(1_000_000))
    clock = F.format_string(
        "%02d:%02d:%02d",
        F.floor(seconds / 3600),
        F.pmod(F.floor(seconds / 60), F.lit(60)),
        F.pmod(seconds, F.lit(60)),
    )
    return F.when(fraction == 0, clock).otherwise(F.concat(clock, F.format_string(".%06d", fraction)))


def _time_micros(time: Column) -> Column:
    """Microseconds since midnight of a TIME column."""
    text = time.cast("string")
    seconds = text.substr(1, 2).cast("bigint") * 3600 + text.substr(4, 2).cast("bigint") * 60
    seconds = seconds + text.substr(7, 2).cast("bigint")
    return seconds * 1_000_000 + F.rpad(F.substring(text, 10, 6), 6, "0").cast("bigint")


def _byte(data: Column, position: int) -> Column:
    return F.conv(F.hex(F.substring(data, position, 1)), 16, 10)


def ip_text(family: Column, address: Column) -> Column:
    """Dotted quad, or eight plain groups (zero runs are not shortened)."""
    quad = F.concat_ws(".", *[_byte(address, n) for n in range(1, 5)])
    groups = [F.lower(F.conv(F.hex(F.substring(address, n, 2)), 16, 16)) for n in range(1, 17, 2)]
    return F.when(family == 4, quad).when(family == 6, F.concat_ws(":", *groups)).otherwise("<invalid ip>")


def mac_text(size: Column, data: Column) -> Column:
    shown = F.least(size, F.lit(8))
    pairs = [F.when(shown >= n, _hex(F.substring(data, n, 1))) for n in range(1, 9)]
    return F.concat_ws(":", *pairs)


def _struct_text(column: Column, kind: str) -> Column:
    if kind == "ENUM":
        return F.concat(F.lit("enum#"), column["enum_type_id"], F.lit(":"), column["label_id"])
    if kind == "IPADDR":
        return ip_text(column["family"], column["addr"])
    if kind == "CIDR":
        return F.concat(ip_text(column["family"], column["network"]), F.lit("/"), column["prefix_len"])
    if kind == "MACADDR":
        return mac_text(column["len"], column["bytes"])
    return F.concat(column["months"], F.lit(" mon "), column["days"], F.lit(" d "), column["micros"], F.lit(" us"))


def display_text(column: Column, field: T.StructField, full_blobs: bool = False) -> Column:
    """Display text of a column; NULL stays NULL."""
    kind, dtype = N.column_kind(field), field.dataType
    binary = isinstance(dtype, T.BinaryType)
    if kind == N.FLOAT64:
        text = display_double(column.cast("double"))
    elif kind == N.BLOB:
        text = blob_text(column, full_blobs)
    elif kind in ("GEOMETRY", "GEOGRAPHY"):
        text = F.concat(F.lit(f"{kind}("), F.octet_length(column), F.lit(" bytes)"))
    elif kind == N.UUID and binary:
        text = uuid_text(column)
    elif kind == N.TIMESTAMP:
        text = timestamp_text(column)
    elif kind == N.TIMESTAMPTZ:
        text = utc_timestamp_text(column)
    elif kind == N.DATE:
        text = date_text(column)
    elif kind == N.TIME:
        text = time_text(column if isinstance(dtype, T.LongType) else _time_micros(column))
    elif kind in N.STRUCT_KINDS.values():
        text = _struct_text(column, kind)
    elif kind:
        return column.cast("string")
    else:
        raise TypeError(f"column {field.name!r}: no text form for {dtype.simpleString()}")
    return F.when(column.isNotNull(), text)


def literal_text(column: Column, field: T.StructField) -> Column:
    """SQL literal of a column; blobs whole, NULL as the word NULL."""
    kind = N.column_kind(field)
    if kind == N.BLOB:
        text = F.concat(F.lit("X'"), _hex(column), F.lit("'"))
    elif kind == N.BOOL:
        text = F.upper(column.cast("string"))
    elif kind in (N.INT64, N.FLOAT64, N.DECIMAL):
        text = display_text(column, field)
    else:
        text = quote_text(display_text(column, field))
    return F.coalesce(text, F.lit("NULL"))


def json_column(column: Column, field: T.StructField, full_blobs: bool = False) -> Column:
    """A column whose JSON form is right: integers, doubles and booleans as such, the rest as text."""
    kind = N.column_kind(field)
    if kind == N.FLOAT64:
        finite = ~F.isnan(column) & (F.abs(column) < float("inf"))
        return F.when(finite, column)
    if kind in (N.INT64, N.BOOL):
        return column
    return display_text(column, field, full_blobs)


def _projected(df: DataFrame, make) -> DataFrame:
    return df.select(*[make(named(f.name), f).alias(f.name) for f in df.schema.fields])


def display_columns(df: DataFrame, full_blobs: bool = False) -> DataFrame:
    """Display text of every column, NULL kept."""
    return _projected(df, lambda c, f: display_text(c, f, full_blobs))


def render_display(df: DataFrame, full_blobs: bool = False) -> DataFrame:
    """Display text of every column, NULL shown as the word NULL."""
    return _projected(df, lambda c, f: F.coalesce(display_text(c, f, full_blobs), F.lit("NULL")))


def render_literal(df: DataFrame) -> DataFrame:
    """SQL literal of every column."""
    return _projected(df, literal_text)


def render_json(df: DataFrame, full_blobs: bool = False) -> DataFrame:
    """Every column in the form :func:`json_column` gives."""
    return _projected(df, lambda c, f: json_column(c, f, full_blobs))


def one_line(text: Column, size: int) -> Column:
    """Newlines as blanks, carriage returns removed, at most ``size`` characters and an ellipsis."""
    flat = F.translate(text, "\n\r", " ")
    return F.when(F.length(flat) > size, F.concat(F.left(flat, F.lit(size)), F.lit(ELLIPSIS))).otherwise(flat)


def preview(df: DataFrame, n: int = 200) -> DataFrame:
    """One-line display text of every column, at most ``n`` characters each."""
    shown = render_display(df)
    return shown.select(*[one_line(named(c), n).alias(c) for c in shown.columns])

