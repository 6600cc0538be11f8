"""Cells of loosely typed sources, and the tagged values they are coerced to.

A source column holds one *cell* per row: its storage class ``k`` and the payload in the field of that
class.  Coercion turns a cell into a *value*: its kind and the payload in the field of that kind.  All of it
is column expressions, so a literal target type lets the optimizer drop every branch that cannot happen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions import types as N
from typeloom.functions.floats import plain_double
from typeloom.functions.lexical import (
    DECIMAL_PATTERN, folded, parse_boolean, parse_double, parse_integer, trim_blanks,
)
from typeloom.functions.render import uuid_text

CELL = (
    T.StructType()
    .add("k", T.StringType())
    .add("i", T.LongType())
    .add("r", T.DoubleType())
    .add("t", T.StringType())
    .add("b", T.BinaryType())
)
# The storage classes of a cell.
STORAGE_CLASSES = ("null", "integer", "real", "text", "blob")

VALUE = (
    T.StructType()
    .add("kind", T.StringType())
    .add("int64", T.LongType())
    .add("float64", T.DoubleType())
    .add("bool", T.BooleanType())
    .add("text", T.StringType())
    .add("blob", T.BinaryType())
)
VALUE_KINDS = ("NULL", N.INT64, N.FLOAT64, N.BOOL, N.TEXT, N.BLOB)

_MAX_LONG, _MIN_LONG = 2**63 - 1, -(2**63)


def _struct(schema: T.StructType, given: dict[str, Column]) -> Column:
    return F.struct(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def make_cell(
    k: Column,
    i: Column | None = None,
    r: Column | None = None,
    t: Column | None = None,
    b: Column | None = None,
) -> Column:
    """A cell of class ``k``; payload fields of other classes are blanked."""
    given = {"integer": ("i", i), "real": ("r", r), "text": ("t", t), "blob": ("b", b)}
    fields = {name: F.when(k == cls, col) for cls, (name, col) in given.items() if col is not None}
    return _struct(CELL, {"k": k, **fields})


def make_value(kind: str, payload: Column | None = None) -> Column:
    """A value of that kind."""
    given = {} if payload is None else {kind.lower(): payload}
    return _struct(VALUE, {"kind": F.lit(kind), **given})


def _first_value(branches: list[tuple[Column, str, Column]]) -> Column:
    """The value of the first branch whose condition holds, else the NULL value.

    The result is a CASE over whole structs on purpose: the optimizer would inline a plain struct of
    expressions into every later use of its fields.
    """
    result = None
    for condition, kind, payload in branches:
        value = make_value(kind, payload)
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result.otherwise(make_value("NULL"))


def is_struct_of(dtype: T.DataType, schema: T.StructType) -> bool:
    return isinstance(dtype, T.StructType) and dtype.fieldNames() == schema.fieldNames()


def truncated_long(real: Column) -> Column:
    """A double cut toward zero to a 64-bit integer: saturating at both ends, 0 for NaN."""
    return (
        F.when(real.isNull(), F.lit(None).cast("bigint"))
        .when(F.isnan(real), F.lit(0).cast("bigint"))
        .when(real >= float(2**63), F.lit(_MAX_LONG).cast("bigint"))
        .when(real <= float(-(2**63)), F.lit(_MIN_LONG).cast("bigint"))
        .otherwise(real.try_cast("bigint"))
    )


def coerce_cell(cell: Column, target: Column | str) -> Column:
    """Coerce a cell toward a native type; what does not fit keeps the kind of its storage class.

    With ``target`` known as text, only the branches of that type are built.
    """
    i, r, t, b = cell["i"], cell["r"], cell["t"], cell["b"]
    long, double, boolean = parse_integer(t), parse_double(t), parse_boolean(t)
    conversions = [
        (i, N.BOOL, N.BOOL, i != 0),
        (i, N.FLOAT64, N.FLOAT64, i.cast("double")),
        (i, N.TEXT, N.TEXT, i.cast("string")),
        (i, None, N.INT64, i),
        (r, N.INT64, N.INT64, truncated_long(r)),
        (r, N.TEXT, N.TEXT, plain_double(r)),
        (r, None, N.FLOAT64, r),
        (long, N.INT64, N.INT64, long),
        (double, N.FLOAT64, N.FLOAT64, double),
        (boolean, N.BOOL, N.BOOL, boolean),
        (t, None, N.TEXT, t),
        (b, None, N.BLOB, b),
    ]
    if isinstance(target, str):
        kept = [c for c in conversions if c[1] in (None, target)]
        return _first_value([(source.isNotNull(), kind, payload) for source, _, kind, payload in kept])
    return _first_value(
        [
            (source.isNotNull() & (F.lit(True) if wanted is None else target == wanted), kind, payload)
            for source, wanted, kind, payload in conversions
        ]
    )


def not_null_word(trimmed: Column) -> Column:
    """Trimmed text; NULL when it is empty or the word ``null`` in any case."""
    return F.when(~trimmed.rlike(NULL_TEXT), trimmed)


def given_text(text: Column) -> Column:
    """Edited text without outer blanks; NULL when it is blank or the word ``null`` in any case."""
    return not_null_word(trim_blanks(text))


def parse_for_type(text: Column, declared: Column | str) -> Column:
    """Read an edited text toward a column type name; what cannot be read stays as trimmed text.

    Blank text and the word ``null`` in any case are NULL.
    """
    given = given_text(text)
    readings = [
        (("INT",), N.INT64, parse_integer(given)),
        (("FLOAT", "REAL", "DOUBLE"), N.FLOAT64, parse_double(given)),
        (("BOOL",), N.BOOL, parse_boolean(given)),
    ]
    branches = []
    for words, kind, parsed in readings:
        if isinstance(declared, str):
            if any(word in declared.upper() for word in words):
                branches.append((parsed.isNotNull(), kind, parsed))
        else:
            asked = reduce(or_, [folded(declared).contains(word.lower()) for word in words])
            branches.append((asked & parsed.isNotNull(), kind, parsed))
    return _first_value([*branches, (given.isNotNull(), N.TEXT, given)])


# The text shapes a temporal or UUID column takes.
_CLOCK = r"[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?"
DATE_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
TIME_SHAPE = rf"\A{_CLOCK}\z"
TIMESTAMP_SHAPE = rf"\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T]{_CLOCK})?\z"
ZONED_SHAPE = rf"\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T]{_CLOCK} ?(Z|[+-][0-9]{{2}}:[0-9]{{2}})\z"
UUID_SHAPE = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"

# Trimmed text that stands for NULL in an edited cell.
NULL_TEXT = r"(?i)\A(null)?\z"

# Microseconds in each unit an epoch number may be counted in.
EPOCH_UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1}
# First and last microsecond of the years 1 to 9999; other epoch numbers are not taken as moments.
_FIRST_MICRO, _LAST_MICRO = -62_135_596_800_000_000, 253_402_300_799_999_999
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _clock_micros(text: Column) -> Column:
    """Microseconds of the day of ``hh:mm[:ss[.ffffff]]``, NULL when out of range."""
    whole = F.concat(F.lit("1970-01-01 "), text).try_cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), whole)


@dataclass(frozen=True)
class Payload:
    """Columns of which at most one is not NULL: what one cell, value or text holds."""

    i: Column | None = None
    r: Column | None = None
    z: Column | None = None
    t: Column | None = None
    b: Column | None = None

    @classmethod
    def of_cell(cls, cell: Column) -> "Payload":
        return cls(i=cell["i"], r=cell["r"], t=cell["t"], b=cell["b"])

    @classmethod
    def of_value(cls, value: Column) -> "Payload":
        return cls(i=value["int64"], r=value["float64"], z=value["bool"], t=value["text"], b=value["blob"])

    def given(self) -> Column:
        """Whether there is anything but NULL."""
        return reduce(or_, [p.isNotNull() for p in (self.i, self.r, self.z, self.t, self.b) if p is not None])

    def kind(self) -> Column:
        """The value kind of what is held."""
        named = ((self.i, N.INT64), (self.r, N.FLOAT64), (self.z, N.BOOL), (self.t, N.TEXT), (self.b, N.BLOB))
        return F.coalesce(*[F.when(p.isNotNull(), kind) for p, kind in named if p is not None])

    def text(self) -> Column:
        """What is held as plain text, blobs in hex digits."""
        shown = [p.cast("string") for p in (self.t, self.i, self.r, self.z) if p is not None]
        return F.coalesce(*shown, *([] if self.b is None else [F.concat(F.lit("0x"), F.lower(F.hex(self.b)))]))

    def as_type(self, target: N.NativeType, time_type: bool = False, epoch_unit: str | None = None) -> Column:
        """Coerced and cast to a native type; NULL both for NULL and for what does not fit.

        Numbers become temporal only when ``epoch_unit`` says what they count.
        """
        kind, dtype = target.kind, target.spark_type(time_type)
        readings = {
            N.INT64: [(self.i, _same), (self.r, truncated_long), (self.t, parse_integer)],
            N.FLOAT64: [(self.r, _same), (self.i, lambda i: i.cast("double")), (self.t, parse_double)],
            N.BOOL: [(self.z, _same), (self.i, lambda i: i != 0), (self.t, parse_boolean)],
            N.TEXT: [(self.t, _same), (self.i, lambda i: i.cast("string")), (self.r, plain_double)],
            N.BLOB: [(self.b, _same)],
            N.UUID: [
                (self.t, lambda t: F.when(t.rlike(UUID_SHAPE), F.lower(t))),
                (self.b, lambda b: F.when(F.octet_length(b) == 16, uuid_text(b))),
            ],
            N.DECIMAL: [
                (self.i, lambda i: i.try_cast(dtype)),
                (self.r, lambda r: r.try_cast(dtype)),
                (self.t, lambda t: F.when(t.rlike(DECIMAL_PATTERN), t.try_cast(dtype))),
            ],
        }.get(kind)
        if readings is None:
            readings = [(self.t, lambda t: _temporal_text(t, kind, time_type))]
            if epoch_unit is not None:
                factor = EPOCH_UNITS[epoch_unit]
                readings += [
                    (self.i, lambda i: _temporal_number(i.cast(T.DecimalType(38, 0)) * factor, kind, time_type)),
                    (self.r, lambda r: _temporal_number(r.try_cast(T.DecimalType(38, 6)) * factor, kind, time_type)),
                ]
        found = [read(part) for part, read in readings if part is not None]
        return F.coalesce(*found) if found else F.lit(None).cast(dtype)


def _same(column: Column) -> Column:
    return column


def _temporal_number(scaled: Column, kind: str, time_type: bool) -> Column:
    """A count of microseconds since the epoch, or since midnight, as a temporal value."""
    micros = F.when(scaled.between(_FIRST_MICRO, _LAST_MICRO), F.floor(scaled).try_cast("bigint"))
    moment = F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))
    if kind == N.DATE:
        return moment.cast("date")
    if kind == N.TIMESTAMP:
        return moment
    if kind == N.TIMESTAMPTZ:
        return F.timestamp_micros(micros)
    return _time_of_day(F.when((micros >= 0) & (micros < 86_400_000_000), micros), time_type)


def _time_of_day(micros: Column, time_type: bool) -> Column:
    if not time_type:
        return micros
    moment = F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))
    return F.date_format(moment, "HH:mm:ss.SSSSSS").try_cast(T.TimeType(6))


def _temporal_text(text: Column, kind: str, time_type: bool) -> Column:
    """Guarded casts: Spark alone would take ``1936`` as a date and drop a trailing zone."""
    if kind == N.DATE:
        return F.when(text.rlike(DATE_SHAPE), text.try_cast("date"))
    if kind == N.TIMESTAMP:
        return F.when(text.rlike(TIMESTAMP_SHAPE), text.try_cast("timestamp_ntz"))
    if kind == N.TIMESTAMPTZ:
        zoned = F.when(text.rlike(ZONED_SHAPE), text)
        clock = F.when(F.length(text) == 10, F.lit(" 00:00")).otherwise("")
        utc = F.when(text.rlike(TIMESTAMP_SHAPE), F.concat(text, clock, F.lit("Z")))
        return F.coalesce(zoned, utc).try_cast("timestamp")
    return _time_of_day(F.when(text.rlike(TIME_SHAPE), _clock_micros(text)), time_type)
