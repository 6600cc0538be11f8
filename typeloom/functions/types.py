"""Declared column types: mapping to native types, back to storage affinities, and default screening."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.lexical import BLANKS, FLOAT_PATTERN, UNSIGNED_PATTERN, folded, is_word, named, trim_blanks

# Native type names.
INT64, FLOAT64, BOOL, TEXT, BLOB = "INT64", "FLOAT64", "BOOL", "TEXT", "BLOB"
DECIMAL, UUID = "DECIMAL", "UUID"
TIMESTAMP, TIMESTAMPTZ, DATE, TIME = "TIMESTAMP", "TIMESTAMPTZ", "DATE", "TIME"
NATIVE_TYPES = (INT64, FLOAT64, BOOL, TEXT, BLOB, DECIMAL, UUID, TIMESTAMP, TIMESTAMPTZ, DATE, TIME)

# Limits of a decimal and what a bare DECIMAL means; the largest precision that is read at all.
MAX_PRECISION, DEFAULT_PRECISION, DEFAULT_SCALE, MAX_DECLARED = 18, 18, 6, 255

# Which words in a declaration give which type; the first match wins.
DECLARED_WORDS = (
    (BOOL, ("BOOL",)),
    (UUID, ("UUID", "GUID")),
    (DECIMAL, ("^DECIMAL", "^NUMERIC")),
    (TIMESTAMPTZ, ("TIMESTAMPTZ", "TIMESTAMP WITH TIME ZONE")),
    (TIMESTAMP, ("TIMESTAMP", "DATETIME")),
    (DATE, ("DATE",)),
    (TIME, ("TIME",)),
    (INT64, ("INT",)),
    (TEXT, ("CHAR", "CLOB", "TEXT")),
    (BLOB, ("BLOB", "BINARY", "BYTEA")),
    (FLOAT64, ("REAL", "FLOA", "DOUB")),
)

# Which words in a native type name give which storage affinity; the first match wins.
AFFINITY_WORDS = (
    ("INTEGER", ("INT", "BOOL")),
    ("REAL", ("FLOAT", "REAL", "DOUBLE")),
    ("BLOB", ("BLOB", "GEOMETRY", "GEOGRAPHY")),
    ("NUMERIC", ("DECIMAL", "NUMERIC")),
)

# Bare words that are safe as a column default.
SAFE_DEFAULT_WORDS = ("NULL", "TRUE", "FALSE", "CURRENT_TIMESTAMP")


def first_word_match(text: Column, rules, fallback: str) -> Column:
    """The label of the first rule with a word in the folded ``text``; a word marked ``^`` must start it."""
    result = None
    for label, words in rules:
        lower = [w.lower() for w in words]
        hits = [text.startswith(w[1:]) if w.startswith("^") else text.contains(w) for w in lower]
        test = reduce(or_, hits)
        result = F.when(test, label) if result is None else result.when(test, label)
    return result.otherwise(fallback)


def _small_number(text: Column) -> Column:
    """An unsigned number up to 255, else NULL."""
    number = F.when(text.rlike(UNSIGNED_PATTERN), text.try_cast("bigint"))
    return F.when(number <= MAX_DECLARED, number.cast("int"))


def _bracketed(declared: Column, part: int) -> Column:
    """The trimmed n-th comma part between the first ``(`` and the first ``)``, NULL when there is none."""
    opening, closing = F.instr(declared, "("), F.instr(declared, ")")
    inner = F.when(
        (opening > 0) & (closing > opening), F.substr(declared, opening + 1, closing - opening - 1)
    )
    return F.btrim(F.get(F.split(inner, ",", -1), F.lit(part)), F.lit(BLANKS))


def map_declared_types(df: DataFrame, column: str) -> DataFrame:
    """Add ``type``, ``precision``, ``scale`` and ``native_type`` (the type as SQL text) for a declaration column.

    A NULL declaration counts as an empty one, which is text.  Columns of these names are refused.
    """
    taken = {"type", "precision", "scale", "native_type"} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} would be overwritten")
    declared = F.btrim(F.coalesce(named(column), F.lit("")), F.lit(BLANKS))
    is_decimal, stated = F.col("type") == DECIMAL, F.col("__precision").isNotNull()
    clamped = F.greatest(F.least("__precision", F.lit(MAX_PRECISION)), F.lit(1))
    scale = F.least(F.coalesce("__scale", F.lit(0)), clamped)
    # One step per projection: what a later step uses often is then computed once.
    return (
        df.withColumn("__declared", declared)
        .withColumn("__folded", folded(F.col("__declared")))
        .withColumn("type", first_word_match(F.col("__folded"), DECLARED_WORDS, TEXT))
        .withColumns({name: F.when(is_decimal, _bracketed(F.col("__declared"), n))
                      for n, name in enumerate(("__precision", "__scale"))})
        .withColumns({name: _small_number(F.col(name)) for name in ("__precision", "__scale")})
        .withColumns(
            {
                "precision": F.when(is_decimal, F.when(stated, clamped).otherwise(DEFAULT_PRECISION)),
                "scale": F.when(is_decimal, F.when(stated, scale).otherwise(DEFAULT_SCALE)),
            }
        )
        .withColumn(
            "native_type",
            F.when(is_decimal, F.concat(F.lit("DECIMAL("), "precision", F.lit(","), "scale", F.lit(")")))
            .otherwise(F.col("type")),
        )
        .drop("__declared", "__folded", "__precision", "__scale")
    )


def affinity(native_type: Column) -> Column:
    """The storage affinity of a native type name."""
    return first_word_match(folded(native_type), AFFINITY_WORDS, "TEXT")


def sqlite_affinity(df: DataFrame, column: str) -> DataFrame:
    """Add ``affinity`` for a column of native type names."""
    return df.withColumn("affinity", affinity(named(column)))


def is_safe_default(default: Column) -> Column:
    """Whether a default expression may be carried over as it stands; FALSE for NULL."""
    text = trim_blanks(default)
    safe = (
        is_word(text, *SAFE_DEFAULT_WORDS)
        | text.rlike(FLOAT_PATTERN)
        | (text.startswith("'") & text.endswith("'"))
    )
    return F.coalesce(safe, F.lit(False))


def screen_defaults(df: DataFrame, column: str) -> DataFrame:
    """Add ``safe`` for a column of default expressions."""
    return df.withColumn("safe", is_safe_default(named(column)))


@dataclass(frozen=True)
class NativeType:
    """A native column type known on the driver."""

    kind: str
    precision: int | None = None
    scale: int | None = None

    @classmethod
    def parse(cls, text: str) -> "NativeType":
        """Read the ``native_type`` text made by :func:`map_declared_types`."""
        decimal = re.fullmatch(r"DECIMAL\((\d+),(\d+)\)", text)
        if decimal:
            return cls(DECIMAL, int(decimal[1]), int(decimal[2]))
        if text not in NATIVE_TYPES or text == DECIMAL:
            raise ValueError(f"not a native type: {text!r}")
        return cls(text)

    def spark_type(self, time_type: bool = False) -> T.DataType:
        """The Spark column type; TIME is a count of microseconds unless ``time_type``."""
        return {
            INT64: T.LongType(),
            FLOAT64: T.DoubleType(),
            BOOL: T.BooleanType(),
            TEXT: T.StringType(),
            BLOB: T.BinaryType(),
            DECIMAL: T.DecimalType(self.precision or DEFAULT_PRECISION, self.scale or 0),
            UUID: T.StringType(),
            TIMESTAMP: T.TimestampNTZType(),
            TIMESTAMPTZ: T.TimestampType(),
            DATE: T.DateType(),
            TIME: T.TimeType(6) if time_type else T.LongType(),
        }[self.kind]


# Field metadata that tells kinds apart when the Spark type alone does not (a UUID is a string in Spark).
KIND_KEY = "kind"


def column_kind(field: T.StructField) -> str:
    """The value kind of a Spark column; metadata first, then the type."""
    if KIND_KEY in (field.metadata or {}):
        return field.metadata[KIND_KEY]
    dtype = field.dataType
    if isinstance(dtype, T.StructType):
        return STRUCT_KINDS.get(tuple(dtype.fieldNames()), "")
    for base, kind in _SPARK_KINDS:
        if isinstance(dtype, base):
            return kind
    return ""


def native_type_of(field: T.StructField) -> str:
    """The native type text of a Spark column."""
    kind = column_kind(field)
    if kind == DECIMAL:
        return f"DECIMAL({field.dataType.precision},{field.dataType.scale})"
    if not kind:
        raise TypeError(f"column {field.name!r}: no native type for {field.dataType.simpleString()}")
    return kind


_SPARK_KINDS = (
    (T.NullType, "NULL"),
    (T.IntegralType, INT64),
    (T.DoubleType, FLOAT64),
    (T.FloatType, FLOAT64),
    (T.BooleanType, BOOL),
    (T.StringType, TEXT),
    (T.BinaryType, BLOB),
    (T.DecimalType, DECIMAL),
    (T.TimestampNTZType, TIMESTAMP),
    (T.TimestampType, TIMESTAMPTZ),
    (T.DateType, DATE),
    (T.TimeType, TIME),
)

# Kinds held in a struct, known by the struct's field names.
STRUCT_KINDS = {
    ("enum_type_id", "label_id"): "ENUM",
    ("family", "addr"): "IPADDR",
    ("family", "prefix_len", "network"): "CIDR",
    ("len", "bytes"): "MACADDR",
    ("months", "days", "micros"): "INTERVAL",
}
