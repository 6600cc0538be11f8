"""Text of doubles: shortest digits that read back to the same value, never an exponent."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Two different decimals of at most 15 digits never share a double (in the normal range), so a JVM text of 15
# digits or fewer is already the shortest.  Longer JVM texts are not always, and go through Arrow's.  A text of
# 16 characters has 15 digits at most, as it has a point.
_PROVEN_LENGTH = 16
_WHOLE_LIMIT = 1e15


@F.arrow_udf(T.StringType())
def _exact_text(values: pa.Array) -> pa.Array:
    """Texts of the values that the JVM's own text is not proven for; the others arrive as NULL.

    The cast gives the shortest digits for a whole batch; what it writes with an exponent is written out.
    """
    texts = pc.replace_substring_regex(values.cast(pa.string()), r"\.0$", "")
    marked = pc.match_substring(texts, "e")
    if not pc.any(marked).as_py():
        return texts
    plain = [format(Decimal(text), "f") for text in pc.filter(texts, marked).to_pylist()]
    return pc.replace_with_mask(texts, pc.fill_null(marked, False), pa.array(plain, pa.string()))


def _cut_zeros(text: Column) -> Column:
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def _double_text(value: Column, bare_text, whole_text) -> Column:
    """Text of a double; ``bare_text`` shapes JVM text without exponent, ``whole_text`` whole numbers below 1e15."""
    text, size = value.cast("string"), F.abs(value)
    proven = F.length(text) <= _PROVEN_LENGTH
    bare = proven & ((value == 0) | ((size >= 1e-3) & (size < 1e7)))
    whole = (size < _WHOLE_LIMIT) & (value == F.floor(value))
    large = proven & (size >= 1e7) & (size < _WHOLE_LIMIT)
    small = proven & (size >= 1e-19) & (size < 1e-3)
    other = ~(bare | whole | large | small | F.isnan(value) | (size == float("inf")))
    return (
        F.when(bare, bare_text(text))
        .when(whole, whole_text(value.try_cast("bigint").cast("string")))
        .when(large, _cut_zeros(text.try_cast(T.DecimalType(38, 18)).cast("string")))
        .when(small, _cut_zeros(text.try_cast(T.DecimalType(38, 37)).cast("string")))
        .when(F.isnan(value), F.lit("NaN"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .otherwise(_exact_text(F.when(other, value)))
    )


def plain_double(value: Column) -> Column:
    """``1`` for 1.0, ``0.00001`` for 1e-5; ``NaN``, ``inf`` and ``-inf`` for the others."""
    return _double_text(value, _cut_zeros, lambda digits: digits)


def display_double(value: Column) -> Column:
    """As :func:`plain_double`, but a whole number below 1e15 keeps one decimal: ``1.0``."""
    return _double_text(value, lambda text: text, lambda digits: F.concat(digits, F.lit(".0")))
