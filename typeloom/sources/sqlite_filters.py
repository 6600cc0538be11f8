"""Spark's filters on the fields of cells, as SQL that a SQLite file evaluates to the same rows.

A cell's payload field is null unless the cell is of that storage class, and comparisons with null keep no row; so every
test is joined with the class, and no value is ever compared with one of another class.  What SQLite might decide
differently is left to Spark: the order of texts, whose bytes depend on the file, and texts that may stand for invalid
ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import datasource as D

from typeloom.functions.cells import STORAGE_CLASSES
from typeloom.functions.lexical import quoted


@dataclass(frozen=True)
class Condition:
    """A SQL condition, and what it binds."""

    sql: str
    bound: tuple = ()


# The storage class that each payload field belongs to.
FIELD_CLASSES = {"i": "integer", "r": "real", "t": "text", "b": "blob"}
_ORDER = {D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def _comparable(field: str, value) -> bool:
    """Whether SQLite finds a payload equal to ``value`` exactly where Spark does."""
    if field == "i":
        return isinstance(value, int) and -(2**63) <= value < 2**63
    if field == "r":
        return isinstance(value, float) and not math.isnan(value)
    if field == "b":
        return isinstance(value, (bytes, bytearray))
    # The replacement character stands for any invalid bytes.
    return isinstance(value, str) and "�" not in value


def _bound(field: str, value):
    return bytes(value) if field == "b" else value


def _members(column: str, field: str, values: tuple, negated: bool = False) -> Condition | None:
    held = [v for v in values if v is not None]
    if not all(_comparable(field, v) for v in held) or (negated and len(held) < len(values)):
        return None
    of_class = f"typeof({column}) = '{FIELD_CLASSES[field]}'"
    if not held:
        return Condition("1" if negated and not values else "0")
    marks, bound = ", ".join("?" * len(held)), tuple(_bound(field, v) for v in held)
    if negated:
        return Condition(f"{of_class} AND {column} COLLATE BINARY NOT IN ({marks})", bound)
    if field != "t":
        return Condition(f"{of_class} AND {column} IN ({marks})", bound)
    # An index may hold texts in another collation: it finds all that are equal in that, of which the bytes decide.
    return Condition(f"{of_class} AND {column} IN ({marks}) AND {column} COLLATE BINARY IN ({marks})", bound * 2)


def translated(filter: D.Filter) -> Condition | None:
    """The SQL of a filter; None for one that Spark must evaluate."""
    negated = isinstance(filter, D.Not)
    inner = filter.child if negated else filter
    path = getattr(inner, "attribute", ())
    column = quoted(path[0]) if path else ""
    field = path[1] if len(path) == 2 else None
    if len(path) == 1:
        # A cell itself is never null.
        if isinstance(inner, (D.IsNull, D.IsNotNull)):
            return Condition("1" if isinstance(inner, D.IsNotNull) != negated else "0")
        return None
    if field == "k":
        return _of_class(column, inner, negated)
    if field not in FIELD_CLASSES:
        return None
    if isinstance(inner, (D.IsNull, D.IsNotNull)):
        sign = "=" if isinstance(inner, D.IsNotNull) != negated else "<>"
        return Condition(f"typeof({column}) {sign} '{FIELD_CLASSES[field]}'")
    if isinstance(inner, D.EqualTo):
        return _members(column, field, (inner.value,), negated)
    if isinstance(inner, D.In):
        return _members(column, field, tuple(inner.value), negated)
    sign = _ORDER.get(type(inner))
    if sign and not negated and field != "t" and _comparable(field, inner.value):
        return Condition(f"typeof({column}) = '{FIELD_CLASSES[field]}' AND {column} {sign} ?", (_bound(field, inner.value),))
    return None


def _of_class(column: str, inner: D.Filter, negated: bool) -> Condition | None:
    """A filter on the class itself, which is never null."""
    if isinstance(inner, (D.IsNull, D.IsNotNull)):
        return Condition("1" if isinstance(inner, D.IsNotNull) != negated else "0")
    values = [inner.value] if isinstance(inner, D.EqualTo) else inner.value if isinstance(inner, D.In) else None
    if values is None or not all(isinstance(v, str) for v in values):
        return None
    known = [v for v in STORAGE_CLASSES if v in values]
    listed = ", ".join(f"'{v}'" for v in known)
    if not known:
        return Condition("1" if negated else "0")
    return Condition(f"typeof({column}) {'NOT IN' if negated else 'IN'} ({listed})")
