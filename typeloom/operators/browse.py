"""Stable pages of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.lexical import named
from typeloom.operators.numbering import NUMBER, number_rows

PAGE_SIZE = 200
#: Rows up to which a page is taken from the top of the order; a deeper one is found by numbering the rows.
TOP_ROWS = 100_000


def browse(df: DataFrame, keys: Sequence[str], page: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``page`` (from 0) in the order of the keys, and of the other columns where keys repeat.

    So pages never share or lose a row.  An early page is a top-k of the rows up to its end; a deep one takes a
    sort in ranges, and no task holds what comes before it.
    """
    if page < 0 or size < 1:
        raise ValueError("page must be 0 or more, size 1 or more")
    order = whole_order(df, keys)
    if (page + 1) * size <= TOP_ROWS:
        return df.orderBy(*map(named, order)).offset(page * size).limit(size)
    numbered = number_rows(df, order)
    wanted = F.col(NUMBER).between(page * size + 1, (page + 1) * size)
    return numbered.filter(wanted).drop(NUMBER).orderBy(*map(named, order))


def whole_order(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """The keys, then all other columns: an order in which only equal rows tie."""
    return [*keys, *(c for c in df.columns if c not in keys)]


def _after(column: Column, last: Any) -> Column:
    """Rows sorted after ``last``; NULL sorts first."""
    return column.isNotNull() if last is None else column > F.lit(last)


def browse_after(
    df: DataFrame,
    keys: Sequence[str],
    last: Sequence[Any] | Mapping[str, Any],
    size: int = PAGE_SIZE,
    shown: int = 1,
) -> DataFrame:
    """The page after the row whose key is ``last``; costs the same at any depth.

    ``last`` holds the key values if keys are unique.  If they repeat, give the whole last row as a mapping: the
    other columns then order rows of one key, and ``shown`` says how many rows equal to the last one the pages so
    far held, as equal rows may go on on the next.  The bound on the first key stands alone in the filter so that
    it reaches the scan's file statistics.
    """
    whole = isinstance(last, Mapping)
    if whole:
        keys = whole_order(df, keys)
        if set(keys) != set(last) or shown < 1:
            raise ValueError("last must hold every column, and be shown once at least")
        last = [last[k] for k in keys]
    if len(keys) != len(last) or not keys:
        raise ValueError("last must hold one value per key column")
    steps, equal = [], F.lit(True)
    for key, value in zip(keys, last):
        steps.append(equal & _after(named(key), value))
        equal = equal & named(key).eqNullSafe(F.lit(value))
    # Rows equal to the last one sort first, so passing over those shown leaves the others.
    beyond = reduce(or_, [*steps, equal] if whole else steps)
    if last[0] is not None:
        beyond = (named(keys[0]) >= F.lit(last[0])) & beyond
    ordered = df.filter(beyond).orderBy(*[named(k) for k in keys])
    return (ordered.offset(shown) if whole else ordered).limit(size)
