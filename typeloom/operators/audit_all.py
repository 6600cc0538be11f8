"""All rules of a catalog in one pass over each table.

The keys of all rules of a table are grouped by one aggregation with grouping sets: each row is expanded to one row per
key, and counted before the shuffle.  NOT NULL counts are taken along.  Foreign keys then compare the grouped keys of
two tables, in which a hot key is one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.lexical import named
from typeloom.operators.audit import FOREIGN_KEY, NOT_NULL, PRIMARY_KEY, UNIQUE, Constraint, _as_rows
from typeloom.session import stored

LABELS = ["table", "rule", "columns"]


class _Grouped:
    """The grouped keys of one table: ``k0..``, ``set``, ``n``, and ``null0..`` in the row of the empty set."""

    def __init__(self, df: DataFrame, keys: Sequence[Sequence[str]], not_null: Sequence[str], keep: bool):
        self.columns = list(dict.fromkeys(c for key in keys for c in key))
        self.not_null = list(dict.fromkeys(not_null))
        flat = df.select(
            *(named(c).alias(f"k{i}") for i, c in enumerate(self.columns)),
            *(named(c).isNull().alias(f"null{i}") for i, c in enumerate(self.not_null)),
        )
        counts = [F.count(F.lit(1)).alias("n"), *(F.count_if(f"null{i}").alias(f"null{i}") for i in range(len(self.not_null)))]
        if self.columns:
            sets = list({frozenset(key): [F.col(n) for n in self.names(key)] for key in keys}.values())
            # The empty set counts all rows.
            grouped = flat.groupingSets([*sets, []], *(F.col(f"k{i}") for i in range(len(self.columns))))
            self.rows = grouped.agg(F.grouping_id().cast("long").alias("set"), *counts)
        else:
            self.rows = flat.agg(F.lit(0).cast("long").alias("set"), *counts)
        if keep:
            self.rows = stored(self.rows, "audit-keys")

    def names(self, key: Sequence[str]) -> list[str]:
        return [f"k{self.columns.index(c)}" for c in key]

    def of(self, key: Sequence[str]) -> Column:
        """Whether a row belongs to a key: its columns have bit 0 in the id of the set, others 1, the first column highest."""
        last = len(self.columns) - 1
        return F.col("set") == sum(0 if c in key else 1 << (last - i) for i, c in enumerate(self.columns))

    def any_null(self, key: Sequence[str]) -> Column:
        return reduce(or_, [F.col(n).isNull() for n in self.names(key)])

    def violations(self, rule: str, key: Sequence[str]) -> Column:
        if rule == NOT_NULL:
            counted = F.col(f"null{self.not_null.index(key[0])}")
            return F.coalesce(F.sum(F.when(self.of(()), counted)), F.lit(0))
        if rule == PRIMARY_KEY:
            return F.count_if(self.of(key) & ((F.col("n") > 1) | self.any_null(key)))
        return F.count_if(self.of(key) & (F.col("n") > 1) & ~self.any_null(key))


def audit_catalog(tables: Mapping[str, DataFrame], constraints: Sequence[Constraint]) -> DataFrame:
    """Violations of each constraint: ``(table, rule, columns, violations)``.

    Counted are rows for NOT NULL and foreign keys, distinct keys for primary keys and UNIQUE.  Every table is scanned
    and shuffled once; the grouped keys of tables that foreign keys touch are written, as several rules read them.
    """
    if not constraints:
        raise ValueError("no constraints given")
    keys: dict[str, list[tuple[str, ...]]] = {}
    not_null: dict[str, list[str]] = {}
    for c in constraints:
        if c.rule not in (PRIMARY_KEY, UNIQUE, NOT_NULL, FOREIGN_KEY):
            raise ValueError(f"unknown rule {c.rule!r}")
        if not c.columns:
            raise ValueError("no key columns given")
        if c.rule == NOT_NULL:
            not_null.setdefault(c.table, []).extend(c.columns)
            continue
        keys.setdefault(c.table, []).append(tuple(c.columns))
        if c.rule == FOREIGN_KEY:
            keys.setdefault(c.ref_table, []).append(tuple(c.ref_columns))
    touched = {t for c in constraints if c.rule == FOREIGN_KEY for t in (c.table, c.ref_table)}
    grouped = {
        t: _Grouped(tables[t], keys.get(t, []), not_null.get(t, []), t in touched) for t in dict.fromkeys([*keys, *not_null])
    }
    results = []
    for table, found in grouped.items():
        counts = [
            ((table, c.rule, ",".join(part)), found.violations(c.rule, part))
            for c in constraints
            if c.table == table and c.rule != FOREIGN_KEY
            for part in ([(name,) for name in c.columns] if c.rule == NOT_NULL else [tuple(c.columns)])
        ]
        if counts:
            results.append(_as_rows(found.rows, counts, LABELS))
    for c in constraints:
        if c.rule == FOREIGN_KEY:
            child, parent = grouped[c.table], grouped[c.ref_table]
            used = child.rows.filter(child.of(c.columns) & ~child.any_null(c.columns))
            used = used.select("n", *(F.col(n).alias(f"used{i}") for i, n in enumerate(child.names(c.columns))))
            known = parent.rows.filter(parent.of(c.ref_columns))
            known = known.select(*(F.col(n).alias(f"known{i}") for i, n in enumerate(parent.names(c.ref_columns))))
            match = reduce(and_, [F.col(f"used{i}") == F.col(f"known{i}") for i in range(len(c.columns))])
            lost = F.coalesce(F.sum("n"), F.lit(0))
            label = (c.table, FOREIGN_KEY, ",".join(c.columns))
            results.append(_as_rows(used.join(known, match, "left_anti"), [(label, lost)], LABELS))
    return reduce(DataFrame.unionByName, results).withColumnRenamed("n", "violations")
