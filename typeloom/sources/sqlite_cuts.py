"""Cuts of SQLite tables into shares of like size, made by tasks.

A table with row ids is cut by them: gaps between ids are cut away by index probes, so that the width of what is left
bounds its rows.  A table without row ids is cut by its whole key, in two steps.  One task halves the key order by probes,
between the first and the last key of a span: in the first key column in which these differ, and there between their
numbers or between their bytes after those in common.  Then a task for each span walks its index and takes every so many
rows a key as the end of a share; SQLite skips rows in its index some thirty times faster than they are read as values.
All bounds are keys that the table holds, compared by SQLite in the key's own collations and directions.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession

from typeloom.functions.lexical import quoted
from typeloom.sources.sqlite_connect import connect, table_columns
from typeloom.sources.sqlite_filters import Condition
from typeloom.session import ship_package

# The two storage classes that are compared with each other by value.
_NUMBERS = ("integer", "real")
_FIRST_ID, _LAST_ID = -(2**63), 2**63 - 1
#: Spans of a keyed table that are walked by a task each, and rows of a span whose size is measured.
SPANS, MEASURED = 64, 64
#: Shares of a table, about; where there would be more, each is larger, so that planning and starting them stays bounded.
MOST_SHARES = 2_000
Span = tuple[int, int]


@dataclass(frozen=True)
class KeySpace:
    """The row ids of a table, on a line of integers."""

    connection: object
    table: str
    key: str

    def condition(self, span: Span | None) -> Condition:
        """The rows of a span; all for None."""
        low, high = span or (_FIRST_ID, _LAST_ID)
        tests = [(f"{self.key} >= ?", low)] if low > _FIRST_ID else []
        if high < _LAST_ID:
            tests.append((f"{self.key} <= ?", high))
        return Condition(" AND ".join(t for t, _ in tests) or "1", tuple(v for _, v in tests))

    def edges(self, span: Span | None) -> list[Span]:
        """The span from the first to the last id within a span, by two index probes; none if it is empty."""
        condition, found = self.condition(span), []
        for way in ("ASC", "DESC"):
            query = f"SELECT {self.key} FROM {quoted(self.table)} WHERE {condition.sql} ORDER BY {self.key} {way} LIMIT 1"
            row = self.connection.execute(query, condition.bound).fetchone()
            if row is None:
                return []
            found.append(row[0])
        return [tuple(found)]


def _width(spans: list[Span]) -> int:
    return sum(high - low + 1 for low, high in spans)


def occupied_spans(space: KeySpace, pieces: int) -> list[list[Span]]:
    """Cut a table's row ids into at most about ``pieces`` groups of spans of like width."""
    spans = space.edges(None)
    while spans:
        total = _width(spans)
        step = -(-total // pieces)
        spans = [
            part
            for low, high in spans
            for start in range(low, high + 1, step)
            for part in space.edges((start, min(start + step - 1, high)))
        ]
        if _width(spans) > 0.9 * total:
            break
    if not spans:
        return []

    step = -(-_width(spans) // pieces)
    groups: list[list[Span]] = [[]]
    for part in spans:
        if groups[-1] and _width(groups[-1]) + _width([part]) > step:
            groups.append([])
        groups[-1].append(part)
    return groups


def row_id(connection, table: str) -> str | None:
    """A name of the table's row id that no column hides; None for a table without one."""
    names = {row[1].lower() for row in table_columns(connection, table)}
    for alias in ("rowid", "_rowid_", "oid"):
        if alias not in names:
            try:
                connection.execute(f"SELECT {alias} FROM {quoted(table)} LIMIT 0")
                return alias
            except Exception:
                return None
    return None


# --- keys of several columns ----------------------------------------------------------------------------------

#: A key as SQLite gives it: the class of each column, and its value; texts as bytes.
Key = tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class KeyedTable:
    """A table without row ids, in the order of its key."""

    connection: object
    table: str
    columns: list[str]
    collations: list[str]
    descending: list[bool]
    shown: str = field(default="", compare=False)

    @classmethod
    def of(cls, connection, table: str) -> "KeyedTable | None":
        for index in connection.execute(f"PRAGMA index_list({quoted(table)})").fetchall():
            if index[3] == "pk":
                members = connection.execute(f"PRAGMA index_xinfo({quoted(index[1])})").fetchall()
                keys = [m for m in sorted(members) if m[5]]
                names = [quoted(m[2]) for m in keys]
                shown = ", ".join(
                    f"typeof({n}), CASE typeof({n}) WHEN 'text' THEN CAST({n} AS BLOB) ELSE {n} END" for n in names
                )
                return cls(connection, table, names, [m[4] for m in keys], [bool(m[3]) for m in keys], shown)
        return None

    def _test(self, n: int, sign: str, value: tuple[str, object]) -> Condition:
        # A cast alone would carry an affinity into the comparison; the plus takes it off.
        marker = "+CAST(? AS TEXT)" if value[0] == "text" else "?"
        return Condition(f"{self.columns[n]} {sign} {marker}", (value[1],))

    def _all(self, *tests: Condition) -> Condition:
        return Condition(" AND ".join(t.sql for t in tests) or "1", tuple(b for t in tests for b in t.bound))

    def _after(self, n: int) -> str:
        return "<" if self.descending[n] else ">"

    def _before(self, n: int) -> str:
        return ">" if self.descending[n] else "<"

    def _same(self, n: int, a: tuple[str, object], b: tuple[str, object]) -> bool:
        """Whether two values are one in the key order; numbers of both classes may be, and texts under a collation."""
        if a == b or self.collations[n] == "BINARY" or not a[0] == b[0] == "text":
            return a == b or (a[0] in _NUMBERS and b[0] in _NUMBERS and a[1] == b[1])
        return self._compares(n, a, "=", b)

    def _compares(self, n: int, a: tuple[str, object], sign: str, b: tuple[str, object]) -> bool:
        marks = ["+CAST(? AS TEXT)" if v[0] == "text" else "?" for v in (a, b)]
        query = f"SELECT {marks[0]} {sign} {marks[1]} COLLATE {quoted(self.collations[n])}"
        return bool(self.connection.execute(query, (a[1], b[1])).fetchone()[0])

    def _parting(self, low: Key, high: Key) -> int | None:
        """The first column in which two keys differ."""
        return next((n for n in range(len(low)) if not self._same(n, low[n], high[n])), None)

    def _prefix(self, key: Key, n: int) -> list[Condition]:
        return [self._test(k, "=", key[k]) for k in range(n)]

    def between(self, low: Key | None, high: Key | None) -> list[Condition]:
        """The keys from ``low`` on, before ``high``, as conditions in key order, each one range of the index."""
        last = len(self.columns) - 1
        same = 0 if low is None or high is None else self._parting(low, high)
        if same is None:
            return []
        found = []
        if low is not None:
            for n in range(last, same, -1):
                sign = self._after(n) + ("=" if n == last else "")
                found.append(self._all(*self._prefix(low, n), self._test(n, sign, low[n])))
        middle = self._prefix(low or high or (), same)
        if low is not None:
            middle.append(self._test(same, self._after(same) + ("=" if same == last else ""), low[same]))
        if high is not None:
            middle.append(self._test(same, self._before(same), high[same]))
        found.append(self._all(*middle))
        if high is not None:
            for n in range(same + 1, last + 1):
                found.append(self._all(*self._prefix(high, n), self._test(n, self._before(n), high[n])))
        return found

    def probe(self, condition: Condition, skip: int = 0, back: bool = False) -> Key | None:
        """The key ``skip`` rows after the first, or before the last, that meets a condition."""
        order = ", ".join(f"{c} {'DESC' if d != back else 'ASC'}" for c, d in zip(self.columns, self.descending))
        query = f"SELECT {self.shown} FROM {quoted(self.table)} WHERE {condition.sql} ORDER BY {order} LIMIT 1 OFFSET {skip}"
        row = self.connection.execute(query, condition.bound).fetchone()
        return tuple(zip(row[::2], row[1::2])) if row else None

    def count(self, condition: Condition) -> int:
        query = f"SELECT count(*) FROM {quoted(self.table)} WHERE {condition.sql}"
        return self.connection.execute(query, condition.bound).fetchone()[0]

    def middle(self, low: Key, last: Key) -> Key | None:
        """A key after ``low``, up to ``last``, about halfway by value; None if there is none such."""
        n = self._parting(low, last)
        if n is None:
            return None
        value = _between(low[n], last[n], self.collations[n])
        tests = [*self._prefix(low, n), self._test(n, self._before(n) + "=", last[n])]
        # One bound on each side, as SQLite seeks by one and tests the other row by row.
        halfway = self.probe(self._all(*tests, self._test(n, self._after(n) + "=", value))) if value else None
        if halfway and self._compares(n, halfway[n], self._after(n), low[n]):
            return halfway
        # Without a value in between the keys of the last one are the other half.
        return self.probe(self._all(*tests, self._test(n, self._after(n), low[n])))

    def spans(self, most: int = SPANS) -> list[tuple[Key, Key]]:
        """Spans of the key order by their first and last key, up to about ``most``, found by probes alone."""
        first, last = self.probe(Condition("1")), self.probe(Condition("1"), back=True)
        spans = [(first, last)] if first else []
        while len(spans) < most:
            halves = []
            for low, high in spans:
                cut = self.middle(low, high)
                n = self._parting(low, cut) if cut else None
                # The cut is the first key of its value there, so what is before has a lesser one.
                left = None if n is None else self.probe(
                    self._all(*self._prefix(cut, n), self._test(n, self._before(n), cut[n])), back=True
                )
                halves += [(low, left), (cut, high)] if left else [(low, high)]
            if len(halves) == len(spans):
                break
            spans = halves
        return spans

    def row_bytes(self, low: Key | None, high: Key | None) -> float:
        """Bytes of an average row among the first of a span."""
        size = " + ".join(f"coalesce(length(CAST({quoted(c[1])} AS BLOB)), 1)" for c in table_columns(self.connection, self.table))
        total = rows = 0
        for condition in self.between(low, high):
            query = f"SELECT count(*), sum(s) FROM (SELECT {size} AS s FROM {quoted(self.table)} WHERE {condition.sql} LIMIT {MEASURED})"
            n, held = self.connection.execute(query, condition.bound).fetchone()
            total, rows = total + (held or 0), rows + n
            if rows >= MEASURED:
                break
        return total / max(rows, 1) + 4

    def shares(self, low: Key | None, high: Key | None, rows: int) -> Iterator[tuple[list[Condition], int]]:
        """Conditions for every ``rows`` rows from ``low`` on, before ``high``, with how many rows meet them."""
        start, left = low, rows
        parts = self.between(low, high)
        while parts:
            end = self.probe(parts[0], left)
            if end is None:
                left -= self.count(parts.pop(0))
                continue
            yield self.between(start, end), rows
            start, left = end, rows
            parts = self.between(start, high)
        if left < rows:
            yield self.between(start, high), rows - left


def _between(low: tuple[str, object], high: tuple[str, object], collation: str) -> tuple[str, object] | None:
    """A value after the lesser, up to the greater, of two different ones."""
    if low[0] in _NUMBERS and high[0] in _NUMBERS:
        a, b = sorted(max(-(2**63), min(2**63, v[1])) for v in (low, high))
        mid = a + (b - a) / 2 if isinstance(a, float) or isinstance(b, float) else a + (b - a + 1) // 2
        if isinstance(mid, int):
            return ("integer", min(mid, _LAST_ID))
        return ("real", mid) if a < mid <= b else None
    if low[0] != high[0]:
        # Numbers come before texts, these before blobs.
        return ("blob", b"") if "blob" in (low[0], high[0]) else ("text", b"")
    a, b = (v[1] for v in (low, high))
    if collation == "NOCASE" and low[0] == "text":
        a, b = a.lower(), b.lower()
    if collation == "RTRIM" and low[0] == "text":
        a, b = a.rstrip(b" "), b.rstrip(b" ")
    a, b = sorted((a, b))
    common = len(os.path.commonprefix([a, b]))
    x, y = (int.from_bytes(s[common : common + 8].ljust(8, b"\0"), "big") for s in (a, b))
    mid = x + (y - x + 1) // 2
    return (low[0], a[:common] + mid.to_bytes(8, "big")) if x < mid else None


# --- planning in tasks ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Share:
    """A part of one file's table: the whole file if there are no conditions."""

    file: str
    conditions: tuple[Condition, ...] | None
    bytes: int


def packed_value(value):
    if isinstance(value, bytes):
        return {"b": value.hex()}
    return {"r": repr(value)} if isinstance(value, float) else value


def unpacked_value(value):
    if isinstance(value, dict):
        return bytes.fromhex(value["b"]) if "b" in value else float(value["r"])
    return value


def pack_conditions(conditions) -> str:
    return json.dumps([[c.sql, [packed_value(v) for v in c.bound]] for c in conditions])


def unpack_conditions(text: str) -> tuple[Condition, ...]:
    return tuple(Condition(sql, tuple(unpacked_value(v) for v in bound)) for sql, bound in json.loads(text))


def _pack_key(key: Key | None):
    return None if key is None else [[kind, packed_value(value)] for kind, value in key]


def _unpack_key(key) -> Key | None:
    return None if key is None else tuple((kind, unpacked_value(value)) for kind, value in key)


def _first_step(file: str, table: str, split_bytes: int) -> Iterator[tuple]:
    """``(columns, span, conditions, bytes)`` of a table in a file; spans are still to be walked."""
    with closing(connect(file)) as connection:
        columns = [row[1] for row in table_columns(connection, table)]
        size = os.path.getsize(file)
        if not columns:
            return
        if size <= split_bytes:
            yield columns, None, None, size
            return
        key = row_id(connection, table)
        if key is None:
            keyed = KeyedTable.of(connection, table)
            firsts = [low for low, _ in keyed.spans()] if keyed else []
            if not firsts:
                yield columns, None, pack_conditions([Condition("1")]), size
            for low, high in zip([None, *firsts[1:]], [*firsts[1:], None]):
                yield columns, json.dumps([_pack_key(low), _pack_key(high)]), None, 0
            return
        space = KeySpace(connection, table, key)
        edges = space.edges(None)
        # The table may be a small part of its file: what its first rows take, times its ids, bounds what it takes.
        held = " + ".join(f"coalesce(length(CAST({quoted(c)} AS BLOB)), 1)" for c in columns)
        measured = f"SELECT avg(s) FROM (SELECT {held} AS s FROM {quoted(table)} LIMIT {MEASURED})"
        wide = (connection.execute(measured).fetchone()[0] or 0) + 4
        most = -(-min(size, math.ceil(2 * wide * _width(edges))) // split_bytes)
        groups = occupied_spans(space, max(most, 1))
        for group in groups:
            yield columns, None, pack_conditions(space.condition(span) for span in group), min(split_bytes, size // len(groups))
        if not groups:
            yield columns, None, pack_conditions([Condition("0")]), 0


def _second_step(file: str, table: str, split_bytes: int, span: str) -> Iterator[tuple]:
    """``(conditions, bytes)`` of the shares of a span."""
    with closing(connect(file)) as connection:
        keyed = KeyedTable.of(connection, table)
        low, high = map(_unpack_key, json.loads(span))
        wide = keyed.row_bytes(low, high)
        for conditions, rows in keyed.shares(low, high, max(int(split_bytes / wide), 1)):
            yield pack_conditions(conditions), int(rows * wide)


_FOUND = pa.schema(
    [("file", pa.string()), ("table", pa.string()), ("place", pa.int64()), ("columns", pa.list_(pa.string())),
     ("span", pa.string()), ("conditions", pa.string()), ("bytes", pa.int64())]
)
_FOUND_TYPE = "file string, table string, place long, columns array<string>, span string, conditions string, bytes long"


def _mapped(step):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [dict(zip(_FOUND.names, values)) for values in step(row)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, _FOUND)

    return run


def _first_rows(row: dict, split_bytes: int) -> Iterator[tuple]:
    for n, (columns, span, conditions, size) in enumerate(_first_step(row["file"], row["table"], split_bytes)):
        yield row["file"], row["table"], n << 32, columns, span, conditions, size


def _second_rows(row: dict, split_bytes: int) -> Iterator[tuple]:
    if row["span"] is None:
        yield tuple(row[name] for name in _FOUND.names)
        return
    for n, (conditions, size) in enumerate(_second_step(row["file"], row["table"], split_bytes, row["span"])):
        yield row["file"], row["table"], row["place"] + n, row["columns"], None, conditions, size


@dataclass(frozen=True)
class Cuts:
    """The shares of a table over its files, and the columns of the first file that has it."""

    columns: list[str]
    shares: list[Share]

    def packed(self) -> str:
        return json.dumps(
            [[s.file, None if s.conditions is None else pack_conditions(s.conditions), s.bytes] for s in self.shares]
        )


def unpack_shares(text: str) -> list[Share]:
    return [Share(f, None if c is None else unpack_conditions(c), n) for f, c, n in json.loads(text)]


def share_bytes(sizes: list[int], split_bytes: int) -> int:
    """What a share of a table in files of these sizes holds, about: ``split_bytes``, or more for a very large table."""
    return max(split_bytes, -(-sum(sizes) // MOST_SHARES))


def plan_cuts(spark: SparkSession, files: dict[str, list[str]], split_bytes: int) -> dict[str, Cuts]:
    """The shares of each table, over the ``files`` given for it; files are opened by tasks only.

    What comes back is some hundred bytes for each share.  A file that lacks the table has none; nor has a table that no
    file has.
    """
    ship_package(spark)
    sizes = {file: os.path.getsize(file) for names in files.values() for file in names}
    least = {table: share_bytes([sizes[file] for file in names], split_bytes) for table, names in files.items()}
    pairs = [(file, table) for table, names in files.items() for file in names]
    tasks = max(min(len(pairs), 10_000), 1)
    rows = spark.createDataFrame(pairs, "file string, table string").repartition(tasks)
    rows = rows.mapInArrow(_mapped(lambda row: _first_rows(row, least[row["table"]])), _FOUND_TYPE)
    # Spans go to tasks of their own; without a key AQE would see too little data to keep them apart.
    rows = rows.repartition(min(SPANS * 4, tasks * SPANS)).mapInArrow(
        _mapped(lambda row: _second_rows(row, least[row["table"]])), _FOUND_TYPE
    )
    order = {file: n for names in files.values() for n, file in enumerate(names)}
    cuts: dict[str, Cuts] = {}
    for row in sorted(rows.collect(), key=lambda r: (r["table"], order[r["file"]], r["place"])):
        made = cuts.setdefault(row["table"], Cuts(list(row["columns"]), []))
        conditions = None if row["conditions"] is None else unpack_conditions(row["conditions"])
        made.shares.append(Share(row["file"], conditions, row["bytes"]))
    return cuts
