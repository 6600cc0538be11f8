"""Keyed edits: batches of inserts, updates and deletes that turn one table snapshot into the next.

Edits are reduced to one row per key by an aggregation (which pre-aggregates, so a hot key is cheap), then met
with the table in one NULL-safe join.  Spark broadcasts the edits when their measured size is small.  Otherwise
it splits skewed partitions of the table side; it can do so because the NULL-safe keys are shuffled anew after the
aggregation (a join that inherits the partitioning of an aggregation is never split).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.cells import Payload, not_null_word
from typeloom.functions.lexical import named, trim_blanks
from typeloom.functions.types import INT64, NativeType, column_kind, native_type_of
from typeloom.operators.audit import Constraint
from typeloom.operators.numbering import NUMBER, number_rows
from typeloom.session import checkpointed, stored

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def row_identity(df: DataFrame, keys: Sequence[str] | None = None) -> list[str]:
    """The columns that identify a row: the key, else every column (duplicates then all match)."""
    return list(keys) if keys else list(df.columns)


def _require_keys(keys: Sequence[str]) -> None:
    if not keys:
        raise ValueError("refusing to edit rows without key columns")


def _key_name(n: int) -> str:
    return f"__key_{n}"


def _renamed_keys(keys: Sequence[str]) -> list[Column]:
    return [named(k).alias(_key_name(n)) for n, k in enumerate(keys)]


def key_match(keys: Sequence[str]) -> Column:
    """NULL-safe equality of the key columns with their renamed twins, ANDed."""
    return reduce(and_, [named(k).eqNullSafe(F.col(_key_name(n))) for n, k in enumerate(keys)])


def key_predicate(row: Mapping[str, Any]) -> Column:
    """The predicate that selects the rows with these key values, NULL matching NULL."""
    _require_keys(list(row))
    return reduce(and_, [named(k).eqNullSafe(F.lit(v)) for k, v in row.items()])


def _typed(n: int) -> Column:
    return F.col(f"__typed_{n}")


def _trimmed(n: int) -> Column:
    return F.col(f"__text_{n}")


def with_typed_texts(df: DataFrame, texts: Sequence[tuple[Column, T.StructField]]) -> DataFrame:
    """Add ``__text_<n>``, each text trimmed, and ``__typed_<n>``, the same as content of its field.

    Text is parsed by the field's kind, then cast; text that does not fit fails the job.  One step per
    projection, as each step uses the one before several times.
    """
    fields = [field for _, field in texts]
    df = df.withColumns({f"__text_{n}": trim_blanks(text) for n, (text, _) in enumerate(texts)})
    df = df.withColumns({f"__given_{n}": not_null_word(_trimmed(n)) for n in range(len(texts))})
    df = df.withColumns({f"__typed_{n}": _read(F.col(f"__given_{n}"), field) for n, field in enumerate(fields)})
    checked = {}
    for n, field in enumerate(fields):
        given = F.col(f"__given_{n}")
        message = F.concat(F.lit(f"column {field.name}: not a {native_type_of(field)}: "), given)
        failed = F.raise_error(message).cast(field.dataType)
        checked[f"__typed_{n}"] = F.when(given.isNotNull() & _typed(n).isNull(), failed).otherwise(_typed(n))
    return df.withColumns(checked).drop(*[f"__given_{n}" for n in range(len(texts))])


def _read(given: Column, field: T.StructField) -> Column:
    target = NativeType.parse(native_type_of(field))
    return Payload(t=given).as_type(target, isinstance(field.dataType, T.TimeType)).cast(field.dataType)


def _checked_column(column: Column, allowed: Sequence[str]) -> Column:
    """``column`` itself; a name that may not be edited fails the job."""
    message = F.concat(F.lit("cannot set column "), F.coalesce(column, F.lit("NULL")))
    return F.when(column.isin(*allowed), column).otherwise(F.raise_error(message).cast("string"))


def _last_writes(writes: DataFrame, keys: Sequence[str], names: Sequence[str | None]) -> DataFrame:
    """One row per key, with ``__write_<n>`` the last write to ``names[n]`` as ``struct(seq, value)``, or NULL.

    ``writes`` has the keys, ``seq``, ``column`` and ``value``; of several with one ``seq`` the largest value counts, and
    the value may be NULL.  It is read once and shuffled once, a key's writes reduced to one row by each task before.
    Texts have no fixed width, so Spark sorts a task's writes by key to reduce them; finding the last ``seq`` by hashing
    instead and joining the writes with it takes two scans and three shuffles of them, and twice the time.
    """
    write = F.struct("seq", "value")
    lasts = [
        F.max(F.when(F.col("column").eqNullSafe(F.lit(name)), write)).alias(f"__write_{n}") for n, name in enumerate(names)
    ]
    return writes.groupBy(*keys).agg(*lasts)


def _merged(rows: DataFrame, base: DataFrame, names: Sequence[str], since: Column | None = None) -> DataFrame:
    """The base columns of ``rows`` with the writes ``__write_<n>`` to ``names`` applied; with ``since`` set, only later ones."""
    writes = {name: F.col(f"__write_{n}") for n, name in enumerate(names)}
    typed = with_typed_texts(rows, [(writes[name]["value"], base.schema[name]) for name in names])
    columns = []
    for name in base.columns:
        if name not in writes:
            columns.append(named(name))
            continue
        applies = writes[name].isNotNull()
        if since is not None:
            applies = applies & (since.isNull() | (writes[name]["seq"] > since))
        columns.append(F.when(applies, _typed(names.index(name))).otherwise(named(name)).alias(name))
    return typed.select(*columns)


def apply_updates(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Set cells by key from ``changes(keys..., seq, column, value)``; per cell the highest ``seq`` wins.

    ``value`` is text, read by the column's kind.  Key columns may be set too.  ``columns`` says which columns
    the changes may set (default all): naming them keeps the work small on a wide table.
    """
    _require_keys(keys)
    settable = list(columns or base.columns)
    checked = _checked_column(F.col("column"), settable).alias("column")
    writes = changes.select(*_renamed_keys(keys), "seq", checked, "value")
    state = _last_writes(writes, [_key_name(n) for n in range(len(keys))], settable)
    joined = base.join(state, key_match(keys), "left")
    return _merged(joined, base, settable)


def apply_deletes(base: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop the rows whose key is listed, NULL matching NULL."""
    _require_keys(keys)
    gone = keys_df.select(*_renamed_keys(keys)).distinct()
    return base.join(gone, key_match(keys), "left_anti")


def _checked_names(given: Column, allowed: Sequence[str]) -> Column:
    unknown = F.array_except(F.map_keys(given), F.array(*[F.lit(c) for c in allowed]))
    message = F.concat(F.lit("cannot set column "), F.array_join(unknown, ", "))
    failed = F.raise_error(message).cast("map<string,string>")
    return F.when(F.size(unknown) > 0, failed).otherwise(given)


def _inserted(base: DataFrame, rows: DataFrame, defaults: Mapping[str, Any], extra: Sequence[str] = ()) -> DataFrame:
    """Typed rows from ``set map<string,string>``.

    A column left out or blank takes its default; one mapped to NULL or the word ``null`` is an explicit NULL.
    """
    given = F.coalesce(F.col("set"), F.create_map().cast("map<string,string>"))
    checked = rows.withColumn("set", _checked_names(given, base.columns))
    typed = with_typed_texts(checked, [(F.col("set")[f.name], f) for f in base.schema.fields])
    columns = []
    for n, field in enumerate(base.schema.fields):
        default = defaults.get(field.name)
        fallback = default if isinstance(default, Column) else F.lit(default)
        left_out = _trimmed(n).isNull() & ~F.map_contains_key("set", field.name)
        columns.append(
            F.when(left_out | (_trimmed(n) == ""), fallback.cast(field.dataType))
            .otherwise(_typed(n))
            .alias(field.name)
        )
    return typed.select(*[F.col(e) for e in extra], *columns)


def apply_inserts(
    base: DataFrame,
    rows: DataFrame,
    defaults: Mapping[str, Any] | None = None,
    auto_number: str | None = None,
) -> DataFrame:
    """Append rows given as ``rows(seq, set map<string,string>)``; columns left out take their default.

    With ``auto_number``, rows that leave that integer column out are numbered on from the highest number in
    the table and the batch, in the order of ``seq`` (unique per row).
    """
    defaults = dict(defaults or {})
    if auto_number is None:
        return base.unionByName(_inserted(base, rows, defaults))
    if column_kind(base.schema[auto_number]) != INT64:
        raise TypeError(f"column {auto_number!r} is not an integer")

    own = trim_blanks(F.col("set")[auto_number]) != ""
    numbered_already = _inserted(base, rows.filter(F.coalesce(own, F.lit(False))), defaults)
    open_rows = number_rows(rows.filter(~F.coalesce(own, F.lit(False))), "seq")
    number = named(auto_number)
    taken = base.select(number).unionByName(numbered_already.select(number))
    highest = F.coalesce(taken.agg(F.max(number)).scalar(), F.lit(0))
    counted = _inserted(base, open_rows, defaults, extra=[NUMBER]).withColumn(
        auto_number, (highest + F.col(NUMBER)).cast(base.schema[auto_number].dataType)
    )
    return base.unionByName(numbered_already).unionByName(counted.drop(NUMBER))


def apply_changes(
    base: DataFrame, log: DataFrame, keys: Sequence[str], defaults: Mapping[str, Any] | None = None
) -> DataFrame:
    """Apply a mixed log ``(keys..., seq, op, set map<string,string>)`` in the order of ``seq``.

    Per key: a delete removes the table's rows and voids every earlier entry; an insert adds a row of
    defaults and its own values; an update reaches the rows that exist at its ``seq``, so the last write per
    column wins; an update of an absent key does nothing.  Two inserts of one key give two rows.  An update
    may not set a key column.  ``seq`` is unique per key.

    No row order is needed: the last delete and the last write per column are aggregates, and a row outlives
    them when it is older or newer than their ``seq``.
    """
    _require_keys(keys)
    settable = [c for c in base.columns if c not in keys]
    known_op = F.when(F.col("op").isin(INSERT, UPDATE, DELETE), F.col("op")).otherwise(
        F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("NULL")))).cast("string")
    )
    log = log.select(*[named(k) for k in keys], "seq", known_op.alias("op"), "set")
    is_update = F.col("op") == UPDATE
    checked = F.when(is_update, _checked_names(F.col("set"), settable))
    # Every write to a cell is an entry, and every delete one of no column.
    written = F.transform(F.map_entries(checked), lambda e: F.struct(e["key"].alias("column"), e["value"].alias("value")))
    nothing = F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"))
    entries = F.when(is_update, written).otherwise(F.array(nothing))
    writes = log.filter(F.col("op") != INSERT).select(*_renamed_keys(keys), "seq", F.inline(entries))
    state = _last_writes(writes, [_key_name(n) for n in range(len(keys))], [*settable, None])

    inserts = log.filter(F.col("op") == INSERT)
    others = F.map_filter(
        F.coalesce(F.col("set"), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*keys)
    )
    typed = _inserted(
        base,
        inserts.select(F.col("seq").alias("__seq"), *_renamed_keys(keys), others.alias("set")),
        {**(defaults or {}), **{k: F.col(_key_name(n)) for n, k in enumerate(keys)}},
        extra=["__seq"],
    )
    # A row of the table is older than every entry.
    rows = base.withColumn("__seq", F.lit(None).cast(typed.schema["__seq"].dataType)).unionByName(typed)
    met = rows.join(state, key_match(keys), "left")
    deleted = F.col(f"__write_{len(settable)}")["seq"]
    lives = deleted.isNull() | F.coalesce(F.col("__seq") > deleted, F.lit(False))
    return _merged(met.filter(lives), base, settable, since=F.col("__seq"))


def change_report(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows affected per op, for ``changes(keys..., op)`` met with the table as it is: ``(op, affected)``.

    An update entry affects every row with its key, a key is deleted once however often it is listed, an
    insert adds one row.  Both sides are counted per key before the join.
    """
    _require_keys(keys)
    names = [_key_name(n) for n in range(len(keys))]
    entries = changes.select(*_renamed_keys(keys), "op").groupBy(*names, "op").agg(F.count(F.lit(1)).alias("__entries"))
    held = base.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("__rows"))
    met = entries.join(held, key_match(keys), "left")
    rows = F.coalesce("__rows", F.lit(0))
    affected = (
        F.when(F.col("op") == INSERT, F.col("__entries"))
        .when(F.col("op") == DELETE, rows)
        .otherwise(F.col("__entries") * rows)
    )
    return met.groupBy("op").agg(F.sum(affected).alias("affected"))


def delete_cascade(
    tables: Mapping[str, DataFrame],
    edges: Sequence[Constraint],
    parent: str,
    keys_df: DataFrame,
    keys: Sequence[str],
) -> dict[str, DataFrame]:
    """Delete rows of ``parent`` by key, and all rows that reach them over foreign keys.

    Returns the surviving rows of every table reached.  A foreign key with a NULL reaches nothing.  Tables may refer to
    themselves and to each other in cycles; those of a cycle are followed together.  The keys deleted at each level
    are checkpointed: they are used for the survivors and for the next level, and each table is then joined with plain
    stored keys.
    """
    _require_keys(keys)
    doomed = keys_df.select(*_renamed_keys(keys)).distinct()
    kept = {parent: tables[parent].join(doomed, key_match(keys), "left_anti")}
    gone = {parent: tables[parent].join(doomed, key_match(keys), "left_semi")}
    stored: dict[tuple, DataFrame] = {}

    def deleted_keys(edge: Constraint) -> DataFrame:
        wanted = (edge.ref_table, edge.ref_columns)
        if wanted not in stored:
            stored[wanted] = checkpointed(_referenced(edge, gone[edge.ref_table]))
        return stored[wanted]

    for group in _cascade_order(edges, parent):
        for table in group:
            incoming = [e for e in edges if e.table == table and e.ref_table in gone and e.ref_table not in group]
            if incoming:
                hits = [(_refers(e), deleted_keys(e)) for e in incoming]
                kept[table], gone[table] = _cut(tables[table], hits)
            elif table != parent:
                kept[table], gone[table] = tables[table], tables[table].filter(F.lit(False))
        inner = [e for e in edges if e.table in group and e.ref_table in group]
        if len(group) == len(inner) == 1:
            reached = _reached_in_loop(inner[0], kept[group[0]], _referenced(inner[0], gone[group[0]]))
            hits = {group[0]: [(_refers(inner[0]), reached)]}
        else:
            hits = _reached_in_cycle(inner, kept, gone) if inner else {}
        for table, own in hits.items():
            kept[table], more = _cut(kept[table], own)
            gone[table] = gone[table].unionByName(more)
    return kept


def _cascade_order(edges: Sequence[Constraint], parent: str) -> list[list[str]]:
    """Groups of the tables reached from ``parent``, each after those it refers to; tables of a cycle share a group."""

    def below(table: str) -> set[str]:
        reached = {table}
        while grown := {e.table for e in edges if e.ref_table in reached} - reached:
            reached |= grown
        return reached

    reach = {table: below(table) for table in below(parent)}
    groups = {frozenset(t for t in reach[table] if table in reach[t]) for table in reach}
    # A group reaches all that the groups after it reach, and itself.
    return sorted((sorted(g) for g in groups), key=lambda g: (-len(reach[g[0]]), g))


def _referenced(edge: Constraint, gone: DataFrame) -> DataFrame:
    return gone.select(*[named(c).alias(_key_name(n)) for n, c in enumerate(edge.ref_columns)]).distinct()


def _refers(edge: Constraint) -> Column:
    return reduce(and_, [named(c) == F.col(_key_name(n)) for n, c in enumerate(edge.columns)])


def _cut(table: DataFrame, hits: Sequence[tuple[Column, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Split a table into rows that refer to none of the deleted keys and rows that do; each hit says how they refer."""
    kept, parts = table, []
    for refers, deleted in hits:
        parts.append(kept.join(deleted, refers, "left_semi"))
        kept = kept.join(deleted, refers, "left_anti")
    return kept, reduce(DataFrame.unionByName, parts)


def _reached_in_loop(edge: Constraint, rows: DataFrame, start: DataFrame) -> DataFrame:
    """All keys reached from ``start`` within a table that refers to itself."""
    names = [_key_name(n) for n in range(len(edge.columns))]
    above = [_above_name(n) for n in range(len(edge.columns))]
    own = [named(c).alias(k) for c, k in zip(edge.ref_columns, names, strict=True)]
    parent = [named(c).alias(k) for c, k in zip(edge.columns, above, strict=True)]
    return _reached(rows.select(*own, *parent), start, names, above, doubling=True)


def _reached_in_cycle(
    edges: Sequence[Constraint], kept: Mapping[str, DataFrame], gone: Mapping[str, DataFrame]
) -> dict[str, list[tuple[Column, DataFrame]]]:
    """What the rows of tables that refer to each other reach: for each table how it refers to keys, and which are reached.

    Every key that is referred to is named by its place among the referenced column lists and its values as text, so
    that one relation holds the keys of all tables, and one closure follows all edges.  A row leads from each key of
    its own to each key it refers to.  Values compare as the referenced columns' type.
    """
    slots = list(dict.fromkeys((e.ref_table, e.ref_columns) for e in edges))
    types = {slot: [kept[slot[0]].select(named(c)).schema[0].dataType for c in slot[1]] for slot in slots}

    def key_of(columns: Sequence[str], slot: tuple) -> Column:
        return _key_text(columns, types[slot])

    steps, starts = [], []
    for place, slot in enumerate(slots):
        own = [F.lit(place).alias(_key_name(0)), key_of(slot[1], slot).alias(_key_name(1))]
        starts.append(gone[slot[0]].select(*own))
        for e in edges:
            if e.table == slot[0]:
                ref = (e.ref_table, e.ref_columns)
                above = [F.lit(slots.index(ref)).alias(_above_name(0)), key_of(e.columns, ref).alias(_above_name(1))]
                steps.append(kept[slot[0]].select(*own, *above))
    step, start = reduce(DataFrame.unionByName, steps), reduce(DataFrame.unionByName, starts)
    # With one edge a table a row has one row above it, and steps stay as many as rows when they double.
    doubling = len({e.table for e in edges}) == len(edges)
    reached = _reached(step, start, [_key_name(n) for n in (0, 1)], [_above_name(n) for n in (0, 1)], doubling)
    hits: dict[str, list[tuple[Column, DataFrame]]] = {}
    for e in edges:
        slot = (e.ref_table, e.ref_columns)
        keys = reached.filter(F.col(_key_name(0)) == slots.index(slot)).select(_key_name(1))
        hits.setdefault(e.table, []).append((key_of(e.columns, slot) == F.col(_key_name(1)), keys))
    return hits


def _key_text(columns: Sequence[str], types: Sequence[T.DataType]) -> Column:
    """Key values as texts that are equal where the values are; null if one is null or none of its type."""
    texts, whole = [], F.lit(True)
    for column, kind in zip(columns, types, strict=True):
        value = named(column).try_cast(kind)
        whole = whole & F.coalesce(value == named(column), F.lit(False))
        if isinstance(kind, T.TimestampType):
            value = F.unix_micros(value)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0)  # A negative zero equals zero.
        texts.append(value.cast("string"))
    return F.when(whole, F.array(*texts))


def _above_name(n: int) -> str:
    return f"__above_{n}"


def _reached(step: DataFrame, start: DataFrame, names: list[str], above: list[str], doubling: bool) -> DataFrame:
    """All keys ``names`` that lead to one of ``start`` over rows of ``step``, each from a key to one ``above`` it.

    With ``doubling`` each round doubles the step: it knows the key so many rows above each row, and reaches every row
    for which that key is reached.  So rounds grow with the logarithm of the depth.  That suits keys with one key above
    them; where they have several, pairs of keys far apart could be many more than rows, and each round takes one step
    down from the keys of the last, with as many rounds as levels.  What each round needs is stored, so that planning
    it costs the same.  Once a round finds nothing there is nothing further down either.
    """
    step = step.dropna().distinct()
    reached = frontier = stored(start.dropna().distinct(), "reached")
    if not doubling:
        step = stored(step, "reach")
    while True:
        if doubling:
            step, frontier = stored(step, "reach"), reached
        upper = frontier.select(*[F.col(k).alias(a) for k, a in zip(names, above, strict=True)])
        found = stored(step.join(upper, above, "left_semi").select(*names).distinct(), "reached")
        more = found.join(reached, names, "left_anti")
        if more.isEmpty():
            return reached
        if not doubling:
            frontier = stored(more, "reached")
            reached = stored(reached.unionByName(frontier), "reached")
            continue
        reached = stored(reached.unionByName(more), "reached")
        # Rows that are reached need no further step of their own.
        open_rows = step.join(reached, names, "left_anti")
        via = step.select(
            *[F.col(k).alias(f"__via_{n}") for n, k in enumerate(names)],
            *[F.col(a).alias(f"__next_{n}") for n, a in enumerate(above)],
        )
        met = reduce(and_, [F.col(a) == F.col(f"__via_{n}") for n, a in enumerate(above)])
        step = open_rows.join(via, met).select(*names, *[F.col(f"__next_{n}").alias(a) for n, a in enumerate(above)]).distinct()
