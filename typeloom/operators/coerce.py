"""Coerce loosely typed columns and assign them to declared types, keeping rejects apart."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions import types as N
from typeloom.functions.cells import CELL, VALUE, Payload, coerce_cell, is_struct_of, not_null_word, parse_for_type
from typeloom.functions.lexical import named, trim_blanks

REJECTED, ERRORS = "rejected", "errors"
ERROR_TYPE = "array<struct<column:string,target:string,kind:string,text:string>>"


def coerce_cells(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Replace cell columns by values coerced toward their native types (``{column: native type text}``)."""
    kinds = {name: N.NativeType.parse(text).kind for name, text in types.items()}
    return df.withColumns({name: coerce_cell(named(name), kind) for name, kind in kinds.items()})


def parse_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Replace text columns by values read toward a column type name (``{column: type name}``)."""
    return df.withColumns({name: parse_for_type(named(name), text) for name, text in types.items()})


def _payload(df: DataFrame, name: str) -> Payload:
    """What a column holds: cells, values, or edited text."""
    dtype = df.schema[name].dataType
    if is_struct_of(dtype, VALUE):
        return Payload.of_value(named(name))
    if is_struct_of(dtype, CELL):
        return Payload.of_cell(named(name))
    if isinstance(dtype, T.StringType):
        return Payload(t=named(name))
    raise TypeError(f"column {name!r} holds {dtype.simpleString()}, not cells, values or text")


def _computed_once(flag: Column) -> Column:
    """``flag``, kept by the optimizer in the projection that makes it.

    It would otherwise move a later filter on the flag below that projection, with everything the flag is made
    of, and so parse every cell once more just to filter.
    """
    return flag & (F.spark_partition_id() >= 0)


def check_types(df: DataFrame, types: Mapping[str, str], epoch_unit: str | None = None) -> DataFrame:
    """Type every listed column; add ``rejected`` and ``errors``, one entry per cell that does not fit.

    The columns hold cells, values or edited text.  ``errors`` is NULL for a clean row.  Cells that do not fit
    are NULL in their typed column.  Filter rows before, not after: the check is a barrier to the optimizer.
    """
    taken = {REJECTED, ERRORS} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} would be given twice")
    time_type = df.sparkSession.conf.get("spark.sql.timeType.enabled", "false") == "true"
    targets = {name: N.NativeType.parse(text) for name, text in types.items()}
    typed_name = {name: f"__typed_{n}" for n, name in enumerate(targets)}

    texts = [name for name in targets if isinstance(df.schema[name].dataType, T.StringType)]
    trimmed = df.withColumns({name: trim_blanks(named(name)) for name in texts})
    trimmed = trimmed.withColumns({name: not_null_word(named(name)) for name in texts})
    held = {name: _payload(df, name) for name in targets}
    typed = trimmed.withColumns(
        {typed_name[name]: held[name].as_type(target, time_type, epoch_unit) for name, target in targets.items()}
    )

    def unfit(name: str) -> Column:
        return F.col(typed_name[name]).isNull() & held[name].given()

    def error(name: str) -> Column:
        entry = F.struct(
            F.lit(name).alias("column"),
            F.lit(types[name]).alias("target"),
            held[name].kind().alias("kind"),
            held[name].text().alias("text"),
        )
        return F.when(unfit(name), entry)

    rejected = _computed_once(reduce(or_, [unfit(name) for name in targets], F.lit(False)))
    found = F.array_compact(F.array(*[error(name) for name in targets])).cast(ERROR_TYPE)
    output = []
    for name in df.columns:
        if name not in targets:
            output.append(named(name))
            continue
        kind = targets[name].kind
        metadata = {N.KIND_KEY: kind} if kind in (N.UUID, N.TIME) else {}
        output.append(F.col(typed_name[name]).alias(name, metadata=metadata))
    return typed.select(*output, rejected.alias(REJECTED), F.when(rejected, found).alias(ERRORS))


def failing(checked: DataFrame) -> DataFrame:
    """The typed rows of :func:`check_types`; running them fails at the first bad row."""
    first = F.col(ERRORS)[0]
    message = F.concat(
        F.lit("column "), first["column"], F.lit(": not a "), first["target"], F.lit(": "), first["text"]
    )
    passed = F.when(~F.col(REJECTED), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return checked.filter(passed).drop(REJECTED, ERRORS)


def assign_types(
    df: DataFrame, types: Mapping[str, str], on_error: str = "reject", epoch_unit: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Type the listed columns; returns ``(good, rejects)``.

    ``reject`` keeps rows with errors apart, ``null`` keeps them in ``good`` with NULL cells (and lists them
    in ``rejects`` as well), ``fail`` stops the job at the first error.
    """
    checked = check_types(df, types, epoch_unit)
    rejects = checked.filter(REJECTED).drop(REJECTED)
    if on_error == "reject":
        return checked.filter(~F.col(REJECTED)).drop(REJECTED, ERRORS), rejects
    if on_error == "null":
        return checked.drop(REJECTED, ERRORS), rejects
    if on_error == "fail":
        return failing(checked), rejects
    raise ValueError(f"on_error must be reject, null or fail, not {on_error!r}")
