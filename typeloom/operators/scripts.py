"""SQL scripts: splitting tables of them into statements, and running statement lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.lexical import BLANKS, named

# What may hold a semicolon that does not end a statement: quoted text and both comment forms, each running to
# the end of the script when it is not closed.  Then the semicolon itself.
_TOKEN = re.compile(
    r"""'[^']*(?:'|\Z) | "[^"]*(?:"|\Z) | --[^\n]*(?:\n|\Z) | /\*(?:.*?\*/|.*\Z) | (?P<end>;)""",
    re.VERBOSE | re.DOTALL,
)


def split_text(script: str) -> list[str]:
    """The statements of one script, trimmed, blank ones dropped."""
    pieces, start = [], 0
    for token in _TOKEN.finditer(script):
        if token["end"]:
            pieces.append(script[start : token.start()])
            start = token.end()
    pieces.append(script[start:])
    return [piece for piece in (p.strip(BLANKS) for p in pieces) if piece]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _split(scripts: pa.Array) -> pa.Array:
    pieces = [None if script is None else split_text(script) for script in scripts.to_pylist()]
    return pa.array(pieces, pa.list_(pa.string()))


def split_scripts(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Every statement of every script: ``(id, n, statement)``, ``n`` from 1 within a script."""
    return df.select(named(id_column), F.posexplode(_split(named(text)))).select(
        named(id_column), (F.col("pos") + 1).alias("n"), F.col("col").alias("statement")
    )


def run_statements(spark: SparkSession, statements: Sequence[str]) -> list[DataFrame]:
    """One lazy result per statement; the first statement that fails stops the list."""
    return [spark.sql(statement) for statement in statements]


def run_script(spark: SparkSession, script: str) -> list[DataFrame]:
    """As :func:`run_statements` for the statements of a script."""
    return run_statements(spark, split_text(script))
