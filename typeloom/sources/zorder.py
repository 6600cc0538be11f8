"""A file layout that serves lookups by any of several keys, as several indexes do.

A key's values are ranked by halving: the first bit of a rank says on which side of the median a value lies, the next on
which side of its half's median, and so on.  The bits of all keys, interleaved, are the place of a row in the layout; so
rows that lie close in it are close in every key, and a filter on any of them skips most row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.lexical import named

#: Rows from which the medians are estimated, and characters of a text key that they keep.  They decide where rows
#: lie and never which rows there are.
SAMPLE_ROWS, BOUND_CHARS = 20_000, 256
#: Halvings of each key: 256 ranges.
BITS = 8


def split_points(df: DataFrame, keys: Sequence[str], bits: int = BITS) -> list[list]:
    """For each key its values at the ``2 ** bits - 1`` inner cuts into equal parts, NULLs left out; empty without values.

    One pass over the keys alone.  The sample is of bounded size whatever the table has, and is sorted by Spark.
    """
    rows = df.select(
        *(
            (F.left(named(k), F.lit(BOUND_CHARS)) if isinstance(df.schema[k].dataType, T.StringType) else named(k)).alias(f"k{i}")
            for i, k in enumerate(keys)
        )
    )
    total = rows.count()
    if total > SAMPLE_ROWS:
        rows = rows.sample(SAMPLE_ROWS / total, seed=1)
    parts = 2**bits
    lists = rows.agg(*(F.array_sort(F.collect_list(f"k{i}")).alias(f"k{i}") for i in range(len(keys))))
    cuts = lists.select(
        *(
            F.expr(f"transform(sequence(1, {parts - 1}), n -> get(k{i}, CAST(n * size(k{i}) DIV {parts} AS INT)))").alias(f"k{i}")
            for i in range(len(keys))
        )
    ).first()
    return [[] if found[0] is None else found for found in cuts]


def rank(key: Column, points: list, bits: int, kind: T.DataType) -> Column:
    """How many of the inner cuts a value has reached, by halving; 0 for NULL and without cuts.

    One expression over one array of the cuts: a branch or a column for each halving would make code so long that the
    JVM never compiles it.
    """
    if not points:
        return F.lit(0)
    cuts = F.array(*(F.lit(p).cast(kind) for p in points))
    steps = F.array(*(F.lit(2**n) for n in reversed(range(bits))))

    def halved(reached: Column, step: Column) -> Column:
        return reached + F.when(F.coalesce(key >= F.get(cuts, reached + step - 1), F.lit(False)), step).otherwise(F.lit(0))

    return F.aggregate(steps, F.lit(0), halved)


def _interleaved(ranks: Sequence[Column], bits: int) -> Column:
    """The bits of all ranks, highest first and by turns."""
    place = F.lit(0).cast("long")
    for n, one in enumerate(ranks):
        for bit in range(bits):
            picked = F.shiftright(one, bit).bitwiseAND(F.lit(1)).cast("long")
            place = place.bitwiseOR(F.shiftleft(picked, bit * len(ranks) + len(ranks) - 1 - n))
    return place


def zordered_layout(df: DataFrame, keys: Sequence[str], files: int | None = None, bits: int = BITS) -> DataFrame:
    """Range-partition and sort by the interleaved ranks of ``keys``, and by the keys within equal ranks.

    NULL ranks lowest.  As in the sorted layout, the input partition is the last range column, so that many rows alike
    in all keys fill several files.  Keys must be of types that can be ordered and written as literals.
    """
    if not keys:
        raise ValueError("no key columns given")
    if not 0 < bits * len(keys) <= 63:
        raise ValueError("the ranks of all keys must fit into 63 bits")
    points = split_points(df, keys, bits)
    # The ranks are columns of their own, so that each is found once for all its bits.
    ranks = {f"__r{i}": rank(named(k), points[i], bits, df.schema[k].dataType) for i, k in enumerate(keys)}
    ranked = df.withColumns({"__slice": F.spark_partition_id(), **ranks})
    ranked = ranked.withColumn("__z", _interleaved([F.col(r) for r in ranks], bits)).drop(*ranks)
    by = [F.col("__z"), *(named(k) for k in keys)]
    salted = [*by, F.col("__slice")]
    ranged = ranked.repartitionByRange(files, *salted) if files else ranked.repartitionByRange(*salted)
    return ranged.sortWithinPartitions(*by).select(*(named(c) for c in df.columns))
