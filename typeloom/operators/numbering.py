"""Dense row numbers without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeloom.functions.lexical import named
from typeloom.session import stored

NUMBER = "row_number"
_WITHIN = (1 << 33) - 1


def number_rows(df: DataFrame, order_by: str | Sequence[str]) -> DataFrame:
    """Add ``row_number``, dense from 1 in the order of the given columns; rows that are equal in them may change places.

    Spark cuts the rows into sorted ranges, which are written; each row is numbered within its range by its place
    there, and shifted by the counts of the ranges before.  Nothing passes through the driver, and a task run again
    reads the same ranges.
    """
    order = [named(c) for c in ([order_by] if isinstance(order_by, str) else order_by)]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the range in its upper bits and the place in it below.
    ranged = stored(ranged.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    ranged = ranged.withColumn("__range", F.shiftright("__id", 33))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    # One row for each range, so a window over all of them is small, and so is what the join sends.
    earlier = Window.partitionBy(F.lit(1)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    number = F.col("__start") + F.col("__id").bitwiseAND(F.lit(_WITHIN)) + 1
    numbered = ranged.join(starts, "__range").withColumn(NUMBER, number.cast("bigint"))
    return numbered.drop("__id", "__range", "__start")
