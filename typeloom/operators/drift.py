"""How the tables of two catalogs differ."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeloom.functions.lexical import named
from typeloom.operators.catalog import columns_of

#: Values of a column that stand for it, and the share of them that a renamed column has in common with its old self.
SKETCH, ALIKE = 256, 0.9


def value_sketch(df: DataFrame, columns: Sequence[str], size: int = SKETCH) -> DataFrame:
    """The ``size`` least hashes of each column's distinct values: ``(column, value)``; NULLs count for nothing.

    Distinct hashes are found by one aggregation for all columns; each task then keeps a column's least ones before
    they are brought together, so no task sees more than ``size`` from every other.
    """
    hashes = [
        F.struct(F.lit(c).alias("column"), F.when(named(c).isNotNull(), F.xxhash64(named(c))).alias("value")) for c in columns
    ]
    values = df.select(F.inline(F.array(*hashes))).filter(F.col("value").isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return values.withColumn("place", place).filter(F.col("place") <= size).select("column", "value")


def proposed_renames(table: str, old: DataFrame, new: DataFrame, alike: float = ALIKE) -> DataFrame | None:
    """Columns that went and columns that came with the same type and values: ``(table, old_column, new_column)``.

    Each is the other's most alike one.  None if no column can have been renamed.
    """
    gone = [f for f in old.schema.fields if f.name not in new.columns]
    come = [f for f in new.schema.fields if f.name not in old.columns]
    hashable = lambda f: not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))
    kinds = {f.dataType for f in gone if hashable(f)} & {f.dataType for f in come if hashable(f)}
    gone, come = ([f for f in side if f.dataType in kinds] for side in (gone, come))
    if not kinds:
        return None
    pairs = [(a.name, b.name) for a in gone for b in come if a.dataType == b.dataType]
    allowed = old.sparkSession.createDataFrame(pairs, "old_column string, new_column string")
    left = value_sketch(old, [f.name for f in gone]).withColumnRenamed("column", "old_column")
    right = value_sketch(new, [f.name for f in come]).withColumnRenamed("column", "new_column")
    left_size = left.groupBy("old_column").agg(F.count("*").alias("left_size"))
    right_size = right.groupBy("new_column").agg(F.count("*").alias("right_size"))
    # Sketches are of bounded size, and so are the windows over pairs of columns.
    common = left.join(right, "value").groupBy("old_column", "new_column").agg(F.count("*").alias("common"))
    common = common.join(allowed, ["old_column", "new_column"]).join(left_size, "old_column").join(right_size, "new_column")
    common = common.withColumn("share", F.col("common") / F.greatest("left_size", "right_size")).filter(F.col("share") >= alike)
    for mine, other in (("old_column", "new_column"), ("new_column", "old_column")):
        best = F.row_number().over(Window.partitionBy(mine).orderBy(F.desc("share"), other))
        common = common.withColumn(f"best_{mine}", best)
    mutual = common.filter((F.col("best_old_column") == 1) & (F.col("best_new_column") == 1))
    return mutual.select(F.lit(table).alias("table"), "old_column", "new_column")


def catalog_drift(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], alike: float = ALIKE) -> DataFrame:
    """Every difference of two catalogs: ``(table, column, change, before, after)``.

    Changes are ``added``, ``dropped`` and ``renamed`` columns, ``retyped`` and ``moved`` ones; a column has moved if its
    place among the columns that both tables have is another.  A table that only one catalog has is all added or all
    dropped columns.  ``before`` and ``after`` are the types, the places from 1, or the names.
    """
    if not old and not new:
        raise ValueError("no tables given")
    spark = next(iter([*old.values(), *new.values()])).sparkSession
    sides = [
        columns_of(spark, tables).select("table", "column", F.col("ordinal").alias(f"{side}_place"), F.col("type").alias(f"{side}_type"))
        for side, tables in (("old", old), ("new", new))
    ]
    both = sides[0].join(sides[1], ["table", "column"], "full")
    kept = F.col("old_place").isNotNull() & F.col("new_place").isNotNull()
    both = both.withColumn("kept", kept)
    for side in ("old", "new"):
        # A table's columns at most.
        both = both.withColumn(f"{side}_rank", F.row_number().over(Window.partitionBy("table", "kept").orderBy(f"{side}_place")))

    def change(name, when, before, after):
        return F.when(when, F.struct(F.lit(name).alias("change"), before.alias("before"), after.alias("after")))

    none = F.lit(None).cast("string")
    old_rank, new_rank = F.col("old_rank").cast("string"), F.col("new_rank").cast("string")
    entries = F.array(
        change("added", F.col("old_place").isNull(), none, F.col("new_type")),
        change("dropped", F.col("new_place").isNull(), F.col("old_type"), none),
        change("retyped", F.col("kept") & (F.col("old_type") != F.col("new_type")), F.col("old_type"), F.col("new_type")),
        change("moved", F.col("kept") & (F.col("old_rank") != F.col("new_rank")), old_rank, new_rank),
    )
    found = both.select("table", "column", F.inline(F.array_compact(entries)))
    for table in old.keys() & new.keys():
        renames = proposed_renames(table, old[table], new[table], alike)
        if renames is None:
            continue
        gone = renames.select("table", F.col("old_column").alias("column"), F.lit("dropped").alias("change"))
        come = renames.select("table", F.col("new_column").alias("column"), F.lit("added").alias("change"))
        found = found.join(gone.unionByName(come), ["table", "column", "change"], "left_anti")
        named_so = renames.select(
            "table", F.col("old_column").alias("column"), F.lit("renamed").alias("change"),
            F.col("old_column").alias("before"), F.col("new_column").alias("after"),
        )
        found = found.select("table", "column", "change", "before", "after").unionByName(named_so)
    return found.select("table", "column", "change", "before", "after")
