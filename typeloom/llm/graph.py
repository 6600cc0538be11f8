"""Connected components of links that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import scratch, stored


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``comp``, the least id it is linked to by any chain of the links ``a``, ``b``; only linked ids occur.

    Alternates large and small stars: each round links the larger, then the smaller, neighbours of an id to the least
    one, so the rounds grow with the logarithm of the longest chain.  Each round is written, and read by the next.  Least
    neighbours are written before their joins too: those are then joins of plain tables, in which Spark can split the rows
    of a large star.  Only the last round's links stay.
    """
    ordered = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    spark, before = links.sparkSession, None
    with scratch(spark) as held:
        links = held(ordered.distinct(), "links")
        while True:
            with scratch(spark) as keep:
                both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
                least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
                least = keep(least, "least")
                large = both.join(least, "u").filter(F.col("v") > F.col("u"))
                large = keep(large.select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
                least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
                small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                small = small.filter(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v")))
                links = held(small.distinct(), "links")
            state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
            if state == before:
                break
            before = state
        links = stored(links, "links")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)
