"""Mixing sources to target weights by Pfair scheduling.

Each stream's texts are laid end to end and cut into blocks of equal size.  Block ``k`` of a stream that is to have
``p`` of every ``slots`` slots is released in slot ``k * slots // p`` and is due by slot ``ceil((k + 1) * slots / p)``;
in every slot the block with the earliest deadline among those released runs.  So each stream is always within one
block of its target.  The schedule repeats after ``slots`` slots: one round of it, of bounded size, gives the slot of
every block by arithmetic, and nothing is scheduled row by row.

Every source is a stream.  The largest ones stand in the round itself; all others stand together in one more place of
it, and a round of their own, made alike, says whose block each turn of that place is.  Where they are too many for one
round there are more levels, so that every round has a bounded number of streams however many sources there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from typeloom.llm.common import stored
from typeloom.llm.registry import load, query
from typeloom.operators.numbering import number_rows

#: Characters in a block.
BLOCK_CHARS = 100_000
#: Slots in a round: target weights are rounded to this many parts.
SLOTS = 1000
#: Sources that stand in the round itself, largest first; and streams in each round below it.
STREAMS = 200
#: The place that all other sources share; sources of their own are named with ``=`` before it.
REST, NO_SOURCE = "-", "(none)"
#: Parts of all weight that given weights are rounded to before they are rounded to slots.
WEIGHT_PARTS = 1_000_000_000
#: The columns that a schedule adds.
ADDED = ("mix_stream", "mix_block", "mix_slot", "mix_offset", "in_mix")


def _sized(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row as ``row``, with its source, size and place in the order of its source."""
    place = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    return documents.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"),
        F.coalesce("source", F.lit(NO_SOURCE)).alias("source"),
        F.md5(place).alias("place"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"),
    )


def _weighed(sizes: DataFrame, weights: DataFrame | None) -> DataFrame:
    """The size of every source that is mixed, and its weight as ``root``: given, or the square root of its size."""
    sizes = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        return sizes.withColumn("root", F.greatest(F.floor(F.sqrt("size")), F.lit(1)))
    given = weights.select(F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), F.col("weight").cast("double"))
    given = given.filter("weight > 0 AND weight < double('Infinity')")
    given = given.groupBy("source").agg(F.sum("weight").alias("weight"))
    given = stored(given.join(sizes, "source"), "mix-given")
    whole = given.agg(F.sum("weight")).collect()[0][0]
    share = F.floor(F.col("weight") / F.lit(whole) * WEIGHT_PARTS).cast("long")
    return given.select("source", "size", F.greatest(share, F.lit(1).cast("long")).alias("root"))


def _rounds(streams: DataFrame, slots: int) -> DataFrame:
    """One round of the schedule of each ``node``, which has fewer than ``slots`` rows: ``turns`` of each of its streams.

    Parts of the slots follow ``root``, one at least; what rounding leaves goes to the largest streams first.
    """
    every = W.partitionBy("node")
    whole = streams.withColumn("n", F.count("*").over(every)).withColumn("roots", F.sum("root").over(every))
    whole = whole.withColumn("low", F.expr(f"1 + root * ({slots} - n) div roots"))
    rank = F.row_number().over(every.orderBy(F.desc("size"), "stream")).cast("long")
    whole = whole.withColumn("rank", rank).withColumn("left", F.lit(slots) - F.sum("low").over(every))
    parts = F.col("low") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)
    one = whole.withColumn("parts", parts).groupBy("node")
    one = one.agg(F.sort_array(F.collect_list(F.struct("rank", "parts", "stream"))).alias("streams"))
    due = f"""filter(transform(streams, (s, i) -> named_struct(
        'due', ((done[i] + 1) * {slots} + s.parts - 1) div s.parts, 'i', i,
        'open', done[i] < s.parts AND done[i] * {slots} div s.parts <= t)), x -> x.open)"""
    step = f"""transform(array(array_min({due.replace("done", "state.done")}).i), pick -> named_struct(
        'done', transform(state.done, (k, i) -> IF(i = pick, k + 1L, k)),
        'picks', concat(state.picks, array(pick))))[0]"""
    picks = F.expr(
        f"""aggregate(sequence(0, {slots - 1}),
            named_struct('done', transform(streams, s -> 0L), 'picks', CAST(array() AS array<int>)),
            (state, t) -> {step}, state -> state.picks)"""
    )
    picked = one.select("node", "streams", F.posexplode(picks).alias("slot", "pick"))
    picked = picked.select("node", F.expr("streams[pick].stream").alias("stream"), F.col("slot").cast("long"))
    return picked.groupBy("node", "stream").agg(F.sort_array(F.collect_list("slot")).alias("turns"))


def _slot(block: str, slots: int) -> Column:
    """The slot of a stream's block, by its ``turns`` in a round."""
    return F.expr(f"{block} div size(turns) * {slots} + get(turns, CAST({block} % size(turns) AS INT))")


def _rest_blocks(rest: DataFrame, n: int, block_chars: int, slots: int, streams: int) -> DataFrame:
    """Where every block of the ``n`` sources that stand together lies among the blocks of the place they share.

    Each has one block more than its text fills: the one that is missing first.
    """
    fan = max(streams, 2)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block_chars).cast("long")))
    placed = rest.select("source", F.col("source").alias("at"), blocks.alias("block"))
    placed = placed.withColumn("place_block", F.col("block"))
    ranked = number_rows(rest.withColumn("less", -F.col("size")), ["less", "source"])
    level = ranked.select(F.col("source").alias("stream"), "size", "root", F.expr(f"(row_number - 1) div {fan}").alias("node"))
    while True:
        turns = stored(_rounds(level, slots), "mix-rounds")
        placed = placed.join(turns.withColumnRenamed("stream", "at"), "at")
        placed = placed.select("source", "block", F.col("node").cast("string").alias("at"), _slot("place_block", slots).alias("place_block"))
        n = -(-n // fan)
        if n == 1:
            return placed.select("source", "block", "place_block")
        level = level.groupBy("node").agg(F.sum("size").alias("size"), F.sum("root").alias("root"))
        level = level.select(F.col("node").cast("string").alias("stream"), "size", "root", F.expr(f"node div {fan}").alias("node"))


def mix(
    documents: DataFrame,
    keep: list[str] | None = None,
    block_chars: int = BLOCK_CHARS,
    slots: int = SLOTS,
    streams: int = STREAMS,
    weights: DataFrame | None = None,
) -> DataFrame:
    """The columns ``keep`` (all) with the block and slot that each row starts in, ``mix_offset`` characters into it.

    Reading rows by ``mix_slot`` and ``mix_offset`` gives the mix.  No row is dropped or repeated: ``in_mix`` holds up
    to the first slot whose source has run out, and later rows keep their slots in the same schedule.

    ``weights`` has a ``source`` and its ``weight``, of which only proportions count and several of a source add up;
    without it a source weighs the square root of its text.  Rows of a source without a positive weight have no slot,
    and are not in the mix.  Each of the ``streams`` largest sources is within one block of its target at every slot.
    The others share a place of the round, which is so itself, and each is within one block of its part of that place.

    A null source is a source of its own, a null text is empty, repeated rows are rows.  Columns of ``documents`` with
    the names of :data:`ADDED` are replaced.
    """
    if not 0 < streams < slots:
        raise ValueError("each stream needs a slot in the round")
    rows = _sized(documents, [c for c in keep or documents.columns if c not in ADDED])
    # One row per source and first digits of the place: what stands before each of them in its source.
    buckets = rows.groupBy("source", F.substring("place", 1, 3).alias("bucket")).agg(F.sum("size").alias("size"))
    buckets = stored(buckets, "mix-sizes")
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = buckets.select("source", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    rows = rows.withColumn("bucket", F.substring("place", 1, 3))
    rows = rows.select("row", "source", "bucket", "place", "size").join(before, ["source", "bucket"])
    within = W.partitionBy("source", "bucket").orderBy("place", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    rows = rows.withColumn("start", start).withColumn("block", F.expr(f"start div {block_chars}"))

    sources = stored(_weighed(buckets, weights), "mix-weights")
    own = stored(sources.orderBy(F.desc("size"), "source").limit(streams), "mix-streams")
    n_rest = max(sources.count() - streams, 0)
    # The block that a source lacks first.
    ends = sources.select("source", F.ceil(F.col("size") / block_chars).cast("long").alias("block"))
    level = own.select(F.concat(F.lit("="), F.col("source")).alias("stream"), "size", "root")
    stream, nth = F.concat(F.lit("="), F.col("source")), F.col("block")
    if n_rest:
        rest = sources.join(F.broadcast(own.select("source")), "source", "left_anti")
        shared = stored(_rest_blocks(rest, n_rest, block_chars, slots, streams), "mix-rest")
        whole = rest.agg(F.lit(REST).alias("stream"), F.sum("size").alias("size"), F.sum("root").alias("root"))
        level = level.unionByName(whole)
        rows, ends = (df.join(shared, ["source", "block"], "left") for df in (rows, ends))
        stream = F.when(F.col("place_block").isNotNull(), F.lit(REST)).otherwise(stream)
        nth = F.coalesce("place_block", "block")
    # One row for each stream of the round, ``streams`` and one at most.
    turns = F.broadcast(stored(_rounds(level.withColumn("node", F.lit(0)), slots).drop("node"), "mix-round"))
    rows, ends = (
        df.withColumn("stream", stream).withColumn("nth", nth).join(turns, "stream", "left").withColumn("slot", _slot("nth", slots))
        for df in (rows, ends)
    )
    last = ends.agg(F.min("slot")).collect()[0][0]
    return rows.select(
        "row.*",
        F.col("source").alias("mix_stream"),
        F.col("block").alias("mix_block"),
        F.col("slot").alias("mix_slot"),
        F.expr(f"start % {block_chars}").alias("mix_offset"),
        F.coalesce(F.col("slot") < F.lit(last or 0), F.lit(False)).alias("in_mix"),
    )


#: For up to :data:`STREAMS` sources, which have no rounds below the first.
ORACLE = f"""
WITH RECURSIVE
sized AS (
  SELECT doc_id, coalesce(source, '{NO_SOURCE}') AS source, coalesce(length(text), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')) AS place
  FROM documents),
streamed AS (SELECT *, source AS stream FROM sized),
whole AS (
  SELECT stream, CAST(sum(size) AS BIGINT) AS size, greatest(CAST(floor(sqrt(sum(size))) AS BIGINT), 1) AS root
  FROM streamed GROUP BY stream),
low AS (
  SELECT stream, size, 1 + root * ({SLOTS} - count(*) OVER ()) // CAST(sum(root) OVER () AS BIGINT) AS low,
         row_number() OVER (ORDER BY size DESC, stream) AS rank FROM whole),
weighed AS (
  SELECT stream, size, rank, CAST(low + CASE WHEN rank <= {SLOTS} - sum(low) OVER () THEN 1 ELSE 0 END AS BIGINT) AS parts
  FROM low),
listed AS (SELECT list(parts ORDER BY rank) AS parts FROM weighed),
runs(t, pick, done) AS (
  SELECT -1, CAST(0 AS BIGINT), list_transform(parts, lambda p: CAST(0 AS BIGINT)) FROM listed
  UNION ALL
  SELECT t + 1, pick, list_transform(done, lambda k, i: CASE WHEN i = pick THEN k + 1 ELSE k END)
  FROM (
    SELECT t, done, list_min(list_transform(parts, lambda p, i: CASE
        WHEN done[i] < p AND done[i] * {SLOTS} // p <= t + 1
        THEN ((done[i] + 1) * {SLOTS} + p - 1) // p * 1000 + i ELSE 1000000000000 END)) % 1000 AS pick
    FROM runs, listed WHERE t + 1 < {SLOTS}) AS step),
turns AS (
  SELECT stream, parts, t AS slot, row_number() OVER (PARTITION BY stream ORDER BY t) - 1 AS nth
  FROM runs JOIN weighed ON rank = pick WHERE t >= 0),
placed AS (
  SELECT doc_id, source, stream, CAST(coalesce(sum(size) OVER (
    PARTITION BY stream ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM streamed),
ends AS (
  SELECT min(size_blocks // parts * {SLOTS} + slot) AS last
  FROM (SELECT stream, CAST(ceil(size / {BLOCK_CHARS}) AS BIGINT) AS size_blocks FROM weighed) JOIN turns USING (stream)
  WHERE nth = size_blocks % parts)
SELECT doc_id, NULLIF(source, '{NO_SOURCE}') AS source, stream AS mix_stream, start // {BLOCK_CHARS} AS mix_block,
       start // {BLOCK_CHARS} // parts * {SLOTS} + slot AS mix_slot, start % {BLOCK_CHARS} AS mix_offset,
       start // {BLOCK_CHARS} // parts * {SLOTS} + slot < (SELECT last FROM ends) AS in_mix
FROM placed JOIN turns USING (stream) WHERE nth = start // {BLOCK_CHARS} % parts
"""


@query("op10_source_mixing", ORACLE)
def op10_source_mixing(spark, sf):
    return mix(load(spark, sf, "documents"), keep=["doc_id", "source"])
