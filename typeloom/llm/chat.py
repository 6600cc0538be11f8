"""Chat formatting from the view of every participant.

For each participant a dialogue is rendered with that speaker as the assistant, all others as named users and the
system as itself.  The mask lists the characters a model should learn from: what the assistant says, with its end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from typeloom.llm.registry import load, query

#: Turns in a piece.  A longer dialogue comes in several rows, in order, so that no row grows without bound.
PIECE_TURNS = 1024
SYSTEM, NOBODY = "system", "nobody"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _piece(turns: Column, viewer: Column) -> Column:
    """The rendered turns and, for each, the characters before its body and in its body with the end mark."""

    def render(turn: Column) -> Column:
        speaker = turn["speaker"]
        head = F.when(speaker == viewer, F.lit("assistant")).when(speaker == SYSTEM, F.lit(SYSTEM))
        head = head.otherwise(F.concat(F.lit("user name="), F.regexp_replace(speaker, r"[\s<|>]", "_")))
        return F.struct(
            F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"),
            F.concat(turn["body"], F.lit(CLOSE)).alias("body"),
            (speaker == viewer).alias("learn"),
        )

    return F.transform(turns, render)


def rotate(turns: DataFrame, speaker: str = "role", piece_turns: int = PIECE_TURNS) -> DataFrame:
    """One row per conversation, participant and piece of the dialogue; all but very long dialogues are one piece.

    ``start`` is where the piece starts in the dialogue, and ``mask`` the learnt spans ``start:end`` in code points of
    the whole dialogue.  Turns go by ``turn``, a null last, and ties by speaker and text; repeated rows are turns.  A
    null speaker is called ``nobody``, a null text is empty, and a conversation without an id is one too.  One in which
    only the system speaks has no participant and no row.  ``<|`` in a text becomes ``< |``, so no text can pose as a
    mark; names have blanks and marks replaced.  Other columns are ignored.
    """
    rows = turns.select(
        F.struct("conv_id").alias("conv"),
        F.col("turn"),
        F.coalesce(F.col(f"`{speaker}`").cast("string"), F.lit(NOBODY)).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    )
    people = rows.filter(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("viewer")).distinct()
    # Places are found within ranges of ``turn``, so a long conversation spreads over many tasks.
    span = F.coalesce(F.floor(F.col("turn") / piece_turns), F.lit(2**62))
    rows = rows.withColumn("span", span)
    ahead = F.sum("n").over(W.partitionBy("conv").orderBy("span").rowsBetween(W.unboundedPreceding, -1))
    spans = rows.groupBy("conv", "span").agg(F.count("*").alias("n"))
    spans = spans.select("conv", "span", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    order = W.partitionBy("conv", "span").orderBy(F.col("turn").asc_nulls_last(), "speaker", "body")
    rows = rows.join(spans, ["conv", "span"]).withColumn("place", F.col("ahead") + F.row_number().over(order) - 1)
    part = F.floor(F.col("place") / piece_turns).alias("piece")
    parts = rows.groupBy("conv", part).agg(
        F.sort_array(F.collect_list(F.struct("place", "speaker", "body"))).alias("turns")
    )
    seen = parts.join(people, "conv")
    seen = seen.withColumn("said", _piece(F.col("turns"), F.col("viewer"))).drop("turns")
    whole = F.transform("said", lambda x: F.concat(x["head"], x["body"], F.lit("\n")))
    seen = seen.withColumn("dialogue", F.array_join(whole, ""))
    order = W.partitionBy("conv", "viewer").orderBy("piece")
    ahead = F.sum(F.char_length("dialogue").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1))
    seen = seen.withColumn("start", F.coalesce(ahead, F.lit(0)))
    spans = F.expr(
        """aggregate(said, named_struct('at', start, 'spans', CAST(array() AS array<string>)), (state, x) -> named_struct(
            'at', state.at + char_length(x.head) + char_length(x.body) + 1,
            'spans', IF(x.learn, concat(state.spans, array(concat(
                CAST(state.at + char_length(x.head) AS string), ':',
                CAST(state.at + char_length(x.head) + char_length(x.body) AS string)))), state.spans)),
            state -> array_join(state.spans, ','))"""
    )
    return seen.select(
        F.col("conv.conv_id").alias("conv_id"),
        F.col("viewer").alias("participant"),
        "piece",
        "start",
        F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", lambda x: x["learn"])).cast("long").alias("n_learnt"),
        "dialogue",
        spans.alias("mask"),
    )


ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '{NOBODY}') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations),
people AS (SELECT DISTINCT conv_id AS of_conv, speaker AS viewer FROM said WHERE speaker <> '{SYSTEM}'),
seen AS (
  SELECT conv_id, viewer, turn, speaker, body, speaker = viewer AS learn, '{OPEN}' || CASE WHEN speaker = viewer
    THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}'
    ELSE 'user name=' || regexp_replace(speaker, '[\\s<|>]', '_', 'g') END || chr(10) AS head
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM of_conv),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, viewer ORDER BY turn NULLS LAST, speaker, body) AS n,
    coalesce(sum(length(head) + length(body) + length('{CLOSE}') + 1) OVER (
      PARTITION BY conv_id, viewer ORDER BY turn NULLS LAST, speaker, body
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a
  FROM seen)
SELECT conv_id, viewer AS participant, CAST(0 AS BIGINT) AS piece, CAST(0 AS BIGINT) AS start, count(*) AS n_turns,
       count(*) FILTER (WHERE learn) AS n_learnt, string_agg(head || body || '{CLOSE}' || chr(10), '' ORDER BY n) AS dialogue,
       string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a AS BIGINT) + length(body) + length('{CLOSE}') AS VARCHAR), ','
         ORDER BY n) FILTER (WHERE learn) AS mask
FROM placed GROUP BY conv_id, viewer
"""


@query("op6_chat_rotation", ORACLE)
def op6_chat_rotation(spark, sf):
    return rotate(load(spark, sf, "conversations"))
