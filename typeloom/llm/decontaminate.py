"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of some words of a window; a mask says which places of the window count, and the others may hold any
word.  Seeds of benchmark items and of documents are joined; each hit fixes how the item lies on the document, and there
the words are compared one by one, so that an overlap is found although words in it were exchanged.

No overlap of enough worth is without a seed.  One of worth 12 with ``e`` exchanged words has ``12 + 3 * e`` words at
least; were two of every six next to each other exchanged, ``e`` would be too small, so six words with one exchanged at
most exist, and :data:`MASKS` hold the five others whichever it is.  In items of 6 to 14 words the share asks for five
words in a row or more, and in one of five words for four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import digest, stored, text_of
from typeloom.llm.registry import load, query

#: Places of a window that a seed holds: five of six words, of which one may be exchanged, and five in a row.
MASKS = ("11111", "101111", "110111", "111011", "111101")
SPAN = max(map(len, MASKS))
#: Items have so many words at least; those with just so many are sought by all but one of them in a row, too.
SHORT = 5
#: An overlap's worth is its equal words less two for each exchanged one; it must reach this, or this share of an item.
WORTH, PENALTY, SHARE = 12, 2, 0.75
#: Seeds of the benchmark that may be broadcast; with more of them the seeds are shuffled.
SENT_SEEDS = 500_000


def words_of(text: Column) -> Column:
    """Runs of letters, marks and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def _seeds(rows: DataFrame, keep: list[str], masks: tuple[str, ...] = MASKS) -> DataFrame:
    """``keep``, place and hash of every seed in ``words``; a row with too few words has none."""
    least = min(map(len, masks))
    full = rows.filter(F.size("words") >= least)
    full = full.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("at"))
    word = lambda n: F.get("words", F.col("at") + n)
    hashes = [
        F.when(
            F.col("at") + len(mask) <= F.size("words"),
            F.xxhash64(F.lit(mask), *(word(n) for n, place in enumerate(mask) if place == "1")),
        )
        for mask in masks
    ]
    return full.select(*keep, "at", F.explode(F.array(*hashes)).alias("seed")).filter(F.col("seed").isNotNull())


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: document, item, first word in the document, words, exchanged words, worth, and ``id`` of the
    document's id and text.

    One row for each way an item lies on a document.  A null text has no words.  Rows alike in id and text overlap
    alike, and each gets its rows; an item given twice counts once.  Items of fewer words than :data:`SHORT` are too
    short to be evidence.  Other columns are ignored.
    """
    items = benchmark.select("item_id", words_of(text_of()).alias("words"))
    items = items.filter(F.size("words") >= SHORT).distinct()
    items = stored(items.withColumn("item", F.xxhash64("item_id", "words")), "benchmark-items")
    rows = documents.select("doc_id", text_of().alias("text"), digest(F.col("doc_id"), text_of()).alias("id"))
    tokens = rows.select("id", words_of(F.col("text")).alias("words"))
    shortest = items.filter(F.size("words") == SHORT)
    four = ("1" * (SHORT - 1),)
    seeds = _seeds(items, ["item"]).unionByName(_seeds(shortest, ["item"], four))
    sought = _seeds(tokens, ["id"], MASKS if shortest.isEmpty() else MASKS + four)
    seeds = stored(seeds.withColumnRenamed("at", "item_at").distinct(), "benchmark-seeds")
    few = seeds.count() <= SENT_SEEDS
    hits = sought.join(F.broadcast(seeds) if few else seeds, "seed")
    hits = hits.select("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = stored(hits, "benchmark-hits")
    found = rows.join(hits, "id").select("doc_id", "id", words_of(F.col("text")).alias("words"), "item", "shift")
    found = found.join(items.select("item", "item_id", F.col("words").alias("wanted")), "item")
    first, last = "greatest(0, -shift)", "least(size(wanted), size(words) - shift) - 1"
    # The best run: it starts anew wherever what came before is worth nothing.
    best = F.expr(
        f"""aggregate(sequence({first}, {last}),
            named_struct('worth', 0, 'from', {first}, 'best', 0, 'start', 0, 'end', 0),
            (s, j) -> transform(array(s.worth + IF(get(words, j + shift) = get(wanted, j), 1, -{PENALTY})), w ->
                named_struct('worth', greatest(w, 0), 'from', IF(w <= 0, j + 1, s.from), 'best', greatest(w, s.best),
                    'start', IF(w > s.best, s.from, s.start), 'end', IF(w > s.best, j + 1, s.end)))[0])"""
    )
    found = found.withColumn("run", best)
    enough = F.least(F.lit(WORTH), F.ceil(F.size("wanted") * F.lit(SHARE)))
    length = F.col("run.end") - F.col("run.start")
    return found.filter(F.col("run.best") >= enough).select(
        "doc_id",
        "item_id",
        (F.col("run.start") + F.col("shift")).cast("long").alias("first_word"),
        length.cast("long").alias("n_words"),
        F.expr(f"(run.end - run.start - run.best) div {PENALTY + 1}").cast("long").alias("n_exchanged"),
        F.col("run.best").cast("long").alias("worth"),
        "id",
    )


def drop_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that overlap a benchmark item."""
    leaks = overlaps(documents, benchmark).select("id").distinct().withColumnRenamed("id", "leak")
    return documents.join(leaks, digest(F.col("doc_id"), text_of()) == F.col("leak"), "left_anti")


@query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark, sf):
    return overlaps(load(spark, sf, "documents"), load(spark, sf, "benchmark")).drop("id")
