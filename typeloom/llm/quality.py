"""Quality rules: repetition and length, and bands of n-gram perplexity for each language.

The perplexity is that of a modified Kneser-Ney model over folded characters, four at a time.  Spark counts the n-grams
of all texts, language by language; since characters fold to 40 symbols, a language has at most 40 ** 4 of them, however
large the corpus, and its model is a bounded table that may be sent to every task.  There it is a sorted array of
hashes, searched by bisection, beside arrays of probabilities and back-off weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from typeloom.llm.common import digest, pieces, scratch, slices, stored, text_of
from typeloom.llm.registry import load, query

ORDER, SYMBOLS = 4, 40
GRAMS = SYMBOLS**ORDER
#: Languages with a model of their own, those with most rows; the others share one.  Bands are always each language's.
MODELS = 16
SHARED = "(shared)"
#: A text fails with fewer words, or with a larger share of its words in repeated windows of eight, in percent.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: The bands reach so many interquartile distances below and above the quartiles; the distance counts as this at least.
#: Text that repeats itself or its marks is too easy to foretell, rows of a table or another language too hard; what is
#: quoted in a clean text raises its loss more often than anything lowers it.
REACH_LOW, REACH_HIGH, LEAST_SPREAD = 3.25, 4.75, 0.03
#: The bands of a language come from its texts of so many characters; shorter ones get wider bands.
BAND_CHARS = 400
#: Bytes of text that a task turns into Python objects at once.
SLICE_BYTES = 4_000_000

_BLANKS = " \t\n\r\x0b\x0c"
_MARKS = "#*$%&|<>"


def _fold_table() -> np.ndarray:
    """Symbols of the first code points: blank, letters in lower case, digit, punctuation, other ASCII, and ten more."""
    table = np.zeros(0x250, np.uint8)
    for point in range(len(table)):
        low = chr(point).lower()
        if chr(point) in _BLANKS:
            table[point] = 0
        elif low.isascii() and low.isalpha():
            table[point] = 1 + ord(low) - ord("a")
        elif point < 128:
            table[point] = 27 if chr(point).isdigit() else 28 if chr(point) in ".,;:!?'\"()-" else 29
        else:
            table[point] = 30 + ord(low[0]) % 10
    return table


_FOLD = _fold_table()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram code that ends at each character of the texts, one after another, and where each text ends.

    Before its first character a text has blanks.
    """
    pad = " " * (ORDER - 1)
    joined = pad + pad.join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], 30 + points % 10).astype(np.int32)
    codes = symbols[: len(symbols) - ORDER + 1].copy()
    for n in range(1, ORDER):
        codes *= SYMBOLS
        codes += symbols[n : len(symbols) - ORDER + 1 + n]
    ends = np.cumsum([len(t) for t in texts])
    keep = np.ones(len(codes), bool)
    for n, end in enumerate(ends[:-1]):
        at = end + n * (ORDER - 1)
        keep[at : at + ORDER - 1] = False
    return codes[keep], ends


def _groups(languages: list[str], models: frozenset[str]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for n, language in enumerate(languages):
        found.setdefault(language if language in models else SHARED, []).append(n)
    return found


def _count(models: frozenset[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, ["text"], SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            for model, rows in _groups(batch.column("lang").to_pylist(), models).items():
                own = [texts[n] for n in rows]
                total = totals.setdefault(model, np.zeros(GRAMS, np.int64))
                for start, end in pieces(own):
                    total += np.bincount(grams(own[start:end])[0], minlength=GRAMS)
        for model, total in totals.items():
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([model] * len(held), pa.string()), pa.array(held.astype(np.int32)), pa.array(total[held])],
                names=["model", "gram", "n"],
            )

    return count


def gram_hash(model: int | np.ndarray, order: int, codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-gram codes of one order in one model."""
    x = codes.astype(np.uint64) + np.uint64(order + 1) * np.uint64(1 << 32) + np.uint64(model) * np.uint64(1 << 36)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def kneser_ney(counts: np.ndarray, order: int = ORDER, symbols: int = SYMBOLS) -> list[tuple]:
    """For each order from 0: codes held, log probabilities given their history, log back-off weights as a history.

    ``counts`` has one axis per place of an n-gram.  Below the highest order an n-gram counts the symbols seen before
    it.  Each order has discounts for one, two and more; where they cannot be estimated, 1/2, 1 and 3/2.
    """
    levels = [counts.astype(float)]
    while len(levels) < order:
        levels.insert(0, (levels[0] > 0).sum(axis=0).astype(float))
    lower = np.full((), 1 / symbols)
    found: list[tuple] = [(np.zeros(1, np.int64), np.zeros(1), np.zeros(1))]
    for n, count in enumerate(levels, 1):
        of = [float((count == k).sum()) for k in range(1, 5)]
        if all(of):
            ratio = of[0] / (of[0] + 2 * of[1])
            discounts = [k + 1 - (k + 2) * ratio * of[k + 1] / of[k] for k in range(3)]
        if not all(of) or min(discounts) <= 0 or any(d > k + 1 for k, d in enumerate(discounts)):
            discounts = [0.5, 1.0, 1.5]
        seen = [(count == 1).sum(axis=-1), (count == 2).sum(axis=-1), (count >= 3).sum(axis=-1)]
        total = count.sum(axis=-1)
        safe = np.maximum(total, 1)
        weight = np.where(total > 0, sum(d * s for d, s in zip(discounts, seen, strict=True)) / safe, 1.0)
        taken = np.select([count >= 3, count == 2, count == 1], discounts[::-1], 0.0)
        chance = (count - taken) / safe[..., None] + weight[..., None] * lower
        # The weights belong to the histories: the n-grams of the order below.
        codes, logs, _ = found[-1]
        found[-1] = (codes, logs, np.log(weight.reshape(-1)[codes]))
        held = np.flatnonzero(count)
        found.append((held, np.log(chance.reshape(-1)[held]), np.zeros(len(held))))
        lower = chance
    return found


def _fit(numbers: dict[str, int]):
    def fit(counts: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros(GRAMS)
        dense[counts["gram"].to_numpy()] = counts["n"].to_numpy()
        number = numbers[counts["model"].iloc[0]]
        levels = kneser_ney(dense.reshape((SYMBOLS,) * ORDER))
        return pd.concat(
            pd.DataFrame({"hash": gram_hash(number, n, codes), "logp": logs, "back": backs})
            for n, (codes, logs, backs) in enumerate(levels)
        )

    return fit


class Model:
    """Sorted hashes with the log probability and back-off weight of each; ``numbers`` tells the models apart."""

    def __init__(self, hashes: np.ndarray, logp: np.ndarray, back: np.ndarray, numbers: dict[str, int]):
        order = np.argsort(hashes)
        self.hashes, self.logp, self.back, self.numbers = hashes[order], logp[order], back[order], numbers

    def _find(self, number: int, order: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = gram_hash(number, order, codes)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return at, self.hashes[at] == wanted

    def logs(self, number: int, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of the last symbol of each n-gram given the others."""
        if not order:
            return np.full(len(codes), -np.log(SYMBOLS))
        at, held = self._find(number, order, codes)
        out = np.where(held, self.logp[at], 0.0)
        missing = np.flatnonzero(~held)
        if len(missing):
            rest = codes[missing]
            at, held = self._find(number, order - 1, rest // SYMBOLS)
            back = np.where(held, self.back[at], 0.0)
            out[missing] = back + self.logs(number, rest % SYMBOLS ** (order - 1), order - 1)
        return out

    def total_logs(self, model: str, texts: list[str]) -> np.ndarray:
        """Log probability of each text."""
        codes, ends = grams(texts)
        if not len(codes):
            return np.zeros(len(texts))
        distinct = np.flatnonzero(np.bincount(codes, minlength=GRAMS))
        table = np.zeros(GRAMS)
        table[distinct] = self.logs(self.numbers[model], distinct)
        sums = np.concatenate([[0.0], np.cumsum(table[codes])])
        return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def train(documents: DataFrame, models: int = MODELS) -> Model:
    """Count the n-grams of all texts and fit a model for each of the ``models`` languages with most rows."""
    rows = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), text_of().alias("text"))
    largest = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(models).collect()
    names = frozenset(r["lang"] for r in largest) - {SHARED}
    numbers = {name: n for n, name in enumerate([SHARED, *sorted(names)])}
    counts = rows.mapInArrow(_count(names), "model string, gram int, n long")
    counts = counts.groupBy("model", "gram").agg(F.sum("n").alias("n"))
    fitted = counts.groupBy("model").applyInPandas(_fit(numbers), "hash long, logp double, back double")
    # At most ``models + 1`` times 40 ** 4 n-grams and their histories, whatever the corpus.
    held = stored(fitted, "ngram-model").toArrow()
    columns = [held.column(c).to_numpy() for c in ("hash", "logp", "back")]
    if not len(columns[0]):
        columns = [np.zeros(1, np.int64), np.zeros(1), np.zeros(1)]
    return Model(*columns, numbers)


def text_figures(text: str) -> tuple[int, int, int, int, int]:
    """Words, characters in words, marks, lines equal to an earlier one, and words in repeated windows of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in _BLANKS)
    marks = sum(text.count(c) for c in _MARKS)
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    repeated = 0
    if len(words) > WINDOW:
        hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        count = len(words) - WINDOW + 1
        windows = np.zeros(count, np.uint64)
        for n in range(WINDOW):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[n : n + count]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            twice = np.zeros(count, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, np.flatnonzero(twice), 1)
            np.add.at(steps, np.flatnonzero(twice) + WINDOW, -1)
            repeated = int((np.cumsum(steps)[:-1] > 0).sum())
    return len(words), chars, marks, len(lines) - len(set(lines)), repeated


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_OUT = pa.schema([("logs", pa.float64()), ("chars", pa.int64()), *((name, pa.int64()) for name in FIGURES)])


def score_texts(documents: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    """The columns ``kept``, ``_lang``, the figures of every text, its ``chars`` and its log probability ``logs``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = shared.value
        names = frozenset(own_model.numbers)
        for batch in slices(batches, ["_text"], SLICE_BYTES):
            texts = batch.column("_text").to_pylist()
            logs = np.zeros(len(texts))
            for name, rows in _groups(batch.column("_lang").to_pylist(), names).items():
                own = [texts[n] for n in rows]
                for start, end in pieces(own):
                    logs[rows[start:end]] = own_model.total_logs(name, own[start:end])
            figures = list(zip(*map(text_figures, texts), strict=True)) or [()] * len(FIGURES)
            columns = [logs, [len(t) for t in texts], *figures]
            made = [pa.array(c, t.type) for c, t in zip(columns, _OUT, strict=True)]
            first = batch.select([*batch.schema.names[:-1]])
            yield pa.RecordBatch.from_arrays([*first.columns, *made], names=[*first.schema.names, *_OUT.names])

    rows = documents.select(*kept, F.coalesce("lang", F.lit("")).alias("_lang"), text_of().alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    made = ["logs double", "chars long", *(f"{name} long" for name in FIGURES)]
    return rows.mapInArrow(score, ", ".join(fields + made))


def _base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(scored: DataFrame) -> DataFrame:
    """``_lang``, ``middle``, ``low`` and ``high`` of the mean log perplexity of each language.

    Quartiles come from a histogram in thousandths, so they do not depend on how the rows are dealt out.
    """
    loss = F.floor(-1000 * F.col("logs") / F.col("chars"))
    held = scored.filter(~_base_failed() & (F.col("chars") >= BAND_CHARS))
    held = held.groupBy("_lang", loss.alias("loss")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("_lang").orderBy("loss"))
    whole = F.sum("n").over(W.partitionBy("_lang"))
    held = held.select("_lang", (F.col("loss") / 1000).alias("loss"), (before / whole).alias("share"))
    quartile = lambda q: F.min(F.when(F.col("share") >= q, F.col("loss")))
    held = held.groupBy("_lang").agg(quartile(0.25).alias("first"), quartile(0.75).alias("third"))
    spread = F.greatest(F.col("third") - F.col("first"), F.lit(LEAST_SPREAD))
    return held.select(
        "_lang",
        ((F.col("first") + F.col("third")) / 2).alias("middle"),
        (F.col("first") - REACH_LOW * spread).alias("low"),
        (F.col("third") + REACH_HIGH * spread).alias("high"),
    )


def judge(scored: DataFrame) -> DataFrame:
    """``scored`` with ``perplexity``, ``base_failed`` and ``kept``.

    A text passes if the base rules pass it and its mean loss lies within the bands of its language.  Shorter texts than
    :data:`BAND_CHARS` vary more, so their distance to the band counts less, in proportion to the root of their length.
    A language without bands, and a text without characters, is judged by the base rules alone.
    """
    found = scored.join(bands(scored), "_lang", "left")
    loss = -F.col("logs") / F.greatest("chars", F.lit(1))
    wide = F.greatest(F.sqrt(F.lit(float(BAND_CHARS)) / F.greatest("chars", F.lit(1))), F.lit(1.0))
    off = loss - F.col("middle")
    within = off.between(wide * (F.col("low") - F.col("middle")), wide * (F.col("high") - F.col("middle")))
    within = F.coalesce(within, F.lit(True))
    found = found.withColumn("base_failed", _base_failed()).withColumn("perplexity", F.exp(loss))
    return found.withColumn("kept", ~F.col("base_failed") & within).drop("low", "middle", "high")


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the rules keep.

    A verdict is that of a language and a text, so it is stored with the digest of the text, and not with the row.
    """
    id = digest(text_of()).alias("id")
    named = documents.select(id, "lang", "text")
    with scratch(documents.sparkSession) as keep:
        scored = keep(score_texts(named, train(named), ["id"]), "quality-scores")
        good = stored(judge(scored).filter("kept").select("id", "_lang").distinct(), "quality-kept")
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    rows = documents.select(whole.alias("row"), id, F.coalesce("lang", F.lit("")).alias("_lang"))
    return rows.join(good, ["id", "_lang"], "left_semi").select("row.*")


@query("op3_quality_rules")
def op3_quality_rules(spark, sf):
    documents = load(spark, sf, "documents")
    scored = stored(score_texts(documents, train(documents), ["doc_id"]), "quality-scores")
    return judge(scored).select("doc_id", *FIGURES, "base_failed", "kept", "perplexity")
