"""Toxicity scores by a factorization machine over hashed terms.

Besides a weight, each term has a vector, and each pair of terms in a text adds the product of their vectors: an insult
next to the mention of a group can count for more than the two by themselves.  The machine is fitted on a bounded
sample of labelled rows and scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import digest, stored, text_of
from typeloom.llm.registry import load, query

#: Labelled rows that the machine is fitted on: those first by a hash of their id.
SAMPLE_ROWS = 20_000
#: Terms that get parameters: those whose share differs most between the classes of the sample.
MODEL_TERMS = 2_000
#: Least standard deviations between the two shares of a term, and least texts of the sample that hold it.  Terms that
#: matter mostly in pairs differ little by themselves, so the bound is low.
LEAST_Z, LEAST_TEXTS = 2.0, 3
FACTORS, EPOCHS, RATE, DECAY = 8, 120, 0.05, 1e-5
#: Lengths of word beginnings that are terms; further ones stand for as many words, or more, that begin alike.
STEMS, ALIKE = range(3, 8), (2, 4)
#: Score from which a text is called toxic.
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W_]+")
_TERM_BITS = (1 << 28) - 1


def hashed_terms(text: str) -> set[int]:
    """Hashes of the distinct words of a text, in lower case, and of their beginnings.

    Languages that compound put an insult in front of other words, so a beginning is a term too, and another one if
    several words share it.
    """
    words = set(_WORD.findall(text.lower()))
    stems = Counter(word[:n] for word in words for n in STEMS if len(word) > n)
    terms = [*words, *(stem + "*" for stem in stems)]
    for least in ALIKE:
        terms += [f"{stem}*{least}" for stem, count in stems.items() if count >= least]
    return {zlib.crc32(term.encode()) & _TERM_BITS for term in terms}


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(hashed_terms(text.as_py())) for text in batch.column("text")]
        kept = [batch.column(n) for n in ("doc_id", "toxic", "pick")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(terms, pa.list_(pa.int32()))], names=["doc_id", "toxic", "pick", "terms"]
        )


class Machine:
    """Parameters of a fitted machine: ``terms`` sorted, a weight and a vector for each, and a constant."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, vectors: np.ndarray, constant: float):
        self.terms, self.weights, self.vectors, self.constant = terms, weights, vectors, constant
        self._place = {int(t): n for n, t in enumerate(terms)}

    def score(self, text: str) -> float:
        places = sorted(self._place[t] for t in hashed_terms(text) if t in self._place)
        vectors = self.vectors[places]
        pairs = 0.5 * float((vectors.sum(axis=0) ** 2).sum() - (vectors**2).sum())
        return float(1 / (1 + np.exp(-np.clip(self.constant + float(self.weights[places].sum()) + pairs, -60, 60))))


def fit(terms: np.ndarray, rows: list[tuple[list[int], int]]) -> Machine:
    """Fit by full-batch Adam on the logistic loss; the same rows give the same machine.

    Rows of a single class, or none, give a machine that scores every text with their smoothed share.
    """
    toxic = np.array([y for _, y in rows], dtype=float)
    share = (toxic.sum() + 0.5) / (len(rows) + 1 if rows else 2)
    constant = float(np.log(share / (1 - share)))
    terms = np.sort(np.asarray(terms, dtype=np.int64))
    if not rows or toxic.min() == toxic.max() or not len(terms):
        return Machine(terms[:0], np.zeros(0), np.zeros((0, FACTORS)), constant)
    place = {int(t): n for n, t in enumerate(terms)}
    held = [[place[t] for t in of if t in place] for of, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(h) for h in held])
    column = np.array([n for h in held for n in h], dtype=np.int64)
    order = np.argsort(column, kind="stable")
    present, starts = np.unique(column[order], return_index=True)

    def by_row(values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(row, values[:, f], len(rows)) for f in range(values.shape[1])], axis=1)

    def by_term(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(terms), values.shape[1]))
        out[present] = np.add.reduceat(values[order], starts, axis=0)
        return out

    size = len(terms)
    theta = np.concatenate([[constant], np.zeros(size), 0.01 * np.random.default_rng(0).standard_normal(size * FACTORS)])
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        weights, vectors = theta[1 : size + 1], theta[size + 1 :].reshape(size, FACTORS)
        own = vectors[column]
        sums = by_row(own)
        logit = theta[0] + np.bincount(row, weights[column], len(rows))
        logit = logit + 0.5 * ((sums**2).sum(axis=1) - np.bincount(row, (own**2).sum(axis=1), len(rows)))
        error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - toxic) / len(rows)
        pull = error[row][:, None]
        gradient = np.concatenate(
            [[error.sum()], by_term(pull)[:, 0], by_term(pull * (sums[row] - own)).ravel()]
        )
        gradient[1:] += DECAY * theta[1:]
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.999 * spread + 0.001 * gradient**2
        theta = theta - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, theta[1 : size + 1], theta[size + 1 :].reshape(size, FACTORS), float(theta[0]))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit a machine on the first ``sample_rows`` labelled ids by hash.

    Rows without an id or label are left out; an id labelled twice counts as toxic if either says so, and of several
    texts of one id the first by digest is taken.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id")
    ids = ids.agg((F.max(label) > 0).cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = documents.select("doc_id", text_of().alias("text"), digest(F.col("text")).alias("pick"))
    # The sample is bounded by ``sample_rows``, so it may be broadcast.
    texts = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic", "pick")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(_terms, f"doc_id {id_type}, toxic int, pick binary, terms array<int>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("pick", "toxic", "terms")).alias("row")).select("row.*")
    rows = stored(rows, "toxic-sample")
    of = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, other = of.get(1, 0), of.get(0, 0)
    if not toxic or not other:
        return fit(np.zeros(0), [([], y) for y, n in of.items() for _ in range(n)])
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term")
    counts = counts.agg(F.sum("toxic").alias("hit"), F.count("*").alias("held")).filter(F.col("held") >= LEAST_TEXTS)
    share = F.col("held") / F.lit(float(toxic + other))
    gap = F.col("hit") / F.lit(float(toxic)) - (F.col("held") - F.col("hit")) / F.lit(float(other))
    z = F.abs(gap) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * F.lit(1 / toxic + 1 / other))
    chosen = counts.withColumn("z", z).filter(F.col("z") >= LEAST_Z)
    chosen = chosen.orderBy(F.desc("z"), "term").limit(MODEL_TERMS).select("term")
    terms = sorted(r["term"] for r in chosen.collect())
    model = F.lit(terms).cast("array<int>") if terms else F.array().cast("array<int>")
    kept = rows.select("pick", F.array_intersect("terms", model).alias("terms"), "toxic").orderBy("pick", "toxic")
    return fit(np.array(terms), [(sorted(r["terms"]), r["toxic"]) for r in kept.collect()])


def score_texts(documents: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id`` and ``score`` of every row; a null text is empty, other columns are ignored."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = pa.array([model.score(text.as_py()) for text in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_of().alias("text")).mapInArrow(score, f"doc_id {id_type}, score double")


def held_out():
    """Whether an id is kept from training: its checksum modulo 3 is 1.  A missing id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op8_toxicity")
def op8_toxicity(spark, sf):
    documents = load(spark, sf, "documents")
    machine = train(documents, load(spark, sf, "labels").filter(~held_out()))
    return score_texts(documents, machine).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
