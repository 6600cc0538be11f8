"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with how often it occurred before.  A sketch takes the
few labelled shingles that are least under a hash function, in their text order; so two texts share a sketch with a
chance that falls with the edits between them, also with edits that only change the order.  Texts with a common sketch
are candidates.  A candidate pair is a link if an alignment of the two sequences within a band matches
:data:`LEAST` of all their labelled shingles.  Classes are the components of the links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import PIECE_CHARS, digest, pieces, scratch, slices, text_of
from typeloom.llm.graph import components
from typeloom.llm.registry import load, query

WORDS = 5
#: Similarity of a link: aligned labelled shingles over all of both.
LEAST = 0.8
#: Sketches of a text, and shingles in a sketch.  At similarity 0.8 a pair shares none with a chance of 1 in 100,000.
SKETCHES, TAKEN = 16, 3
#: Share of the longer sequence by which two aligned places may differ.
BAND = 0.2

_ODD = np.random.default_rng(5).integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.uint64(2**64 - 1)


class _WordHashes(dict):
    """Hashes of the words seen; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def labelled_shingles(texts: list[str], words: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of the texts, one text after another, and how many each has.

    A text of one to four words has one shingle, one without words none.
    """
    words = _WordHashes() if words is None else words
    split = [[words[w] for w in text.lower().split()] for text in texts]
    counts = np.array([max(len(s) - WORDS + 1, min(len(s), 1)) for s in split], np.int64)
    flat = []
    for s in split:
        if s:
            flat += s + [1] * (WORDS - len(s))
    hashes = np.array(flat, np.uint64)
    lengths = np.array([max(len(s), WORDS) if s else 0 for s in split], np.int64)
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    whole = np.zeros(len(hashes) - WORDS + 1, np.uint64)
    for n in range(WORDS):
        whole = whole * _MIX + hashes[n : n + len(whole)]
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    shingles = _mixed(whole[first[owner] + within])
    # How often the same shingle came before in the same text: its place in a run of equal keys, in order of place.
    keys = shingles ^ _mixed(owner.astype(np.uint64) * _MIX)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    at = np.arange(len(order))
    run = at - np.maximum.accumulate(np.where(new, at, 0))
    label = np.empty(len(order), np.uint64)
    label[order] = run.astype(np.uint64)
    return _mixed(shingles + label * _MIX), counts


def sketches(labelled: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of sketch keys for each text that has shingles."""
    counts = counts[counts > 0]
    if not len(counts):
        return np.zeros((0, SKETCHES), np.uint64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    keys = np.empty((len(counts), SKETCHES), np.uint64)
    for n, odd in enumerate(_ODD):
        values = labelled * odd
        values ^= values >> np.uint64(32)
        taken = np.empty((len(counts), TAKEN), np.int64)
        for k in range(TAKEN):
            least = np.minimum.reduceat(values, starts)
            at = np.flatnonzero(values == np.repeat(least, counts))
            # The first place of each text that holds its least value.
            at = at[np.searchsorted(at, starts)]
            taken[:, k] = np.where(least == _FAR, np.iinfo(np.int64).max, at)
            values[at] = _FAR
        taken.sort(axis=1)
        held = taken < len(labelled)
        parts = np.where(held, labelled[np.where(held, taken, 0)], np.uint64(0))
        key = np.full(len(counts), n + 1, np.uint64)
        for k in range(TAKEN):
            key = _mixed(key * _MIX + parts[:, k])
        keys[:, n] = key
    return keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _WordHashes()
    for batch in slices(batches, ["text"], PIECE_CHARS):
        ids, texts = batch.column("id"), batch.column("text").to_pylist()
        for start, end in pieces(texts):
            labelled, counts = labelled_shingles(texts[start:end], words)
            held = np.flatnonzero(counts)
            keys = sketches(labelled, counts).view(np.int64)
            offsets = pa.array(np.arange(0, len(held) * SKETCHES + 1, SKETCHES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, end - start).take(pa.array(held)),
                    pa.array(counts[held]),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))),
                ],
                names=["id", "n", "keys"],
            )


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _WordHashes()
    for batch in slices(batches, ["text"], PIECE_CHARS):
        texts = batch.column("text").to_pylist()
        for start, end in pieces(texts):
            labelled, counts = labelled_shingles(texts[start:end], words)
            ends = np.cumsum(counts)
            parts = [labelled[e - c : e].tobytes() for c, e in zip(counts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(start, end - start), pa.array(parts, pa.binary())], names=["id", "shingles"]
            )


#: A link needs so many common shingles for each of both texts' together: the threshold as a share of their sum.
NEEDED = LEAST / (1 + LEAST) - 1e-12


def aligned_share(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Labelled shingles matched by the best alignment of two sequences within the band, over all of both.

    Zero if all common shingles in any order could not reach ``least``.
    """
    in_a, in_b = _common(a, b)
    return _aligned_share(in_a, in_b, len(a), len(b), least)


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common shingles in ``a`` and in ``b``, in the order of ``b``."""
    order = np.argsort(a)
    at = np.minimum(np.searchsorted(a[order], b), len(a) - 1)
    in_b = np.flatnonzero(a[order[at]] == b)
    return order[at[in_b]], in_b


def _aligned_share(in_a: np.ndarray, in_b: np.ndarray, size_a: int, size_b: int, least: float) -> float:
    """Labels make the shingles of a text distinct, so the alignment is a longest increasing run of common places."""
    in_a = in_a[np.abs(in_a - in_b) <= BAND * max(size_a, size_b) + abs(size_a - size_b)]
    common = len(in_a)
    if common < (least - 1e-12) * (size_a + size_b - common):
        return 0.0
    if common > 1 and (np.diff(in_a) < 0).any():
        tails: list[int] = []
        for place in in_a.tolist():
            n = bisect_left(tails, place)
            if n == len(tails):
                tails.append(place)
            else:
                tails[n] = place
        common = len(tails)
    return common / (size_a + size_b - common)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text against its centre: whether they are a link, and the shingles in which they differ, those that only the
    centre has with all bits turned."""
    for batch in batches:
        rows: list[tuple] = []
        for left, right in zip(batch.column("x"), batch.column("y"), strict=True):
            a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
            in_a, in_b = _common(a, b)
            own, lost = np.ones(len(a), bool), np.ones(len(b), bool)
            own[in_a] = lost[in_b] = False
            # Whole numbers' quotients, so that 0.8 itself is a link.
            linked = _aligned_share(in_a, in_b, len(a), len(b), LEAST) >= LEAST - 1e-12
            parted = np.concatenate([a[own], ~b[lost]]).view(np.int64)
            rows.append((len(a), linked, len(parted), parted))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        made = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cid"), *made], names=TESTED_NAMES)


TESTED_NAMES = ["id", "cid", "n", "linked", "apart", "parted"]
TESTED = "id binary, cid binary, n long, linked boolean, apart long, parted array<long>"
#: Rounds of centres.  Texts that are then still open, each unlike the centres it met, are compared with all open ones
#: that share one of its rare differences from a centre.
ROUNDS = 2
#: Two texts are a link only if they differ in this share at most of their shingles together.
APART = 1 - 2 * NEEDED + 1e-9


Keep = Callable[[DataFrame, str], DataFrame]


def _tested(pairs: DataFrame, sequences: DataFrame, keep: Keep) -> DataFrame:
    sided = pairs.join(sequences.select("id", F.col("shingles").alias("x")), "id")
    sided = sided.join(sequences.select(F.col("id").alias("cid"), F.col("shingles").alias("y")), "cid")
    return keep(sided.select("id", "cid", "x", "y").mapInArrow(_compare, TESTED), "near-tested")


def _links(tested: DataFrame) -> DataFrame:
    return tested.filter("linked").select(F.col("id").alias("a"), F.col("cid").alias("b"))


def _centred(buckets: DataFrame, keep: Keep) -> DataFrame:
    """Each text of a bucket, once with each of its centres: the text that meets most others in all buckets.

    The text that others were copied from meets more copies than a copy does, so it is the centre of most buckets of
    its group, and what is compared with it is compared once.  What ``keep`` writes is a plain side of a join, in which
    Spark can split the rows of a hot bucket.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    shared = keep(buckets.join(sizes, "key"), "near-shared")
    met = shared.groupBy("id").agg(F.sum("size").alias("met"))
    ranked = shared.join(keep(met, "near-met"), "id").select("key", "id", F.struct("met", F.xxhash64("id"), "id").alias("rank"))
    centres = ranked.groupBy("key").agg(F.max("rank").alias("centre")).select("key", F.col("centre.id").alias("cid"))
    return shared.select("key", "id").join(keep(centres, "near-centres"), "key").select("id", "cid").distinct()


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components with some more links; those that are known are a star each."""
    if comps is None:
        return components(links)
    if links.isEmpty():
        return comps
    return components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(links))


def _named(rows: DataFrame, comps: DataFrame, id: str, comp: str) -> DataFrame:
    """``rows`` with the component of the text ``id``, itself if it has no link."""
    names = comps.select(F.col("id").alias(id), F.col("comp").alias(comp))
    return rows.join(names, id, "left").withColumn(comp, F.coalesce(comp, id))


def _close_pairs(tested: DataFrame) -> DataFrame:
    """Pairs around a centre so close to it that they may be a link whatever they have in common.

    They differ by no more than both differ from the centre together.  Texts as close as that are links of the centre
    themselves, but for those with parts in another order.
    """
    near = tested.filter(F.col("apart") <= APART * (1 + 1 / LEAST) * F.col("n"))
    open_ = near.filter(F.col("comp") != F.col("ccomp")).select("cid", "id", "comp", "n", "apart")
    others = near.select("cid", *(F.col(c).alias(f"other_{c}") for c in ("id", "comp", "n", "apart")))
    both = F.col("apart") + F.col("other_apart") <= APART * (F.col("n") + F.col("other_n"))
    met = open_.join(others, "cid").filter(both & (F.col("comp") != F.col("other_comp")))
    return met.select("id", F.col("other_id").alias("cid")).distinct()


def _rare_keys(tested: DataFrame, keep: Keep) -> DataFrame:
    """Keys that texts of one centre have in common if they are links, apart from close pairs.

    Two texts differ in what only one of them differs in from the centre.  So links share, of the ``apart`` shingles that
    each differs in, all but a share of their lengths.  Each text lists these from the rarest on, by how many texts of the
    centre have them; the first of the common ones is then among the first few of both, and of the text that is less apart
    among the first half of them (``short``).  Shingles that no other text has come first, and mostly leave nothing to
    list.  Keys of one component are left out.  ``rest`` is how many more shared shingles a text lists from the key on.
    """
    parted = tested.select("cid", "id", "comp", "n", "apart", F.explode("parted").alias("shingle"))
    held = parted.groupBy("cid", "shingle").agg(
        F.count("*").alias("holders"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    held = keep(held.filter(F.col("holders") > 1), "near-holders")
    many = (F.col("low") != F.col("high")).alias("many")
    # One text's shingles at most.
    listed = F.array_sort(F.collect_list(F.struct("holders", "shingle", many))).alias("listed")
    shared = parted.join(held, ["cid", "shingle"]).groupBy("cid", "id", "n", "apart").agg(listed)
    most = F.floor(APART * (1 + 1 / LEAST) * F.col("n")) + 1
    half = F.floor(APART * (1 + 1 / LEAST) / 2 * F.col("n")) + 1
    alone = F.col("apart") - F.size("listed")
    taken = F.slice("listed", F.lit(1), F.greatest(most - alone, F.lit(0)).cast("int"))
    keys = shared.select("cid", "id", "n", "apart", F.size("listed").alias("size"), (half - alone).alias("half"), F.posexplode(taken).alias("place", "k"))
    return keys.filter("k.many").select(
        F.xxhash64("cid", "k.shingle").alias("key"), "id", "n", "apart",
        (F.col("size") - F.col("place")).alias("rest"), (F.col("place") < F.col("half")).alias("short"),
    )


def _rare_pairs(keys: DataFrame) -> DataFrame:
    """Pairs of different components with a key in common, that leaves enough shared shingles for a link."""
    others = keys.select("key", *(F.col(c).alias(f"other_{c}") for c in ("id", "comp", "n", "apart", "rest")))
    met = keys.filter("short").join(others, "key")
    shared = F.col("apart") + F.col("other_apart") - APART * (F.col("n") + F.col("other_n"))
    met = met.filter(
        (F.col("comp") != F.col("other_comp"))
        & (F.col("apart") <= F.col("other_apart"))
        & (F.least("n", "other_n") >= (LEAST - 1e-9) * F.greatest("n", "other_n"))
        & (2 * F.least("rest", "other_rest") >= shared)
    )
    pair = F.least("id", "other_id").alias("id"), F.greatest("id", "other_id").alias("cid")
    return met.select(*pair).distinct()


def near_classes(texts: DataFrame) -> DataFrame:
    """``id`` and ``comp`` of every text that has a link; ``texts`` has ``id`` and ``text``, equal ids for equal texts.

    In each bucket of equal sketches every text is compared with one centre, mostly the same for all buckets of a group;
    so a group of copies costs each copy a few comparisons and never all pairs.  Take a link between two texts of a
    bucket that are then in different components: one of them is no link of the centre.  Either both are so close to it
    that only the order of their parts can have kept them apart, or they share what they differ in from it, by
    :func:`_rare_keys`.  The former pairs are compared, and the latter meet in the buckets of the next round, by centre and
    shingle, and after the last round each other.  So no link between texts that share a sketch is lost.
    """
    with scratch(texts.sparkSession) as keep:
        return _near_classes(texts, keep)


def _near_classes(texts: DataFrame, held: Keep) -> DataFrame:
    spark = texts.sparkSession
    found = texts.mapInArrow(_sketch, "id binary, n long, keys array<long>").dropDuplicates(["id"])
    with scratch(spark) as keep:
        buckets = keep(found.select("id", F.explode("keys").alias("key")), "near-sketches")
        pairs = held(_centred(buckets, keep), "near-pairs")
    whole = texts.groupBy("id").agg(F.first("text").alias("text")).join(pairs.select("id").distinct(), "id")
    sequences = held(whole.mapInArrow(_sequences, "id binary, shingles binary"), "near-sequences")
    comps = None
    for round_ in range(ROUNDS):
        with scratch(spark) as keep:
            tested = _tested(pairs.filter(F.col("id") != F.col("cid")), sequences, keep)
            linked = held(_links(tested), "near-links")
            comps = _joined(comps, linked if comps is None else links.unionByName(linked))
            tested = _named(_named(tested.drop("linked"), comps, "id", "comp"), comps, "cid", "ccomp")
            mixed = tested.filter(F.col("comp") != F.col("ccomp")).select("cid").distinct()
            tested = held(tested.join(mixed, "cid"), "near-mixed")
        if tested.isEmpty():
            return comps
        if not round_:
            # Only texts around a centre that is not linked to all of them can still be compared.
            sequences = held(sequences.join(tested.select("id").distinct(), "id"), "near-sequences")
        with scratch(spark) as keep:
            links = held(_links(_tested(_close_pairs(tested), sequences, keep)), "near-links")
            keys = held(_rare_keys(tested, keep), "near-keys")
        if keys.isEmpty():
            return _joined(comps, links)
        if round_ + 1 < ROUNDS:
            # What is left is small beside the first round.
            pairs = held(_centred(keys.select("key", "id").distinct(), lambda df, _: df), "near-pairs")
    comps = _joined(comps, links)
    rest = held(_named(keys, comps, "id", "comp"), "near-rest")
    with scratch(spark) as keep:
        return _joined(comps, _links(_tested(_rare_pairs(rest), sequences, keep)))


def classes(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``id`` of its text, and class of every row.

    A class is named by its least ``doc_id``; ``first_id`` is the text that stands for it.  Equal texts are one class
    at any length, and so are all texts that a chain of links joins.  A null text is empty; texts without words link to
    none.  Null ids come after all others, and a class of nothing else has a null name.
    """
    rows = documents.select("doc_id", text_of().alias("text")).withColumn("id", digest(F.col("text")))
    comps = near_classes(rows.select("id", "text"))
    rows = rows.select("doc_id", "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id"))
    named = rows.groupBy("comp").agg(first.alias("first"), F.count("*").alias("class_size"))
    named = named.select("comp", "class_size", F.col("first.doc_id").alias("class_id"), F.col("first.id").alias("first_id"))
    return rows.join(named, "comp").drop("comp")


def first_of_each(documents: DataFrame) -> DataFrame:
    """One row of ``documents`` for each class: that with the least id; of rows alike in id and text, one."""
    kept = classes(documents).select(F.col("first_id").alias("id")).distinct()
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    rows = documents.select(whole.alias("row"), digest(text_of()).alias("id"))
    # The least id of the text that stands for a class is that of the class, as a null comes last here too.
    place = F.struct(F.col("row.doc_id").isNull().alias("none"), "row.doc_id", F.xxhash64("row").alias("hash"))
    rows = rows.groupBy("id").agg(F.min_by("row", place).alias("row"))
    return rows.join(kept, "id", "left_semi").select("row.*")


@query("op2_order_minhash")
def op2_order_minhash(spark, sf):
    found = classes(load(spark, sf, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("id") == F.col("first_id"))
    return found.select("doc_id", "class_id", "class_size", kept.alias("kept"))
