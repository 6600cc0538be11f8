"""Document fingerprints by locally consistent parsing.

A text is cut into phrases, the phrases into phrases of phrases, and so on up to one.  Where to cut depends only on a few
neighbours: a run of equal names is a phrase; elsewhere deterministic coin tossing labels each name by the lowest bit in
which it differs from the one before, three times, until labels are small, and a phrase starts at each least label.  So
equal substrings have equal phrases inside, wherever they stand.  A phrase is named by a hash of the names in it.  The
fingerprint of a text is the least :data:`KEPT` hashes of the phrases that cover enough of it, each with how often it came
before; their likeness estimates how many phrases two texts share, out of all of both, and is exact for texts of few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from typeloom.llm.common import digest, pieces, stored, text_of
from typeloom.llm.registry import load, query

#: Hashes in a fingerprint, of 32 bits each.
KEPT = 40
#: Code points that a phrase covers to count; in a text of fewer than eight times as many, an eighth of it, but two.
COVER = 12

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.cumprod(np.full(64, _MIX, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _toss_table() -> np.ndarray:
    """Label of a small label after another: twice the lowest bit they differ in, and that bit of the label."""
    label = np.arange(128)
    differ = label[None, :] ^ label[:, None]
    bit = np.where(differ, np.log2(np.maximum(differ & -differ, 1)).astype(int), 0)
    return (2 * bit + ((label[None, :] >> bit) & 1)).astype(np.uint8).reshape(-1)


_TOSS = _toss_table()


def _starts(names: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where phrases start among the names of texts that lie end to end; ``heads`` marks where each text starts."""
    n = len(names)
    # A name equal to the one before it continues a run; before and after a run the parse starts anew.
    repeats = np.zeros(n, bool)
    repeats[1:] = (names[1:] == names[:-1]) & ~heads[1:]
    in_run = repeats.copy()
    in_run[:-1] |= repeats[1:]
    starts = heads | (in_run & ~repeats)
    starts[1:] |= in_run[:-1] & ~in_run[1:]
    # Three tosses: labels below 128, 14 and 8.  The first name of a stretch has none before it, and counts as after 0.
    before = np.empty_like(names)
    before[0] = 0
    before[1:] = names[:-1]
    before[starts] = 0
    differ = names ^ before
    lowest = differ & (~differ + names.dtype.type(1))
    bit = (lowest.astype(np.float64).view(np.int64) >> 52) - 1023
    label = (2 * np.maximum(bit, 0) + ((names & lowest) != 0)).astype(np.int16)
    for _ in range(2):
        last = np.zeros(n, np.int16)
        last[1:] = label[:-1]
        last[starts] = 0
        label = _TOSS[(last << 7) + label].astype(np.int16)
    # Labels of neighbours differ, but for the first two of a stretch perhaps; the least of its neighbours starts a phrase.
    inner = ~starts
    inner[:-1] &= ~starts[1:]
    inner[-1] = False
    least = np.zeros(n, bool)
    least[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
    return starts | (least & inner & ~repeats)


def _level(names: np.ndarray, heads: np.ndarray, cover: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """The phrases of one level: names, which start a text, code points each covers, and which are of several names."""
    at = np.flatnonzero(_starts(names, heads))
    sizes = np.diff(np.append(at, len(names)))
    within = np.arange(len(names)) - np.repeat(at, sizes)
    # A run may be long: the weight of a place recurs after 64 of them, and the length is part of the name.
    weighed = _mixed(names.astype(np.uint64) * _MIX + np.uint64(level)) * _STEPS[within & 63]
    new = _mixed(np.add.reduceat(weighed, at) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    # A name alone keeps its name: it is the same phrase.
    alone = sizes == 1
    if level:
        new[alone] = names[at[alone]]
    return new, heads[at], np.add.reduceat(cover, at), ~alone


def fingerprints(texts: list[str]) -> list[bytes]:
    """A fingerprint for each text: its least hashes in order, four bytes each; none for the empty text."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    held = np.flatnonzero(sizes)
    if not len(held):
        return [b""] * len(texts)
    names = np.concatenate([points[k] for k in held])
    # Zero stands for no name before.
    names = names + np.uint32(1)
    heads = np.zeros(len(names), bool)
    heads[np.concatenate([[0], np.cumsum(sizes[held])[:-1]])] = True
    cover = np.ones(len(names), np.int64)
    counts = np.maximum(np.minimum(COVER, sizes[held] // 8), 2)
    owner = np.arange(len(held))
    found, owners = [], []
    level = 0
    while len(names):
        names, heads, cover, new = _level(names, heads, cover, level)
        own = owner[np.cumsum(heads) - 1]
        # What is one phrase is done: it is the whole text, which counts at any length.
        last = heads.copy()
        last[:-1] &= heads[1:]
        counted = ((cover >= counts[own]) | last) & (new | (level == 0))
        found.append(names[counted])
        owners.append(own[counted])
        if last.any():
            names, heads, cover = names[~last], heads[~last], cover[~last]
            owner = owner[np.isin(owner, own[last], invert=True)]
        level += 1
    hashes, owners = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    # How often the same phrase came before in the text: its place among its equals.
    first = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])
    at = np.arange(len(order))
    hashes = hashes + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * _STEPS[1]
    keys = np.unique((owners.astype(np.uint64) << np.uint64(32)) | (_mixed(hashes * _MIX) >> np.uint64(32)))
    own = (keys >> np.uint64(32)).astype(np.int64)
    first = np.searchsorted(own, np.arange(len(held) + 1))
    least = (keys & np.uint64(0xFFFFFFFF)).astype(">u4")
    made = [b""] * len(texts)
    for k, text in enumerate(held.tolist()):
        made[text] = least[first[k] : min(first[k] + KEPT, first[k + 1])].tobytes()
    return made


def likeness(a: bytes, b: bytes) -> float:
    """The share of common hashes among the least of both: an estimate of common phrases out of all.

    Two fingerprints that are equal, empty ones too, are 1 alike.
    """
    if a == b:
        return 1.0
    left, right = (set(np.frombuffer(x, ">u4").tolist()) for x in (a, b))
    # A fingerprint that is not full holds all phrases of its text, so only a full one limits what is known of both.
    bound = [max(s) for s in (left, right) if len(s) >= KEPT]
    known = sorted(left | right)
    if bound:
        known = [h for h in known if h <= min(bound)][:KEPT]
    return sum(h in left and h in right for h in known) / len(known) if known else 0.0


_ROW = "kind string, part int, doc_id {id}, text string, n_chars long, edited_sha256 string, fingerprint binary, edited binary, near_edited double, near_next double"
_NAMES = ["kind", "part", "doc_id", "text", "n_chars", "edited_sha256", "fingerprint", "edited", "near_edited", "near_next"]


def edited_text(text: str, next_text: str) -> str:
    """The text with its last third (rounded down) replaced by as much of the start of the next, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + next_text[:third]


def _compared(texts: list[str], nexts: list[str], prints: list[bytes] | None, next_prints: list[bytes] | None) -> list[list]:
    """Output columns of texts with the texts after them."""
    edited = [edited_text(t, n) for t, n in zip(texts, nexts, strict=True)]
    own = fingerprints(texts) if prints is None else prints
    of_next = fingerprints(nexts) if next_prints is None else next_prints
    changed = fingerprints(edited)
    shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
    near = [likeness(a, b) for a, b in zip(own, changed, strict=True)]
    near_next = [likeness(a, b) for a, b in zip(own, of_next, strict=True)]
    return [[len(t) for t in texts], shas, own, changed, near, near_next]


def _batch(kind: str, part: int, ids: pa.Array, texts: list, columns: list[list] | None) -> pa.RecordBatch:
    n = len(ids)
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] if columns else [pa.nulls(n, k) for k in kinds]
    whole = [pa.repeat(kind, n), pa.array([part] * n, pa.int32()), ids, pa.array(texts, pa.string()), *made]
    return pa.RecordBatch.from_arrays(whole, names=_NAMES)


def _sorted_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order, each with the one after it.  The range's first and last text are sent along, as what
    follows the last is in another range."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for start, end in pieces(texts):
            ids = batch.column("doc_id").slice(start, end - start)
            some = texts[start:end]
            prints = fingerprints(some)
            if held is None:
                yield _batch("first", part, ids.slice(0, 1), some[:1], None)
            else:
                ids = pa.concat_arrays([held[0], ids])
                some, prints = [held[1], *some], [held[2], *prints]
            if len(some) > 1:
                columns = _compared(some[:-1], some[1:], prints[:-1], prints[1:])
                yield _batch("row", part, ids.slice(0, len(some) - 1), [None] * (len(some) - 1), columns)
            held = ids.slice(len(some) - 1), some[-1], prints[-1]
    if held is not None:
        yield _batch("last", part, held[0], [held[1]], None)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, nexts = batch.column("text").to_pylist(), batch.column("next").to_pylist()
        for n in range(len(texts)):
            columns = _compared(texts[n : n + 1], nexts[n : n + 1], None, None)
            yield _batch("row", 0, batch.column("doc_id").slice(n, 1), [None], columns)


def fingerprinted(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, fingerprints of the text and of its edited text, and how like it is to that and the next.

    The next document is the one with the next smaller id; after the last comes the first.  Null ids come last; rows of
    one id go by the digest of their text, so repeated rows follow each other.  A null text is empty.  A text of fewer
    than three code points is its own edited text; an only document is its own next.  Equal texts have equal
    fingerprints, in hex; those of empty texts are empty, and 1 alike.  Other columns are ignored.

    Texts are shuffled once, into sorted ranges.  A task streams its range and holds a piece of it; the text that
    follows a range's last one is joined to it afterwards, one row for each range.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", text_of().alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), digest(F.col("text"))]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(_sorted_part, _ROW.format(id=kind)), "phrases")
    # One row for each range: what follows the last of them is the first of the next, and of the first in the end.
    firsts = found.filter("kind = 'first'").select("part", "text")
    order_of = firsts.select("part", F.lead("part").over(W.orderBy("part")).alias("after"), F.min("part").over(W.partitionBy(F.lit(1))).alias("least"))
    order_of = order_of.select("part", F.coalesce("after", "least").alias("after"))
    lasts = found.filter("kind = 'last'").select("part", "doc_id", "text").join(order_of, "part")
    firsts = firsts.select(F.col("part").alias("after"), F.col("text").alias("next"))
    edges = lasts.join(firsts, "after").select("doc_id", "text", "next")
    edges = edges.mapInArrow(_edges, _ROW.format(id=kind))
    whole = found.filter("kind = 'row'").unionByName(edges)
    return whole.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query("op13_document_fingerprints")
def op13_document_fingerprints(spark, sf):
    return fingerprinted(load(spark, sf, "documents"))
