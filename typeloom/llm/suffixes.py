"""Removal of long repeated byte strings by a hash-compared suffix sort of sampled suffixes.

A byte goes if a string of 400 bytes that covers it also starts anywhere else.  Of the short grams within each such
string the one of least hash is its anchor, so equal strings have their anchors at equal places; an anchor owns the
starts of the strings that have it, 176 on average.  Anchors are grouped by the hash of their gram.  If all that two
anchors own is equal, by hash, everything they own repeats.  The others are compared within their group: the suffixes
at the anchors, and the reversed prefixes before them, are sorted by merging, where two are compared through prefix
polynomial hashes, a binary search giving their common extension.  The neighbours in both orders bound what can repeat
and mostly show that it does; what they leave open is settled by the hashes of the strings themselves.  Every extension
that counts is compared byte by byte before it is used.

A group too large for one task is refined instead: what its anchors own is cut into cells, at equal distances from the
anchor, and Spark counts for each cell the bytes that all its strings share and those that they make up together.  A
cell repeats if the latter do, and cannot if the former do not; the strings of the few others are counted one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import stored, text_of
from typeloom.llm.registry import load, query

#: Bytes in a string whose repetition counts, and in a gram.
LENGTH, GRAM = 400, 50
GRAMS = LENGTH - GRAM + 1
#: Bytes that a task hashes at once.  Longer texts are done in overlapping parts.
PART = 1 << 20
#: Different anchors of a group that one task compares; larger groups are refined.  Starts in a cell.
GROUP, CELL = 1000, 25

_RANDOM = np.random.default_rng(7)
_BYTES = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 22) - 1)


class Hashed:
    """Prefix polynomial hashes of a buffer of at most :data:`PART` bytes; equal strings anywhere have equal hashes."""

    _powers: np.ndarray | None = None

    def __init__(self, data: np.ndarray):
        if Hashed._powers is None:
            Hashed._powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(PART, _BASE))])
        self.data = data
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * Hashed._powers[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * Hashed._powers[PART - start]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Equal bytes from ``x`` and ``y`` on, or before them: a binary search, of ``most`` bytes."""
        found = np.zeros(len(x), np.int64)
        bit = 1 << int(most.max(initial=0)).bit_length()
        while bit := bit >> 1:
            length = np.minimum(found + bit, most)
            sign = length if back else 0
            same = (length > found) & (self.of(x - sign, length) == self.of(y - sign, length))
            found = np.where(same, length, found)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts that lie end to end in ``data``: start owned first, anchor, start owned last, two hashes.

    The first hash is the gram's, the second that of all the anchor owns and of its place there.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    hashed = Hashed(data)
    grams = hashed.of(np.arange(len(data) - GRAM + 1), GRAM)
    keys = (_mixed(grams) & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    # Least key of each window: the least up to the end of a block and from the start of the next.
    width = -(-len(keys) // GRAMS) * GRAMS
    blocks = np.full(width, np.uint64(2**64 - 1))
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, GRAMS)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = len(data) - LENGTH + 1
    place = (np.minimum(after[:count], before[GRAMS - 1 : GRAMS - 1 + count]) & _PLACE).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(count), side="right")
    valid = np.flatnonzero(np.arange(count) + LENGTH <= ends[owner])
    if not len(valid):
        return none, none, none, none, none
    anchor = place[valid]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(valid)]]) - 1
    low, high, anchor = valid[first], valid[last], anchor[first]
    whole = hashed.of(low, high + LENGTH - low) + _mixed((anchor - low).astype(np.uint64) * np.uint64(512) + (high - low).astype(np.uint64))
    return low, anchor, high, grams[anchor].view(np.int64), _mixed(whole).view(np.int64)


def _parts(texts: list[bytes], part: int = PART) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces of texts (number, offset, bytes) whose windows together are those of the texts, packed to a part each."""
    pack: list[tuple[int, int, bytes]] = []
    size = 0
    for n, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), part - LENGTH + 1):
            piece = text[at : at + part]
            if size + len(piece) > part:
                yield pack
                pack, size = [], 0
            pack.append((n, at, piece))
            size += len(piece)
    if pack:
        yield pack


_ANCHORS = pa.schema(
    [("id", pa.binary()), *((name, pa.list_(pa.int64())) for name in ("gram", "whole", "pack"))]
)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column("text")]
        found: dict[int, list[tuple]] = {}
        for pack in _parts(texts):
            data = np.frombuffer(b"".join(p for _, _, p in pack), np.uint8)
            ends = np.cumsum([len(p) for _, _, p in pack])
            low, anchor, high, gram, whole = anchors(data, ends)
            owner = np.searchsorted(ends, low, side="right")
            bounds = np.searchsorted(owner, np.arange(len(pack) + 1))
            for k, (n, at, piece) in enumerate(pack):
                own = slice(bounds[k], bounds[k + 1])
                start = low[own] - (ends[k] - len(piece)) + at
                packed = (start << 18) + ((anchor[own] - low[own]) << 9) + (high[own] - low[own])
                found.setdefault(n, []).append((gram[own], whole[own], packed))
        rows = sorted(found)
        columns = [pa.array([pa.scalar(batch.column("id")[n]).as_py() for n in rows], pa.binary())]
        for k in range(3):
            columns.append(pa.array([np.concatenate([f[k] for f in found[n]]) for n in rows], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, schema=_ANCHORS)


def suffix_order(hashed: Hashed, at: np.ndarray, room: np.ndarray, group: np.ndarray, back: bool = False) -> np.ndarray:
    """Order of the suffixes at ``at``, or of the reversed prefixes before it, within each group; groups lie together.

    A merge sort of all groups at once: in each round, every suffix finds its place in the neighbouring run by bisection.
    """
    order = np.arange(len(at))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(at)]]))
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    run = 1
    while run < sizes.max(initial=0):
        slot = np.arange(len(at))
        local = slot - first
        mine = local // run
        low = first + (mine ^ 1) * run
        active = np.flatnonzero((low < first + size) & (size > run))
        origin = low = low[active]
        high = np.minimum(low + run, (first + size)[active])
        own, right = order[active], (mine[active] & 1) == 1
        while (low < high).any():
            middle = np.minimum((low + high) // 2, len(at) - 1)
            other = order[middle]
            most = np.minimum(room[own], room[other])
            same = hashed.common(at[own], at[other], most, back)
            step = -same - 1 if back else same
            ended = same == most
            byte = hashed.data[np.where(ended, 0, at[own] + step)].astype(np.int64)
            other_byte = hashed.data[np.where(ended, 0, at[other] + step)].astype(np.int64)
            sign = np.where(ended, room[other] - room[own], other_byte - byte)
            go = (low < high) & ((sign < 0) | ((sign == 0) & right))
            low, high = np.where(go, middle + 1, low), np.where(go | (low >= high), high, middle)
        placed = order.copy()
        target = first[active] + (mine[active] & ~1) * run + local[active] % run + (low - origin)
        placed[target] = own
        order = placed
        run *= 2
    return order


def repeated_starts(
    strings: list[bytes], place: np.ndarray, owned: np.ndarray, group: np.ndarray, closed: np.ndarray
) -> list[list[tuple[int, int]]]:
    """For each string, ranges of the starts it owns whose 400 bytes also start, as far from the anchor, in its group.

    ``place`` is where the anchor stands, and ``owned`` how many starts from 0 on are owned.  Nothing is sought for
    ``closed`` ones.  Groups lie together, and all strings fit into a part.
    """
    count = len(strings)
    data = np.frombuffer(b"".join(strings), np.uint8)
    length = np.array([len(s) for s in strings], np.int64)
    base = np.cumsum(length) - length
    hashed = Hashed(data)
    at, ahead = base + place, length - place
    found: list[list[tuple[int, int]]] = [[] for _ in strings]

    neighbours, best = [], []
    for room, back in ((ahead, False), (place, True)):
        order = suffix_order(hashed, at, room, group, back)
        most = np.zeros(count, np.int64)
        near = np.full((2, count), -1)
        x, y = order[:-1], order[1:]
        together = group[x] == group[y]
        x, y = x[together], y[together]
        common = hashed.common(at[x], at[y], np.minimum(room[x], room[y]), back)
        np.maximum.at(most, x, common)
        np.maximum.at(most, y, common)
        near[0, y], near[1, x] = x, y
        neighbours += [near[0], near[1]]
        best.append(most)
    # A string may start so far before the anchor, if one neighbour or other allows it.
    least, most = np.maximum(LENGTH - best[0], place - owned + 1), np.minimum(best[1], place)
    wanted = ~closed & (least <= most)
    open_rows = []
    spans: dict[int, list[tuple[int, int, int]]] = {int(r): [] for r in np.flatnonzero(wanted)}
    for near in neighbours:
        rows = np.flatnonzero(wanted & (near >= 0))
        other = near[rows]
        right = hashed.common(at[rows], at[other], np.minimum(ahead[rows], ahead[other]))
        left = hashed.common(at[rows], at[other], np.minimum(place[rows], place[other]), True)
        from_, to = np.maximum(LENGTH - right, least[rows]), np.minimum(left, most[rows])
        for r, q, a, b in zip(rows.tolist(), other.tolist(), from_.tolist(), to.tolist(), strict=True):
            if a <= b:
                spans[r].append((a, b, q))
    for r, own in spans.items():
        covered = int(least[r])
        for a, b, q in sorted(own):
            if a > covered or b < covered:
                continue
            if _same(strings, place, r, q, a, b):
                found[r].append((int(place[r]) - b, int(place[r]) - a))
                covered = b + 1
        if covered <= most[r]:
            open_rows.append(r)
    if open_rows:
        _settle(hashed, strings, place, owned, at, group, least, most, open_rows, found)
    return found


def _same(strings: list[bytes], place: np.ndarray, r: int, q: int, a: int, b: int) -> bool:
    """Whether the strings that start ``a`` to ``b`` bytes before the anchors are equal, byte by byte."""
    x, y = int(place[r]), int(place[q])
    return strings[r][x - b : x - a + LENGTH] == strings[q][y - b : y - a + LENGTH]


def _settle(hashed, strings, place, owned, at, group, least, most, open_rows, found) -> None:
    """Compare what the sorted neighbours left open with the whole group, by the hashes of the strings."""
    bounds = np.searchsorted(group, [group[r] for r in open_rows]), np.searchsorted(group, [group[r] for r in open_rows], "right")
    for first, last in sorted(set(zip(*(b.tolist() for b in bounds), strict=True))):
        rows = [r for r in open_rows if first <= r < last]
        low, high = min(least[r] for r in rows), max(most[r] for r in rows)
        member = np.repeat(np.arange(first, last), high - low + 1)
        back = np.tile(np.arange(low, high + 1), last - first)
        owns = (back <= place[member]) & (back > place[member] - owned[member])
        member, back = member[owns], back[owns]
        keys = hashed.of(at[member] - back, LENGTH)
        order = np.lexsort((member, keys, back))
        member, back, keys = member[order], back[order], keys[order]
        same = (back[1:] == back[:-1]) & (keys[1:] == keys[:-1])
        partner = np.full(len(member), -1)
        partner[1:][same] = member[:-1][same]
        lone = np.flatnonzero(same & (partner[:-1] < 0))
        partner[lone] = member[lone + 1]
        for r in rows:
            mine = np.flatnonzero((member == r) & (partner >= 0) & (back >= least[r]) & (back <= most[r]))
            x = int(place[r])
            for b, q in zip(back[mine].tolist(), partner[mine].tolist(), strict=True):
                if _same(strings, place, r, q, b, b):
                    found[r].append((x - b, x - b))


FOUND = "id binary, first long, last long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that lie together by ``gram`` become the repeated starts of each text."""
    pending: list[dict] = []
    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            # A group has GROUP strings of 751 bytes at most, so with it the rows still fit into a part.
            if size > PART // 4 and row["gram"] != pending[-1]["gram"]:
                yield _repeats(pending)
                pending, size = [], 0
            pending.append(row)
            size += len(row["string"])
    if pending:
        yield _repeats(pending)


def _repeats(rows: list[dict]) -> pa.RecordBatch:
    found = repeated_starts(
        [r["string"] for r in rows],
        np.array([r["place"] for r in rows], np.int64),
        np.array([len(r["string"]) - LENGTH + 1 for r in rows], np.int64),
        np.unique([r["gram"] for r in rows], return_inverse=True)[1],
        np.array([r["closed"] for r in rows], bool),
    )
    spans = [(r["id"], r["low"] + a, r["low"] + b) for r, own in zip(rows, found, strict=True) for a, b in own]
    columns = list(zip(*spans, strict=True)) or [()] * 3
    kinds = (pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "first", "last"]
    )


def _rows(made: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of some thousand rows."""
    while rows := list(islice(made, 4000)):
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema
        )


def _owned(batches: Iterator[pa.RecordBatch], large: bool) -> Iterator[tuple]:
    """Every sent anchor of the large groups or of the others: its fields, text id, first start, place and string."""
    for batch in batches:
        for row in batch.to_pylist():
            sent = [s for s in row["sent"] or () if s["large"] == large]
            text = row["text"].encode("utf-8", "surrogatepass") if sent else b""
            for s in sent:
                low, place, more = s["pack"] >> 18, (s["pack"] >> 9) & 511, s["pack"] & 511
                yield s, row["id"], low, place, text[low : low + more + LENGTH]


_SHIPPED = pa.schema(
    [
        ("gram", pa.int64()), ("id", pa.binary()), ("low", pa.int64()), ("place", pa.int64()), ("closed", pa.bool_()),
        ("string", pa.binary()),
    ]
)
SHIPPED = "gram long, id binary, low long, place long, closed boolean, string binary"


def _ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = ((s["gram"], i, low, place, s["closed"], text) for s, i, low, place, text in _owned(batches, False))
    return _rows(made, _SHIPPED)


_CELLS = pa.schema(
    [
        ("core", pa.binary()), ("whole", pa.binary()), ("id", pa.binary()), ("first", pa.int64()), ("last", pa.int64()),
        ("n", pa.int64()),
    ]
)
CELLS = "core binary, whole binary, id binary, first long, last long, n long"


def cells(place: int, text: bytes) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Keys of the shared and of all bytes of each cell of the starts owned, and its first and last start."""
    for cell in range((place - len(text) + LENGTH) // CELL, place // CELL + 1):
        near, far = cell * CELL, cell * CELL + CELL - 1
        first, last = max(place - far, 0), min(place - near, len(text) - LENGTH)
        core, whole = text[place - near : place - far + LENGTH], text[first : last + LENGTH]
        name = b"%d:" % cell
        yield (
            xxhash.xxh3_128_digest(name + core),
            xxhash.xxh3_128_digest(b"%d:%d:" % (place - first, place - last) + whole),
            first,
            last,
        )


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = (
        (core, whole, i, low + first, low + last, 1 + s["closed"])
        for s, i, low, place, text in _owned(batches, True)
        for core, whole, first, last in cells(place, text)
    )
    return _rows(made, _CELLS)


_STRINGS = pa.schema([("key", pa.binary()), ("id", pa.binary()), ("first", pa.int64()), ("n", pa.int64())])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"].encode("utf-8", "surrogatepass")
                for cell in row["cells"]:
                    for at in range(cell["first"], cell["last"] + 1):
                        yield xxhash.xxh3_128_digest(text[at : at + LENGTH]), row["id"], at, cell["n"]

    return _rows(made(), _STRINGS)


def refined(whole: DataFrame) -> list[DataFrame]:
    """Repeated starts of the anchors of large groups that ``whole`` holds, as :data:`FOUND`."""
    found = stored(whole.mapInArrow(_cell_rows, CELLS), "suffix-cells")
    first = F.min(F.struct("id", "first", "last")).alias("of")
    same = stored(found.groupBy("core", "whole").agg(F.sum("n").alias("n"), first), "suffix-cell-groups")
    equal = found.join(same.filter(F.col("n") > 1).select("core", "whole"), ["core", "whole"])
    cores = same.groupBy("core").agg(F.sum("n").alias("all"), F.min("n").alias("least"))
    cores = stored(cores.filter((F.col("all") > 1) & (F.col("least") == 1)).select("core"), "suffix-cores")
    left = same.join(cores, "core").select("of.*", F.least("n", F.lit(2)).alias("n"))
    left = left.groupBy("id").agg(F.collect_list(F.struct("first", "last", "n")).alias("cells"))
    strings = whole.select("id", "text").join(left, "id").mapInArrow(_strings, "key binary, id binary, first long, n long")
    strings = stored(strings, "suffix-strings")
    twice = strings.groupBy("key").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("key")
    late = strings.filter(F.col("n") == 1).join(stored(twice, "suffix-twice"), "key")
    return [equal.select("id", "first", "last"), late.select("id", "first", F.col("first").alias("last"))]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text = row["text"].encode("utf-8", "surrogatepass")
            digest, at, removed, spans, open_end = hashlib.sha256(), 0, 0, 0, -1
            for start, end in sorted((s["first"], s["end"]) for s in row["spans"]):
                spans += start > open_end
                if start > at:
                    digest.update(text[at:start])
                removed += max(end, at) - max(start, at)
                at = open_end = max(end, at)
            digest.update(text[at:])
            rows.append((row["id"], removed, spans, digest.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "n_removed", "n_spans", "kept_sha256"]
        )


def cut_repeats(documents: DataFrame) -> DataFrame:
    """Bytes, removed bytes, removed runs, and digest of what is left of every row's text.

    A null text is empty.  Rows with equal texts are copies of each other, whatever their ids: such a text of 400 bytes
    or more goes wholly.  Shorter texts never lose anything.  Other columns are ignored.
    """
    rows = documents.select("doc_id", text_of().alias("text")).withColumn("id", F.unhex(F.md5("text")))
    texts = rows.select("id", "text")
    found = texts.filter(F.octet_length("text") >= LENGTH)
    found = found.mapInArrow(_find_anchors, "id binary, gram array<long>, whole array<long>, pack array<long>")
    found = stored(found.dropDuplicates(["id"]), "suffix-anchors")
    found = found.select("id", F.explode(F.arrays_zip("gram", "whole", "pack")).alias("x")).select("id", "x.*")
    # What is written is a plain side of a join, in which Spark can split the rows of a hot gram.
    shared = found.groupBy("gram").count().filter(F.col("count") > 1).select("gram")
    found = stored(found.join(stored(shared, "suffix-grams"), "gram"), "suffix-shared")

    same = found.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "pack")).alias("first"))
    same = stored(same, "suffix-groups")
    kinds = same.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    kinds = stored(kinds.filter((F.col("kinds") > 1) & (F.col("least") == 1)), "suffix-kinds")
    sent = F.struct(
        "gram",
        F.col("first.pack").alias("pack"),
        (F.col("n") > 1).alias("closed"),
        (F.col("kinds") > GROUP).alias("large"),
    )
    sent = same.join(kinds, "gram").select("first.id", sent.alias("sent"))
    sent = sent.groupBy("id").agg(F.collect_list("sent").alias("sent"))
    involved = found.select("id").distinct().join(sent, "id", "left")
    whole = texts.groupBy("id").agg(F.first("text").alias("text")).join(involved, "id")
    whole = stored(whole, "suffix-texts")

    shipped = whole.mapInArrow(_ship, SHIPPED).repartition("gram").sortWithinPartitions("gram")
    compared = stored(shipped.mapInArrow(_compare, FOUND), "suffix-found")

    low = F.shiftright("pack", 18)
    equal = found.join(same.filter(F.col("n") > 1).select("gram", "whole"), ["gram", "whole"])
    spans = equal.select("id", low.alias("first"), (low + F.col("pack").bitwiseAND(F.lit(511)) + LENGTH).alias("end"))
    for part in (compared, *refined(whole)):
        spans = spans.unionByName(part.select("id", "first", (F.col("last") + LENGTH).alias("end")))
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    cut = whole.select("id", "text").join(spans, "id").mapInArrow(
        _cut, "id binary, n_removed long, n_spans long, kept_sha256 string"
    )
    copies = rows.groupBy("id").count().filter(F.col("count") > 1).select("id", F.lit(True).alias("copied"))
    rows = rows.select(
        "doc_id",
        "id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
    )
    rows = rows.join(cut, "id", "left").join(copies, "id", "left")
    all_gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf):
    return cut_repeats(load(spark, sf, "documents"))
