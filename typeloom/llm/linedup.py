"""Line deduplication by pairwise alignment.

Documents that share lines are aligned line by line with patience diff, and blocks of lines common to both are cut
from the later document.  A document is paired with the earliest holder of each short run of lines it shares, so the
pairs of a run grow with its holders and never with their square.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import digest, scratch, slices, stored, text_of
from typeloom.llm.registry import load, query

#: Characters in an aligned block that is cut, at least.
BLOCK_CHARS = 100
#: Lines that a task turns into Python objects at once.
PIECE_LINES = 50_000
#: Bitmaps that mark the documents with blocks, 4 KB each, and the bits in one.
BITMAPS, BITS = 1024, 32768


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Positions matched by patience diff, increasing in both lists.

    Items that each range holds once are matched in their longest increasing order; the ranges between them, with what
    is equal at their ends taken off, are done the same way.
    """
    matched: list[tuple[int, int]] = []
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        once = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        # Longest increasing order of the places in b: the least last place for each length, and links back.
        tails: list[int] = []
        at: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(once):
            length = bisect_left(tails, j)
            back.append(at[length - 1] if length else -1)
            if length == len(tails):
                tails.append(j)
                at.append(n)
            else:
                tails[length], at[length] = j, n
        chain = []
        n = at[-1] if at else -1
        while n >= 0:
            chain.append(once[n])
            n = back[n]
        if chain:
            matched.extend(chain)
            for i, j in reversed(chain):
                ranges.append((a0, i, b0, j))
                a0, b0 = i + 1, j + 1
            ranges.append((a0, a1, b0, b1))
    return sorted(matched)


def common_blocks(later: list, earlier: list, sizes: list[int], least: int = BLOCK_CHARS) -> list[tuple[int, int]]:
    """Ranges of lines of ``later`` in aligned blocks of ``least`` characters or more; lines of no size are blank.

    Blank lines are passed over: they neither match nor break a block.
    """
    own = [n for n, size in enumerate(sizes) if size]
    blocks = []
    start = size = 0
    last = None
    for i, j in [*patience([later[n] for n in own], earlier), (-1, -1)]:
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            if last is not None and size >= least:
                blocks.append((own[start], own[last[0]] + 1))
            start, size = i, 0
        if i >= 0:
            size += sizes[own[i]]
        last = (i, j)
    return blocks


def runs(sizes: list[int], least: int = BLOCK_CHARS) -> set[tuple[int, int]]:
    """Shortest ranges of ``least`` characters or more that start at a line, and those that end at one.

    Every line of a block of that size is in one of them that lies within the block.
    """
    found = set()
    end = size = 0
    for start, own in enumerate(sizes):
        while end < len(sizes) and size < least:
            size += sizes[end]
            end += 1
        if size < least:
            break
        found.add((start, end))
        size -= own
    start = size = 0
    for end, own in enumerate(sizes, 1):
        size += own
        while size - sizes[start] >= least:
            size -= sizes[start]
            start += 1
        if size >= least:
            found.add((start, end))
    return found


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, ["lines"], PIECE_LINES):
        rows, keys, starts, ends = [], [], [], []
        columns = (batch.column(n).to_pylist() for n in ("lines", "sizes"))
        for row, (lines, sizes) in enumerate(zip(*columns, strict=True)):
            joined = b"".join(h for h, size in zip(lines, sizes, strict=True) if size)
            held = {}
            for start, end in sorted(runs([size for size in sizes if size])):
                held.setdefault(hashlib.md5(joined[16 * start : 16 * end]).digest(), (start, end))
            rows += [row] * len(held)
            keys += held
            starts += [start for start, _ in held.values()]
            ends += [end for _, end in held.values()]
        at = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(at), batch.column("doc_id").take(at), pa.array(keys, pa.binary())]
            + [pa.array(n, pa.int32()) for n in (starts, ends)],
            names=["id", "doc_id", "run", "start", "end"],
        )


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in slices(batches, ["lines", "other_lines"], PIECE_LINES):
        found = []
        columns = (batch.column(n).to_pylist() for n in ("lines", "sizes", "other_lines", "other_sizes"))
        for lines, sizes, other, other_sizes in zip(*columns, strict=True):
            other = [h for h, size in zip(other, other_sizes, strict=True) if size]
            found.append([{"start": s, "end": e} for s, e in common_blocks(lines, other, sizes)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("of"), pa.array(found, kind)], names=["id", "of", "blocks"]
        )


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _keyed(documents: DataFrame) -> DataFrame:
    """Every row as ``row``, its text and the name of its id and text."""
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    return documents.select(
        whole.alias("row"), "doc_id", text_of().alias("text"), digest(F.col("doc_id"), F.col("text")).alias("id")
    )


def overlaps(documents: DataFrame) -> DataFrame:
    """``id`` of a later document, ``of`` the earlier one's ``doc_id``, and the ``blocks`` of lines they share."""
    trimmed = F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    texts = _keyed(documents).select("id", "doc_id", trimmed.alias("lines")).select(
        "id",
        "doc_id",
        F.transform("lines", lambda x: F.unhex(F.md5(x))).alias("lines"),
        F.transform("lines", F.char_length).alias("sizes"),
    )
    with scratch(documents.sparkSession) as keep:
        texts = keep(texts.dropDuplicates(["id"]), "line-hashes")
        return stored(_overlaps(texts, documents.schema["doc_id"].dataType.simpleString(), keep), "line-blocks")


def _overlaps(texts: DataFrame, id_type: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    held = texts.mapInArrow(_runs, f"id binary, doc_id {id_type}, run binary, start int, end int")
    # The place of a document in the order of all: a missing id comes last.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    first = held.groupBy("run").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1)
    # Written, it is a plain side of the join, in which Spark can split the rows of a hot run.
    first = keep(first, "line-holders")
    shared = held.drop("doc_id").join(first, "run").filter(F.col("id") != F.col("first.id"))
    pairs = shared.groupBy("id", F.col("first.id").alias("other")).agg(
        F.first("first.doc_id").alias("of")
    )
    pairs = pairs.select("id", "other", "of").join(texts.select("id", "lines", "sizes"), "id")
    others = texts.select(
        F.col("id").alias("other"), F.col("lines").alias("other_lines"), F.col("sizes").alias("other_sizes")
    )
    pairs = pairs.join(others, "other").drop("other")
    kind = "array<struct<start:int,end:int>>"
    return pairs.mapInArrow(_align, f"id binary, of {id_type}, blocks {kind}").filter(F.size("blocks") > 0)


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: true where ``id`` is one of ``ids``, and for a few others.

    The marks are bits at hashes of the ids, in tables that together take 4 MB at most, however many ids there are.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(BITMAPS * BITS))
    part, bit = F.floor(place / BITS).alias("part"), (place % BITS).cast("int")
    maps = ids.groupBy(part).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    rows = rows.withColumn("part", part).join(F.broadcast(maps), "part", "left")
    return rows.withColumn("marked", marked).drop("part", "bits")


def cut_lines(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` as ``row``, with ``kept`` text, ``n_lines``, ``n_removed`` and ``earlier`` ids.

    The later of two documents is that with the larger ``doc_id``, a null being largest, and then by digest; rows alike
    in id and text are one document, and all come out alike.  A null text is empty.  Blank lines alone are never cut.
    However many documents hold a passage, it stays in the earliest only, unless there it stands out of order: what the
    alignment with the earliest holder passes over is not sought in later ones.
    """
    blocks = overlaps(documents)
    found = blocks.groupBy("id").agg(
        F.array_sort(F.flatten(F.collect_list("blocks"))).alias("blocks"),
        F.array_sort(F.collect_set("of")).alias("earlier"),
    )
    # Rows that surely have no blocks stay where they are: only the others are shuffled, with their texts.
    rows = _marked(_keyed(documents).drop("text"), blocks)
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("blocks", "earlier")]
    whole = rows.filter(~F.col("marked")).select("id", "row", *none)
    rows = rows.filter("marked").join(found, "id", "left").select("id", "row", "blocks", "earlier").unionByName(whole)
    rows = rows.withColumn("text", text_of("row.text")).withColumn("lines", _lines(F.col("text")))
    # What lies between the blocks, which may overlap as they come from several earlier documents.
    rests = F.expr(
        """aggregate(blocks, named_struct('at', 0, 'rests', CAST(array() AS array<struct<at:int,n:int>>)),
            (state, x) -> named_struct('at', greatest(state.at, x.end), 'rests', IF(x.start > state.at, concat(
                state.rests, array(named_struct('at', state.at, 'n', x.start - state.at))), state.rests)),
            state -> IF(state.at < size(lines), concat(
                state.rests, array(named_struct('at', state.at, 'n', size(lines) - state.at))), state.rests))"""
    )
    rows = rows.withColumn("rests", rests)
    left = F.flatten(F.transform("rests", lambda x: F.slice("lines", x["at"] + 1, x["n"])))
    rows = rows.withColumn("left", F.when(F.col("blocks").isNotNull(), left))
    return rows.select(
        "row",
        F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("earlier", F.array().cast(rows.schema["earlier"].dataType)).alias("earlier"),
    )


def cut_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with what is left of their texts, and its length as ``n_chars``; a row that loses all goes."""
    found = cut_lines(documents)
    changed = F.col("n_removed") > 0
    found = found.filter(~changed | F.col("kept").rlike(r"[^ \t-\r]"))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    columns = [
        F.when(changed, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`").alias(c)
        for c in documents.columns
    ]
    return found.select(*columns)


@query("op7_line_dedup")
def op7_line_dedup(spark, sf):
    found = cut_lines(load(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n_lines", "n_removed", "earlier", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
