"""Conversation prefix trie by van Emde Boas recursion.

The trie of all conversations is never walked turn by turn.  Depths ``0 .. 2**levels - 1`` are cut at half: the prefixes
that reach the cut are named, one representative of each goes on into the upper trie, and what follows the cut goes on
into the lower forests, under the names of their roots.  Both halves are cut again in the same pass, so the passes grow
with the logarithm of the longest conversation, and after each there are no more rows than conversations and prefixes
named so far.  Totals are grafted in the same order: those of lower forests onto the leaves of upper tries, first upward
within each window of depths, then from the tops of later windows onto earlier ones.

Names are SHA-256 digests.  A block of ``2**n`` turns is named by its halves' names, a prefix by the prefix before its
last cut and the block in between; a depth is always cut in the same way, so equal prefixes have equal names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import stored
from typeloom.llm.registry import load, query
from typeloom.operators.numbering import NUMBER, number_rows

#: Conversation ids in a piece of a list of ends.
PIECE_IDS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def _name(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


ROOT = hashlib.sha256(b"root").digest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv``, ``pos`` from 0, ``turn`` (the name of role and text) and ``bytes`` of the text, for every turn.

    Turns go by ``turn``, a null first, and ties by the first 64 bytes of role and text, then by name, so that texts need
    not be sorted whole.  A null role or text is empty.  Rows without a ``conv_id`` belong to no conversation and are left
    out.  Other columns are ignored.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.coalesce("role", F.lit("")).cast("binary").alias("role"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    # The length of the role comes first, so that no text can pose as part of a role.
    name = _name(F.concat(F.octet_length("role").cast("string"), F.lit(":")).cast("binary"), F.col("role"), F.col("text"))
    start = lambda c: F.substring(c, 1, 64).alias(c)
    size = F.octet_length("text").cast("long").alias("bytes")
    rows = rows.select("conv", "turn", start("role"), start("text"), name.alias("name"), size)
    numbered = number_rows(rows, ["conv", "turn", "role", "text", "name"]).select("conv", NUMBER, "name", "bytes")
    first = numbered.groupBy("conv").agg(F.min(NUMBER).alias("first"))
    numbered = numbered.join(first, "conv")
    return stored(numbered.select("conv", (F.col(NUMBER) - F.col("first")).alias("pos"), "name", "bytes"), "trie-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of the rebuilt conversations.

    Conversation ``c`` takes the first ``crc32(c) % 9`` turns of conversation ``c - c % 5`` (all if that has fewer, none
    if there is none), then its own turns after as many.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("size"))
    convs = sizes.select(
        "conv",
        "size",
        (F.col("conv") - F.col("conv") % 5).alias("base"),
        (F.crc32(F.col("conv").cast("string")) % 9).alias("head"),
    )
    of_base = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(of_base, "base", "left")
    convs = convs.withColumn("taken", F.least("head", F.coalesce("base_size", F.lit(0))))
    convs = stored(convs, "trie-convs")
    # At most five conversations share a base, and at most eight turns of it are taken.
    heads = turns.filter(F.col("pos") < 8).withColumnRenamed("conv", "base")
    heads = convs.select("conv", "base", "taken").join(heads, "base").filter(F.col("pos") < F.col("taken"))
    own = turns.join(convs.select("conv", "head", "taken"), "conv").filter(F.col("pos") >= F.col("head"))
    own = own.withColumn("pos", F.col("pos") - F.col("head") + F.col("taken"))
    columns = ("conv", "pos", "name", "bytes")
    length = F.col("taken") + F.greatest(F.col("size") - F.col("head"), F.lit(0))
    return heads.select(*columns).unionByName(own.select(*columns)), convs.select("conv", length.alias("length"))


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """For each level ``n`` the whole blocks of ``2**n`` turns: name, and bytes of the last text."""
    blocks = [stored(turns.withColumnRenamed("pos", "block"), "trie-blocks")]
    for _ in range(levels - 1):
        right = F.col("block") % 2 == 1
        halves = blocks[-1].groupBy("conv", F.expr("block div 2").alias("block")).agg(
            F.max(F.when(~right, F.col("name"))).alias("left"),
            F.max(F.when(right, F.col("name"))).alias("right"),
            F.max(F.when(right, F.col("bytes"))).alias("bytes"),
        )
        whole = halves.filter(F.col("right").isNotNull())
        blocks.append(stored(whole.select("conv", "block", _name("left", "right").alias("name"), "bytes"), "trie-blocks"))
    return blocks


def _cut(sequences: DataFrame, blocks: DataFrame, half: int) -> DataFrame:
    """Cut every sequence ``half`` turns below its top; see :func:`prefix_trie` for the columns.

    A sequence that reaches the cut goes on below it.  Above it one representative of all that share the prefix goes on,
    the least conversation, tagged with the prefix's name; sequences that end before the cut go on above it.
    """
    met = blocks.select("conv", (F.col("block") * half).alias("low"), "name", F.col("bytes").alias("last"))
    met = stored(
        sequences.join(met, ["conv", "low"], "left").withColumn(
            "cut", F.when(F.col("name").isNotNull(), _name("top", "name"))
        ),
        "trie-cut",
    )
    columns = ("top", "conv", "low", "weight", "tag", "bytes")
    short = met.filter(F.col("cut").isNull()).select(*columns)
    long = met.filter(F.col("cut").isNotNull())
    lower = long.select(F.col("cut").alias("top"), "conv", (F.col("low") + half).alias("low"), "weight", "tag", "bytes")
    upper = long.groupBy("cut").agg(
        F.first("top").alias("top"),
        F.min("conv").alias("conv"),
        F.first("low").alias("low"),
        F.sum("weight").alias("weight"),
        F.first("last").alias("bytes"),
    )
    return short.unionByName(lower).unionByName(upper.withColumnRenamed("cut", "tag").select(*columns))


def _level(depth: Column, levels: int) -> Column:
    """How often two divides a depth: the pass whose cuts it is one of, counted from below.  The root is above all."""
    return F.when(depth == 0, levels).otherwise(F.bit_count(depth.bitwiseAND(-depth) - 1))


def _total(parts: DataFrame) -> DataFrame:
    return parts.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _grafted(nodes: DataFrame, edges: list[DataFrame], levels: int) -> DataFrame:
    """``leaves`` and ``saved`` of every node, summed over its whole subtree.

    ``edges[n]`` leads from a node to that ``2**n`` turns above it, for every node of a depth that ``2**n`` divides.
    """
    own = nodes.select("node", "level", F.when(F.col("children") == 0, 1).otherwise(0).cast("long").alias("leaves"), "saved")
    # Within windows: a node of level n takes the windows of 2**m depths that hang 2**m below it, for all m < n.
    windows: list[DataFrame] = []
    grafts: list[DataFrame] = []
    for n in range(levels + 1):
        of_level = own.filter(F.col("level") == n).select("node", "leaves", "saved")
        known = of_level.select("node")
        taken = [g.join(known, "node", "left_semi") for g in grafts]
        windows.append(stored(_total(_union([of_level, *taken])), "trie-window"))
        if n < levels:
            # The cut edges: from this level to the tops of their segments, which are of higher levels.
            up = edges[n].filter("cut").select(F.col("tag").alias("node"), "top")
            up = windows[n].join(up, "node").select(F.col("top").alias("node"), "leaves", "saved")
            grafts.append(stored(_total(up), "trie-graft"))
    # Over windows: from the highest level down, a node takes the whole subtrees at the end of its own window.
    done = [windows[levels]]
    for n in range(levels - 1, -1, -1):
        down = edges[n].filter("NOT cut").select(F.col("tag").alias("node"), "top")
        later = _union(done).join(down, "node").select(F.col("top").alias("node"), "leaves", "saved")
        done.append(stored(_total(windows[n].unionByName(later)), "trie-total"))
    return _union(done)


def _ends(ends: DataFrame) -> DataFrame:
    """``node`` and SHA-256 of the ids of the conversations that end there, in order.

    Ids are first joined in pieces, by many tasks; one task then reads the pieces of a node in order and holds one.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("node", F.floor(F.col("conv") / PIECE_IDS).alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(_hashed, "node binary, ends string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = running = None
    names = ["node", "ends"]
    for batch in batches:
        done: list[tuple] = []
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids"), strict=True):
            if key != node:
                if running is not None:
                    done.append((node, running.hexdigest()))
                node, running = key, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.as_py().encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names)
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], names)


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of conversations as one row per node, by ``conv_id``, its smallest member, and ``depth``.

    ``turns`` has ``conv``, ``pos`` from 0 without gaps, ``name`` and ``bytes``; ``lengths`` has ``conv`` and ``length``
    of all of them, the turnless too.  ``parent_conv_id`` is null at the root.  ``n_convs`` counts members, ``n_children``
    children, ``n_leaves`` the childless nodes of the subtree; ``saved_tokens`` sums each node's members but one, times
    the bytes of its last turn, over the subtree; ``ends_sha256`` hashes the sorted ids of the conversations that end at
    the node.  Equal conversations end at one node.  Without conversations there is no row.
    """
    longest = lengths.agg(F.max("length")).collect()[0][0]
    levels = max(int(longest or 0).bit_length(), 1)
    blocks = _blocks(turns, levels)
    # A sequence: the node at its top, a conversation that goes through it, the depth of the top, how many conversations
    # it stands for, and the node right after its end that it leads to, if it was cut there, with that one's last bytes.
    sequences = lengths.select(
        F.lit(bytearray(ROOT)).alias("top"),
        "conv",
        F.lit(0).cast("long").alias("low"),
        F.lit(1).cast("long").alias("weight"),
        F.lit(None).cast("binary").alias("tag"),
        F.lit(None).cast("long").alias("bytes"),
    )
    edges: list[DataFrame] = [sequences] * levels
    for n in range(levels - 1, -1, -1):
        sequences = stored(_cut(sequences, blocks[n], 2**n), "trie-sequences")
        tagged = sequences.filter(F.col("tag").isNotNull())
        # Tops that are of a higher level than n lead to nodes just cut; the others to later segments' tops.
        edges[n] = tagged.select("tag", "top", (_level(F.col("low"), levels) > n).alias("cut"))
    # Every sequence is now a node: it leads to a child, or a conversation ends there.
    tagged = F.col("tag").isNotNull()
    nodes = sequences.groupBy(F.col("top").alias("node")).agg(
        F.min("conv").alias("conv_id"),
        F.first("low").alias("depth"),
        F.sum("weight").alias("n_convs"),
        F.count("tag").alias("children"),
    )
    led = sequences.filter(tagged).select(F.col("tag").alias("node"), F.col("top").alias("parent"), "bytes")
    nodes = nodes.join(led, "node", "left").withColumn("level", _level(F.col("depth"), levels))
    saved = (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))
    nodes = stored(nodes.withColumn("saved", saved), "trie-nodes")
    parents = nodes.filter(F.col("children") > 0).select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = _ends(sequences.filter(~tagged).select(F.col("top").alias("node"), "conv"))
    whole = nodes.drop("saved").join(_grafted(nodes, edges, levels), "node").join(ends, "node", "left")
    whole = whole.join(parents, "parent", "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


#: CRC-32 bit by bit: a byte is mixed in, then eight shifts follow, marked -1.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    string_split(CAST(conv AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END))"""

ORACLE = f"""
WITH turns AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv, conv - conv % 5 AS base, {_CRC} % 9 AS head FROM (SELECT DISTINCT conv FROM turns)),
own AS (
  SELECT conv, list({{'role': role, 'text': text}} ORDER BY pos) AS seq FROM turns GROUP BY conv),
rebuilt AS (
  SELECT c.conv, list_concat(coalesce(b.seq[:c.head], []), o.seq[c.head + 1:]) AS seq
  FROM convs c JOIN own o ON o.conv = c.conv LEFT JOIN own b ON b.conv = c.base),
members AS (SELECT conv, seq, unnest(range(len(seq) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT depth, seq[:depth] AS prefix, min(conv) AS conv_id, count(*) AS n_convs,
         string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (len(seq) = depth) AS ends,
         CASE WHEN depth > 0 THEN (count(*) - 1) * strlen(any_value(seq)[depth].text) ELSE 0 END AS saved
  FROM members GROUP BY depth, seq[:depth]),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[:n.depth - 1]),
counted AS (
  SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l
  LEFT JOIN (SELECT depth - 1 AS depth, prefix[:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2) c
    ON c.depth = l.depth AND c.prefix = l.prefix),
above AS (
  SELECT top, prefix[:top] AS prefix, sum(saved) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS top FROM counted) GROUP BY top, prefix[:top])
SELECT conv_id, CAST(c.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children,
       CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ends, '')) AS ends_sha256
FROM counted c JOIN above a ON a.top = c.depth AND a.prefix = c.prefix
"""


@query("op12_conversation_trie", ORACLE)
def op12_conversation_trie(spark, sf):
    return prefix_trie(*rebuilt(numbered_turns(load(spark, sf, "conversations"))))
