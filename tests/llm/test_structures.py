"""Clustering, the conversation trie and fingerprints against plain versions, on given and awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import CLASH, EDGES, SF, clashing, edges, given, same
from typeloom.llm import centroids, phrases, trie
from typeloom.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# Centroid clustering


def plain_clusters(vectors, k, rounds, dimensions):
    kept = []
    for vec_id, x in vectors:
        if x is not None and len(x) == dimensions and all(c is not None and math.isfinite(c) for c in x):
            most = centroids.widest(dimensions)
            kept.append((vec_id, [math.floor(max(min(64.0 * c, most), -most)) for c in x]))
    kept.sort(key=lambda r: (sha("1:" + ("" if r[0] is None else str(r[0]))), r[1]))
    means = [list(v) for _, v in kept[:k]]

    def assigned():
        found = []
        for _, v in kept:
            away = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in means]
            found.append((min(away), away.index(min(away))))
        return found

    for _ in range(rounds):
        own = assigned()
        for j in range(len(means)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if mine:
                means[j] = [sum(c) // len(mine) for c in zip(*mine)]
    own = assigned()
    of = Counter()
    for d, c in own:
        of[c] += d
    whole = sum(of.values())
    names = [sha(",".join(map(str, c))) for c in means]
    return sorted(((i, c, d, of[c], whole, names[c]) for (i, _), (d, c) in zip(kept, own)), key=same)


AWKWARD_VECTORS = [
    (None, [0.5, -0.25, 1e30]),
    (None, [0.5, -0.25, 1e30]),
    (1, None),
    (2, []),
    (3, [1.0, 2.0]),
    (4, [1.0, 2.0, float("nan")]),
    (5, [1.0, None, 3.0]),
    (6, [float("-inf"), 1.0, 1.0]),
    (7, [-1e30, 0.0, 0.0]),
]


def found_clusters(df, **options):
    found = centroids.cluster(df, **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, found.collect()), key=same)


def test_clusters(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in given("embeddings")]
    frame = clashing(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), *CLASH, "cluster", "v", "w", "count")
    assert found_clusters(frame) == plain_clusters(vectors, 16, 3, 64)


def test_awkward_clusters(spark):
    rng = random.Random(3)
    # A third of all vectors are equal, many lie between centroids, and ids repeat.
    vectors = AWKWARD_VECTORS + [(n % 50, [rng.randrange(4) / 64, rng.randrange(4) / 64, 0.0]) for n in range(200)]
    vectors += [(1000 + n, [0.25, 0.25, 0.25]) for n in range(100)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for k, rounds in ((5, 6), (1, 2), (400, 2), (3, 0)):
        assert found_clusters(frame, k=k, rounds=rounds, dimensions=3) == plain_clusters(vectors, k, rounds, 3)
    assert found_clusters(frame.filter("size(embedding) < 3"), dimensions=3) == []


def test_bounds_save_distances_and_lose_none():
    rng = np.random.default_rng(1)
    means = rng.integers(-400, 400, (12, 8))
    v = means[rng.integers(0, 12, 3000)] + rng.integers(-40, 40, (3000, 8))
    history = [v[:12].copy()]
    own, near = centroids._first(v, history[0])
    seen = np.zeros(near.shape, np.int8)
    counts = []
    for _ in range(12):
        history.append(np.stack([v[own == j].sum(0) // max((own == j).sum(), 1) for j in range(12)]))
        own, n = centroids.reassign(v, history, centroids.displacements(history), own, near, seen)
        counts.append(n)
        exact = ((v[:, None, :] - history[-1][None]) ** 2).sum(2)
        assert (own == exact.argmin(1)).all()
    assert counts[-1] < 0.1 * near.size


def test_displacement_is_not_the_sum_of_moves():
    # A centroid that goes and comes back has not moved: its bounds are tight again.
    there, back = np.array([[0, 0], [100, 0]]), np.array([[0, 0], [400, 0]])
    moved = centroids.displacements([there, back, there])
    assert moved[0].tolist() == [0, 0] and moved[1].tolist() == [0, 300]


# Conversation trie


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[:2], t[2].encode(), t[3].encode()))] for c, ts in turns.items()}
    made = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(math.fmod(c, 5)), [])
        made[c] = base[:h] + seq[h:]
    return made


def plain_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (
            (who[0], len(p), members[p[:-1]][0] if p else None, len(who), children[p], leaves[p], saved[p], sha(",".join(map(str, ends[p]))))
            for p, who in members.items()
        ),
        key=same,
    )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def found_trie(spark, rows):
    frame = clashing(spark.createDataFrame(rows, TURNS), *CLASH, "top", "name", "node", "pos", "low", "base")
    found = trie.prefix_trie(*trie.rebuilt(trie.numbered_turns(frame)))
    assert found.columns == TRIE
    return sorted(map(tuple, found.collect()), key=same)


def test_trie_of_given_conversations(spark):
    found = QUERIES["op12_conversation_trie"](spark, SF).collect()
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in given("conversations")]
    assert sorted(map(tuple, found), key=same) == plain_trie(plain_rebuilt(rows))


def test_awkward_trie(spark):
    rng = random.Random(5)
    rows = [(None, 0, "user", "lost"), (3, None, None, None), (3, 1, "", ""), (3, 1, "", ""), (3, None, "user", "é😀")]
    rows += [(-7, n, "user", f"t{n % 2}") for n in range(11)] + [(-5, 0, "a", "b" * 100_000)]
    for conv in range(10, 70):
        rows += [(conv, n, rng.choice("ab"), rng.choice(["x", "yy", "zü"])) for n in range(rng.randrange(1, 23))]
    # A third of all are one conversation, and another is long.
    rows += [(conv, n, "user", "same") for conv in range(100, 200, 5) for n in range(9)]
    rows += [(500, n, "user", str(n // 2)) for n in range(130)]
    rng.shuffle(rows)
    assert found_trie(spark, rows) == plain_trie(plain_rebuilt(rows))


@pytest.mark.parametrize("rows, n", [([], 0), ([(None, 1, "a", "b")], 0), ([(1, 0, "user", "hi")], 1)])
def test_small_tries(spark, rows, n):
    # crc32('1') % 9 is 7: the only turn goes, as its base is absent.
    assert len(found_trie(spark, rows)) == n


# Fingerprints


def plain_starts(names):
    """Where phrases start, name by name."""
    n = len(names)
    starts, runs = set(), set()
    i = 0
    while i < n:
        j = i
        while j + 1 < n and names[j + 1] == names[i]:
            j += 1
        if j > i:
            starts |= {i, j + 1}
            runs |= set(range(i, j + 1))
        i = j + 1
    starts |= {0}
    starts.discard(n)

    def toss(value, before):
        differ = value ^ before
        bit = (differ & -differ).bit_length() - 1 if differ else 0
        return 2 * bit + (value >> bit & 1 if differ else value & 1)

    labels = [toss(v, 0 if k in starts else names[k - 1]) for k, v in enumerate(names)]
    for _ in range(2):
        labels = [toss(v, 0 if k in starts else labels[k - 1]) for k, v in enumerate(labels)]
    least = {
        k
        for k in range(1, n - 1)
        if labels[k - 1] > labels[k] < labels[k + 1] and k not in starts and k + 1 not in starts and k not in runs
    }
    return sorted(starts | least)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 50, 400])
def test_parse(size):
    rng = random.Random(size)
    for letters in (1, 2, 3, 30):
        names = [rng.randrange(1, letters + 1) for _ in range(size)]
        for kind in (np.uint32, np.uint64):
            heads = np.zeros(size, bool)
            heads[0] = True
            found = np.flatnonzero(phrases._starts(np.array(names, kind), heads)).tolist()
            assert found == plain_starts(names)
            # Phrases get fewer on every level, and a stretch without a run is cut often.
            assert len(found) <= -(-2 * size // 3) or size < 4 or letters < 4


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_equal_substrings_share_phrases():
    rng = random.Random(1)
    body = words(rng, 400)
    shifted = words(rng, 7) + " " + body[5:]
    other = words(rng, 400)
    a, b, c = phrases.fingerprints([body, shifted, other])
    assert phrases.likeness(a, b) > 0.85 and phrases.likeness(a, c) < 0.05
    # Alone or together, in any order.
    assert phrases.fingerprints([other, "", body]) == [c, b"", a] and phrases.fingerprints([body]) == [a]


def test_likeness_estimates_common_phrases():
    rng = random.Random(2)
    left, shared, right = words(rng, 300), words(rng, 600), words(rng, 300)
    a, b = phrases.fingerprints([left + shared, shared + right])
    assert 0.3 < phrases.likeness(a, b) < 0.7
    few = np.array([1, 5, 9], ">u4").tobytes()
    assert phrases.likeness(few, np.array([5, 9, 11], ">u4").tobytes()) == 0.5
    assert phrases.likeness(b"", b"") == 1 and phrases.likeness(few, b"") == 0


def plain_prints(rows):
    """Contract columns of (doc_id, text) rows; fingerprints one text at a time."""
    rows = [(i, t or "") for i, t in rows]
    digest = lambda t: hashlib.md5(("=" + t).encode()).digest()
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), digest(r[1])))
    made = []
    for n, (doc_id, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = (phrases.fingerprints([t])[0] for t in (text, edited, after))
        made.append((doc_id, len(text), sha(edited), a.hex(), b.hex(), phrases.likeness(a, b), phrases.likeness(a, c)))
    return sorted(made, key=same)


PRINTS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_fingerprints_of_given_documents(spark):
    found = QUERIES["op13_document_fingerprints"](spark, SF)
    assert found.columns == PRINTS
    rows = sorted(map(tuple, found.collect()), key=same)
    assert rows == plain_prints([(r["doc_id"], r["text"]) for r in given("documents")])
    real = [r for r in rows if r[1] > 300]
    assert sum(r[5] > 0.2 for r in real) > 0.95 * len(real)
    assert sum(r[6] < 0.1 for r in real) > 0.9 * len(real)


def test_fingerprints_of_awkward_documents(spark):
    rows = [(r[0], r[1]) for r in EDGES] + [(9, "ab" * 5000 + "\n" * 300), (9, "aaa"), (10, "ab"), (11, "é")]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string"), *CLASH, "part", "kind", "edited", "after")
    found = sorted(map(tuple, phrases.fingerprinted(frame).collect()), key=same)
    assert found == plain_prints(rows)


def test_fingerprints_of_few_documents(spark):
    assert phrases.fingerprinted(edges(spark, [])).count() == 0
    (row,) = phrases.fingerprinted(edges(spark, [EDGES[5]])).collect()
    assert row["n_chars"] == 13 and row["edited_sha256"] == sha("one two tone ") and row["near_next"] == 1
