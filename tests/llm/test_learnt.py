"""Operators whose results rest on a model or a search, and the pipeline."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import CLASH, EDGES, SCHEMA, SF, clashing, edges, given, same
from typeloom.llm import linedup, neardup, quality, toxicity
from typeloom.llm.graph import components
from typeloom.llm.queries import QUERIES
from typeloom.session import scratch, shared_folder

# Quality rules


def brute_figures(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    windows = Counter(tuple(words[n : n + 8]) for n in range(len(words) - 7))
    repeated = {n + k for n in range(len(words) - 7) if windows[tuple(words[n : n + 8])] > 1 for k in range(8)}
    marks = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), marks, sum(c - 1 for c in Counter(lines).values()), len(repeated)


def test_text_figures():
    rng = random.Random(1)
    texts = [r["text"] for r in given("documents")] + [r[1] or "" for r in EDGES]
    texts += ["".join(rng.choices(" ab#\n\x0b\x85\x1c ", k=rng.randint(0, 60))) for _ in range(2000)]
    for text in texts:
        assert quality.text_figures(text) == brute_figures(text)


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(0)
    counts = np.zeros((6, 6, 6), np.int64)
    np.add.at(counts, tuple(rng.zipf(1.5, (3, 4000)) % 5), 1)
    levels = quality.kneser_ney(counts, 3, 6)

    # By the book: discounted share of the longest history seen, and the rest by the shorter one.
    def tables(order):
        table = counts
        for _ in range(3 - order):
            table = (table > 0).sum(axis=0)
        return table

    def chance(gram):
        if not gram:
            return 1 / 6
        table = tables(len(gram))
        n = [(table == k).sum() for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)] if all(n) else [0.5, 1, 1.5]
        if min(d) <= 0 or any(x > k + 1 for k, x in enumerate(d)):
            d = [0.5, 1, 1.5]
        row = table[gram[:-1]]
        if not row.sum():
            return chance(gram[1:])
        rest = sum(d[min(c, 3) - 1] for c in row if c) / row.sum()
        own = table[gram]
        return (own - (d[min(own, 3) - 1] if own else 0)) / row.sum() + rest * chance(gram[1:])

    parts = [
        (quality.gram_hash(0, n, codes), logs, backs) for n, (codes, logs, backs) in enumerate(levels)
    ]
    model = quality.Model(*(np.concatenate(c) for c in zip(*parts, strict=True)), {"x": 0})
    monkey = quality.SYMBOLS
    quality.SYMBOLS = 6
    try:
        for a in range(6):
            for b in range(6):
                codes = np.array([a * 36 + b * 6 + c for c in range(6)])
                got = np.exp(model.logs(0, codes, 3))
                assert got.sum() == pytest.approx(1)
                assert got == pytest.approx([chance((a, b, c)) for c in range(6)])
    finally:
        quality.SYMBOLS = monkey


def test_grams_of_many_texts():
    texts = ["", "Ab", "", "é1, x", "\n"]
    together, ends = quality.grams(texts)
    apart = [quality.grams([t])[0] for t in texts]
    assert ends.tolist() == [0, 2, 2, 7, 8]
    assert together.tolist() == [c for a in apart for c in a.tolist()]


@pytest.fixture(scope="module")
def judged(spark):
    return {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, SF).collect()}


def test_quality_of_the_documents(judged):
    for r in given("documents"):
        row = judged[r["doc_id"]]
        figures = brute_figures(r["text"])
        assert tuple(row[n] for n in quality.FIGURES) == figures
        assert row["base_failed"] == (figures[0] < 20 or 100 * figures[4] > 30 * figures[0])
        assert not (row["base_failed"] and row["kept"])
    passed = [r for r in judged.values() if not r["base_failed"]]
    assert sum(r["kept"] for r in passed) > 0.8 * len(passed)


def test_perplexity_rejects_noise(spark):
    rng = random.Random(2)
    docs = [(r["doc_id"], r["text"], r["lang"], "s", 0) for r in given("documents")]
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2000)) for _ in range(5)]
    flat = [" ".join("%d" % (n * 7919 % 97) for n in range(k, k + 500)) for k in range(5)]
    docs += [(10_000 + n, t, "en", "s", 0) for n, t in enumerate(noise + flat)]
    frame = spark.createDataFrame(docs, SCHEMA)
    model = quality.train(frame)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(quality.score_texts(frame, model, ["doc_id"])).collect()}
    assert not any(kept[10_000 + n] for n in range(10))


def test_quality_of_awkward_rows(spark):
    kept = quality.keep_good(clashing(edges(spark), *CLASH))
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(kept.columns) == 5 + len(CLASH)
    assert {r["doc_id"] for r in kept.collect()} <= {7}
    assert quality.keep_good(edges(spark, [])).count() == 0


# Lines


def brute_cuts(rows):
    """(doc_id, text) in order of id; only ids that occur once."""
    docs = {i: (t or "").split("\n") for i, t in rows}
    bare = {i: [x.strip(" \t\r\x0b\x0c") for x in lines] for i, lines in docs.items()}
    held = {}
    for i in sorted(docs):
        for x in bare[i]:
            if x:
                held.setdefault(x, []).append(i)
    out = {}
    for i, lines in bare.items():
        gone, earlier = set(), []
        for other in sorted({held[x][0] for x in lines if x and held[x][0] != i}):
            blocks = linedup.common_blocks(lines, [x for x in bare[other] if x], [len(x) for x in lines])
            if blocks:
                earlier.append(other)
            gone |= {n for a, b in blocks for n in range(a, b)}
        out[i] = ("\n".join(x for n, x in enumerate(docs[i]) if n not in gone), len(gone), sorted(earlier))
    return out


def test_lines_of_the_documents(spark):
    import hashlib

    wanted = brute_cuts([(r["doc_id"], r["text"]) for r in given("documents")])
    found = {r["doc_id"]: r for r in QUERIES["op7_line_dedup"](spark, SF).collect()}
    assert sum(n for _, n, _ in wanted.values()) > 20
    for i, (text, n, earlier) in wanted.items():
        assert (found[i]["n_removed"], found[i]["earlier"]) == (n, earlier)
        assert found[i]["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_line_cases(spark):
    line = lambda n: f"line {n} " + "x" * 60
    common = "a line that all have " + "y" * 100
    rows = [(n, "\n".join([line(10 * n + k) for k in range(3)] + [common])) for n in range(8)]
    rows += [(20, "\n".join([line(1), " ", line(2), "own", line(11), line(12) + " "])), (21, line(0)), (22, None), (23, "")]
    rows += [(30 + n, "\n".join([line(50), line(51), line(52)])) for n in range(6)]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string"), *CLASH, "lines", "blocks", "earlier")
    found = {r["row"]["doc_id"]: (r["kept"], r["n_removed"], r["earlier"]) for r in linedup.cut_lines(frame).collect()}
    wanted = brute_cuts(rows)
    assert found == wanted
    # A long line goes however many have it; a blank line goes with the block around it; one short line stays.
    assert found[3][1] == 1 and found[20] == ("own", 5, [0, 1]) and found[21][1] == 0
    assert all(found[30 + n] == ("", 3, [5]) for n in range(6))
    kept = linedup.cut_documents(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {
        i: t for i, t in ((i, None if i == 22 else wanted[i][0]) for i, _ in rows) if i < 30
    }


def test_frequent_passages_are_cut(spark):
    passage = " ".join(f"word{n}" for n in range(50))
    rows = [(n, f"first of {n}\n{passage}\nlast of {n}") for n in range(70)]
    rows += [(100 + n, f"{passage}\n{passage}\nend {n}") for n in range(3)]
    found = {r["row"]["doc_id"]: r for r in linedup.cut_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0]["kept"] == rows[0][1]
    assert all(found[n]["kept"] == f"first of {n}\nlast of {n}" and found[n]["earlier"] == [0] for n in range(1, 70))


def test_blocks_of_lines_first_held_alone(spark):
    line = lambda n, size: f"{n} ".ljust(size, "z")
    pair, tail = [line("a", 53), line("b", 47)], [line(f"t{n}", size) for n, size in enumerate((60, 60, 30))]
    rows = [(0, [pair[0]]), (1, [pair[1]]), (2, [*pair, "two"]), (3, ["three", *pair])]
    # The last line of a block is too short for a run that starts there, and another document holds the others first.
    rows += [(4, tail[:2]), (5, [*tail, "five"]), (6, ["six", *tail]), (7, [pair[0], "between", pair[1]])]
    frame = spark.createDataFrame([(n, "\n".join(lines)) for n, lines in rows], "doc_id long, text string")
    found = {r["row"]["doc_id"]: (r["kept"], r["earlier"]) for r in linedup.cut_lines(frame).collect()}
    assert found[2] == ("\n".join([*pair, "two"]), []) and found[3] == ("three", [2])
    assert found[5] == ("\n".join([tail[2], "five"]), [4]) and found[6] == ("six", [4, 5])
    assert found[7][1] == []


def test_texts_without_blocks_are_not_shuffled(spark):
    rng = random.Random(5)
    line = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1000))
    common = line()
    rows = [(n, "\n".join([line(), *[common] * (n < 10), line(), line()])) for n in range(300)]
    rows += rows[:20] + [(None, rows[3][1]), (None, rows[200][1]), (None, None)]
    context = spark.sparkContext
    folders = list(context._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {f for d in folders for f in Path(str(d)).rglob("shuffle_*.data")}
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key, None) for key in limits}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    assert frame.count() == len(rows)
    try:
        for key in limits:
            spark.conf.set(key, "-1")
        there = files()
        found = linedup.cut_lines(frame)
        cut = found.collect()
        written = sum(f.stat().st_size for f in files() - there)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert written < 0.3 * sum(len(t or "") for _, t in rows)
    assert Counter((r["row"]["doc_id"], r["row"]["text"]) for r in cut) == Counter(rows)
    # A missing id is the latest: of the two texts without one, all lines are in earlier documents.
    wanted = {i: (1, [0]) if 0 < i < 10 else (0, []) for i in range(300)}
    for r in cut:
        i, text = r["row"]
        if i is not None:
            assert (r["n_removed"], r["earlier"]) == wanted[i]
        elif text is not None:
            assert r["kept"] == ""
        else:
            assert (r["kept"], r["n_lines"], r["n_removed"], r["earlier"]) == ("", 1, 0, [])


def test_marks_lose_no_id(spark):
    rows = spark.range(0, 40_000, 1, 3).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("id"), F.col("id").alias("n"))
    ids = rows.filter("n % 2 = 0").select("id")
    found = {r["n"]: r["marked"] for r in linedup._marked(rows, ids).select("n", "marked").collect()}
    assert len(found) == 40_000 and all(found[n] for n in range(0, 40_000, 2))
    assert sum(found[n] for n in range(1, 40_000, 2)) < 200
    assert not any(r["marked"] for r in linedup._marked(rows, ids.limit(0)).collect())


@pytest.mark.parametrize("seed", range(3))
def test_runs_cover_every_block(seed):
    rng = random.Random(seed)
    sizes = [rng.choice((1, 5, 20, 47, 53, 60, 99, 100, 130)) for _ in range(60)]
    found = linedup.runs(sizes)
    assert all(sum(sizes[a:b]) >= linedup.BLOCK_CHARS for a, b in found)
    for a in range(60):
        for b in range(a + 1, 61):
            if sum(sizes[a:b]) >= linedup.BLOCK_CHARS:
                assert {n for s, e in found if a <= s and e <= b for n in range(s, e)} == set(range(a, b))


def test_awkward_lines(spark):
    found = linedup.cut_documents(edges(spark)).collect()
    # The long text of 5 is that of 4.
    assert sorted((tuple(r) for r in found), key=same) == sorted((r for r in EDGES if r[0] != 5), key=same)
    assert linedup.cut_documents(edges(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_patience(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(10))] for _ in range(2))
        if rng.random() < 0.5:
            b = a[: rng.randrange(len(a) + 1)] + b + a[rng.randrange(len(a) + 1) :]
        found = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        once = [x for x in a if a.count(x) == b.count(x) == 1]
        if len(set(a)) == len(a) and len(set(b)) == len(b) and [x for x in b if x in a] == once:
            assert len(found) == len(once)


# Near copies


def brute_share(a, b):
    """Longest common subsequence of two labelled sequences over all of both, by dynamic programming."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for n, y in enumerate(b):
            last, row[n + 1] = row[n + 1], last + 1 if x == y else max(row[n + 1], row[n])
    return row[-1] / (len(a) + len(b) - row[-1])


def labelled(text):
    words = text.lower().split()
    seen, out = Counter(), []
    for n in range(max(len(words) - 4, min(len(words), 1))):
        shingle = tuple(words[n : n + 5])
        out.append((shingle, seen[shingle]))
        seen[shingle] += 1
    return out


def copies(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def brute_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    shingles = [labelled(t) for t in texts]
    parent = list(range(len(texts)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i in range(len(texts)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(set(a) & set(b)) >= 0.6 * len(a):
                if brute_share(a, b) >= 0.8 - 1e-12:
                    parent[root(i)] = root(j)
    groups = {}
    for i, t in rows:
        groups.setdefault(root(texts.index(t or "")), []).append(i)
    names = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    brute_classes.names = sorted(names.values(), key=same)
    return sorted(((i, names[g], len(ids)) for g, ids in groups.items() for i in ids), key=same)


def test_near_copies(spark):
    rng = random.Random(7)
    rows = [(r["doc_id"], r["text"]) for r in given("documents") if len(r["text"]) < 3000]
    base = [t for _, t in rows if len(t) > 800][:6]
    for n in range(60):
        text = rng.choice(base)
        rows.append((1000 + n, copies(rng, text, rng.randint(0, len(text.split()) // 25))))
    # A chain whose ends are far apart, blocks exchanged, and words before others.
    text = base[0]
    for n in range(12):
        rows.append((2000 + n, text))
        text = copies(rng, text, len(text.split()) // 60)
    words = base[1].split()
    rows += [(3000, " ".join(words[len(words) // 2 :] + words[: len(words) // 2])), (3001, "one two"), (3002, "One two")]
    rows += [(r[0], r[1]) for r in EDGES if r[0] not in (4, 5, 8)]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string"), *CLASH, "comp", "n")
    wanted = brute_classes(rows)
    found = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(frame).collect()), key=same)
    assert found == wanted
    kept = neardup.first_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=same) == brute_classes.names
    assert max(w[2] for w in wanted) > 10


def test_a_group_with_many_centres(spark):
    # All copies of one text differ in so many places that links are few, yet most share a sketch.
    rng = random.Random(9)
    text = " ".join(f"word{n}" for n in range(150))
    rows = [(n, copies(rng, text, 2 + n % 4)) for n in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(frame).collect()), key=same)
    assert found == brute_classes(rows)


def test_no_near_copies(spark):
    assert neardup.classes(edges(spark, [])).count() == 0
    assert neardup.first_of_each(edges(spark, EDGES[:3])).count() == 2


def test_aligned_share():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.sample(range(1000), rng.randint(1, 60))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.randrange(1000, 10**6) for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.3:
            k = rng.randrange(len(b) + 1)
            b = b[k:] + b[:k]
        if b:
            wanted = brute_share(a, b)
            found = neardup.aligned_share(np.array(a, np.uint64), np.array(b, np.uint64))
            assert found == pytest.approx(wanted) if found else wanted < 0.8 or len(a) < 5


def test_components(spark):
    rng = random.Random(4)
    links = [(n, n + 1) for n in range(200)] + [(1000, n) for n in range(1001, 1050)]
    links += [(2000 + rng.randrange(100), 2000 + rng.randrange(100)) for _ in range(60)]
    parent = {x: x for link in links for x in link}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted((n, root(n)) for n in linked)


# Toxicity


def test_toxicity_held_out(spark):
    found = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = given("labels", "/root/testdata/sf0.01")
    held = [(r["toxic"], found[r["doc_id"]]) for r in labels if found[r["doc_id"]]["held_out"]]
    assert len(held) > 80 and all(0 <= f["score"] <= 1 for _, f in held)
    toxic, clean = ([f["score"] for y, f in held if y == want] for want in (1, 0))
    better = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert better > 0.95
    assert sum(f["predicted"] == y for y, f in held) > 0.95 * len(held)


def test_pairs_of_terms_count():
    rows = []
    for n in range(400):
        a, b = n % 2, n // 2 % 2
        rows.append(([1] * a + [2] * b + [3 + n % 7], a & b))
    machine = toxicity.fit(np.arange(1, 10), rows)
    place = {t: n for n, t in enumerate(machine.terms.tolist())}
    product = float(machine.vectors[place[1]] @ machine.vectors[place[2]])
    linear = machine.weights[[place[1], place[2]]]
    assert machine.constant + linear.sum() + product > 0 > machine.constant + linear.max()
    assert product > 0.1


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, None), (6, 1), (6, 0), (7, 0), (None, 1)], "doc_id long, toxic int")
    frame = clashing(edges(spark), *CLASH, "toxic", "pick", "terms", "score")
    machine = toxicity.train(frame, labels)
    scores = toxicity.score_texts(frame, machine).collect()
    assert len(scores) == len(EDGES) and all(0 <= r["score"] <= 1 for r in scores)
    # Nothing to learn from: every text gets the same score.
    for rows in ([], [(7, 0)], [(6, 1)]):
        machine = toxicity.train(frame, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert len({r["score"] for r in toxicity.score_texts(frame, machine).collect()}) == 1


# Pipeline


def test_pipeline(spark, judged):
    columns = list(given("documents")[0])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.columns[:5] == columns
        kept.append((name, before, after))
    (_, before, after), (_, lines_in, lines_out), (_, near_in, near_out), (_, leaks_in, leaks_out), (_, mix_in, mix_out) = kept
    assert set(after) == {i for i, r in judged.items() if r["kept"]}
    cuts = brute_cuts([(i, r["text"]) for i, r in lines_in.items()])
    assert {i: r["text"] for i, r in lines_out.items()} == {i: t for i, (t, n, _) in cuts.items() if not n or t.strip()}
    classes = brute_classes([(i, r["text"]) for i, r in near_in.items()])
    assert set(near_out) == {name for _, name, _ in classes}
    from tests.llm.test_exact import brute_overlaps

    leaks = brute_overlaps([(i, r["text"]) for i, r in leaks_in.items()], [(r["item_id"], r["text"]) for r in given("benchmark")])
    assert leaks and set(leaks_out) == set(leaks_in) - {x[0] for x in leaks}
    assert set(mix_out) == set(mix_in)
    found = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(mix_out)


def test_pipeline_of_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (EDGES, []):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, clashing(edges(spark, rows), *CLASH), str(tmp_path))
            assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(docs.columns)
            assert docs.count() <= len(rows)


def test_near_copies_far_from_their_centre(spark, monkeypatch):
    """Groups in which most copies are no link of the text they come from, but of others changed further."""
    rng = random.Random(13)
    text = " ".join(f"word{n}" for n in range(150))
    rows = [(0, text)]
    for n in range(5):
        child = copies(rng, text, 4 + n)
        rows += [(100 * n + 100 + k, copies(rng, child, 1)) for k in range(6)]
        rows += [(100 * n + 150 + k, " ".join(child.split()[: 125 + 4 * k])) for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute_classes(rows)
    for rounds in (2, 1):
        monkeypatch.setattr(neardup, "ROUNDS", rounds)
        found = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(frame).collect()), key=same)
        assert found == wanted


def test_stages_leave_no_texts_behind(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    texts = ["\n".join(" ".join(word() for _ in range(12)) for _ in range(30)) for _ in range(120)]
    # Near copies, and texts with a passage in common, whose differences go through the later rounds.
    texts += [t.replace(t[100:108], word()) for t in texts[:60]] + [t[: len(t) * 3 // 4] + u[-700:] for t, u in zip(texts, texts[1:60], strict=False)]
    frame = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t in enumerate(texts)], SCHEMA)
    shared = Path(shared_folder(spark))
    for stage in (quality.keep_good, linedup.cut_documents, neardup.first_of_each):
        before = set(shared.iterdir())
        assert stage(frame).count()
        left = [p for p in set(shared.iterdir()) - before if not p.name.startswith("ngram-model")]
        size = sum(f.stat().st_size for p in left for f in p.rglob("*.parquet"))
        assert size < 0.15 * sum(map(len, texts)), [p.name for p in left]


def test_verdicts_meet_their_rows(spark):
    docs = [(r["doc_id"], r["text"], r["lang"], "s", n) for n, r in enumerate(given("documents"))]
    docs += [(None if n % 3 else i, t, ("de", None, "")[n % 3], s, n) for n, (i, t, _, s, _) in enumerate(docs[:200])]
    docs += docs[:50] + EDGES
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3).cache()
    scored = quality.score_texts(frame, quality.train(frame), ["doc_id", "text", "lang", "n_chars"])
    wanted = quality.judge(scored).filter("kept").select("doc_id", "text", "lang", "n_chars").collect()
    found = quality.keep_good(frame).select("doc_id", "text", "lang", "n_chars").collect()
    assert 0 < len(wanted) < len(docs) and Counter(found) == Counter(wanted)


def test_scratch_goes_with_its_block(spark):
    shared = Path(shared_folder(spark))
    before = set(shared.iterdir())
    with pytest.raises(ValueError), scratch(spark) as keep:
        assert keep(spark.range(5), "some").count() == 5
        assert len(set(shared.iterdir()) - before) == 1
        raise ValueError
    assert set(shared.iterdir()) == before
