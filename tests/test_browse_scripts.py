import random

import pytest

from tests.conftest import rows
from typeloom.operators.browse import browse, browse_after
from typeloom.operators.scripts import run_script, split_scripts, split_text
from typeloom.sources.tables import open_catalog, save_bucketed, sorted_layout, write_table

PIECES = [
    ("UPDATE trips SET note = 'a; b' WHERE km > 3; DELETE FROM trips; -- all; gone\nSELECT max(km) FROM trips;",
     ["UPDATE trips SET note = 'a; b' WHERE km > 3", "DELETE FROM trips", "-- all; gone\nSELECT max(km) FROM trips"]),
    ("a;;\n ;b", ["a", "b"]),
    ("SELECT 'it''s; ok', \"a;\"\"b\"; x", ["SELECT 'it''s; ok', \"a;\"\"b\"", "x"]),
    ("/* a; b */ c; /*/ d; */ e", ["/* a; b */ c", "/*/ d; */ e"]),
    ("open 'quote; x", ["open 'quote; x"]),
    ('a "b; c', ['a "b; c']),
    ("a -- end; no newline", ["a -- end; no newline"]),
    ("a /* never; closed", ["a /* never; closed"]),
    ("'\"';'a", ["'\"'", "'a"]),
    ("-- only a comment", ["-- only a comment"]),
    ("a - b; c / d", ["a - b", "c / d"]),
    ("　 ;\x1c;", ["\x1c"]),
    ("", []),
]


@pytest.mark.parametrize("script,want", PIECES)
def test_split_text(script, want):
    assert split_text(script) == want


def by_character(script):
    """The splitting rules, one character at a time."""
    pieces, piece, mode = [], "", ""
    at = 0
    while at < len(script):
        c, pair = script[at], script[at:at + 2]
        step = 1
        if mode == "line":
            mode = "" if c == "\n" else mode
        elif mode == "block":
            if pair == "*/":
                mode, step = "", 2
        elif mode:
            mode = "" if c == mode else mode
        elif c in "'\"":
            mode = c
        elif pair in ("--", "/*"):
            mode, step = ("line" if pair == "--" else "block"), 2
        elif c == ";":
            pieces.append(piece)
            piece, at = "", at + 1
            continue
        piece += script[at:at + step]
        at += step
    return [p.strip() for p in [*pieces, piece] if p.strip()]


def test_split_text_against_the_rules():
    rng = random.Random(11)
    for _ in range(5000):
        script = "".join(rng.choice(["'", '"', "-", "--", "/", "/*", "*", "*/", ";", "\n", "a", " "]) for _ in range(25))
        assert split_text(script) == by_character(script)


def test_split_scripts(spark):
    long = "SELECT '" + "x;" * 240_000 + "'; SELECT 1"
    df = spark.createDataFrame([(1, PIECES[0][0]), (2, None), (3, "  "), (4, long)], "id bigint, text string")
    found = rows(split_scripts(df, "id", "text"), "id", "n")
    assert found[:3] == [(1, n, s) for n, s in enumerate(PIECES[0][1], 1)]
    assert [(i, n, len(s)) for i, n, s in found[3:]] == [(4, 1, 480_009), (4, 2, 8)]


def test_run_script(spark):
    first, second = run_script(spark, "SELECT 1 AS a; SELECT ';' AS b;")
    assert (first.first()["a"], second.first()["b"]) == (1, ";")
    with pytest.raises(Exception, match="no_such_table"):
        run_script(spark, "SELECT 1; SELECT * FROM no_such_table")


@pytest.fixture(scope="module")
def keyed(spark):
    data = [(k % 7 if k % 11 else None, k, str(k)) for k in range(500)]
    return spark.createDataFrame(data, "a int, b int, c string").repartition(5)


def test_pages_cover_the_table_once(keyed):
    ordered = rows(keyed, "a", "b")
    pages = [rows(browse(keyed, ["a", "b"], n, 60)) for n in range(10)]
    assert [r for page in pages for r in page] == ordered and pages[9] == []
    found, last = rows(browse(keyed, ["a", "b"], 0, 60)), None
    while page := rows(browse_after(keyed, ["a", "b"], found[-1][:2], 60)):
        found += page
    assert found == ordered
    with pytest.raises(ValueError):
        browse(keyed, ["a"], -1)
    with pytest.raises(ValueError):
        browse_after(keyed, ["a", "b"], [1])


def test_pages_of_repeating_keys(spark, monkeypatch):
    data = [(1, "a"), (1, "a"), (1, "a"), (1, "b"), (None, "z"), (None, None), (2, "c"), (1, "a"), (2, "c")]
    df = spark.createDataFrame(data, "k int, v string").repartition(3)
    ordered = rows(df, "k", "v")
    assert [r for n in range(6) for r in rows(browse(df, ["k"], n, 2))] == ordered
    monkeypatch.setattr("typeloom.operators.browse.TOP_ROWS", 2)
    assert [r for n in range(6) for r in rows(browse(df, ["k"], n, 2))] == ordered
    found = browse(df, ["k"], 0, 2).collect()
    while page := browse_after(df, ["k"], found[-1].asDict(), 2, sum(r == found[-1] for r in found)).collect():
        found += page
    assert [tuple(r) for r in found] == ordered


def test_keyset_bound_reaches_the_scan(spark, keyed, tmp_path):
    write_table(keyed, f"{tmp_path}/t", sort_by=["b"])
    plan = browse_after(spark.read.parquet(f"{tmp_path}/t"), ["b", "a"], [400, 1])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(b,400)" in plan and "TakeOrderedAndProject" in plan


def test_sorted_layout_cuts_a_hot_key(spark):
    hot = spark.range(0, 8000, 1, 8).selectExpr("CASE WHEN id % 2 = 0 THEN 1 ELSE id END AS k", "'same' AS v")
    laid = sorted_layout(hot, ["k"], 8).selectExpr("spark_partition_id() AS p", "k")
    sizes = {r["p"]: r["count"] for r in laid.groupBy("p").count().collect()}
    assert sum(sizes.values()) == 8000 and max(sizes.values()) < 8000 / 3
    spans = laid.groupBy("p").agg({"k": "min"}).count()
    assert spans > 4


def test_write_and_open(spark, keyed, tmp_path):
    write_table(keyed, f"{tmp_path}/one.parquet", sort_by=["a", "b"], files=3)
    write_table(keyed.limit(5), f"{tmp_path}/two.parquet")
    opened = open_catalog(spark, str(tmp_path))
    assert list(opened) == ["one", "two"] and spark.table("one").count() == 500
    assert sorted(rows(opened["one"]), key=repr) == sorted(rows(keyed), key=repr)
    with pytest.raises(Exception):
        open_catalog(spark, f"{tmp_path}/none")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_table(keyed, f"{tmp_path}/one.parquet")


def test_bucketed_tables_join_without_shuffle(spark, keyed):
    for name in ("left_side", "right_side"):
        save_bucketed(keyed, name, ["b"], 4, mode="overwrite")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("left_side").join(spark.table("right_side"), "b")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE left_side")
        spark.sql("DROP TABLE right_side")
