import datetime
import json
import os
import pickle
import sqlite3
from contextlib import closing
from decimal import Decimal

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import rows
from typeloom.functions.cells import CELL
from typeloom.operators.coerce import assign_types
from typeloom.plans.migrate import MigrateOptions, migrate
from typeloom.sources import sqlite_files
from typeloom.sources.sqlite_connect import connect, list_files
from typeloom.sources.sqlite_cuts import MOST_SHARES, KeyedTable, KeySpace, occupied_spans, plan_cuts, share_bytes
from typeloom.sources.sqlite_files import (
    BATCH_BYTES, SqliteCountSource, SqlitePushingReader, SqliteRawReader, SqliteRawSource, read_cells, sqlite_columns, sqlite_counts,
    sqlite_indexes,
)
from typeloom.sources.sqlite_shards import export_sqlite, export_sqlite_database
from typeloom.sources.tables import open_catalog

HARBOUR = """
    CREATE TABLE berths (berth_no INTEGER PRIMARY KEY, covered BOOLEAN, depth DECIMAL(5,1) NOT NULL DEFAULT 7.5);
    CREATE TABLE calls (ship VARCHAR(40) NOT NULL, arrived DATETIME, berth INT REFERENCES berths, draught DOUBLE,
        manifest BLOB, PRIMARY KEY (ship, arrived));
    INSERT INTO berths VALUES (3, 0, 11.5), (8, 1, 6.2), (9, 'yes', 4);
    INSERT INTO calls VALUES ('Petrel', '2021-03-04 05:06:07', 8, 5.25, x'0102'), ('Petrel', '2021-03-09 23:00:00', 3, 5, NULL),
        ('Skua', '2020-12-31 00:00:00', 3, NULL, NULL), ('Fulmar', '2022-07-01 12:30:00', NULL, 2.5, NULL);
    CREATE INDEX by_berth ON calls (berth, arrived);
"""
ODD = """
    CREATE TABLE sqlitedata (k TEXT, n INT DEFAULT (random()), "odd ""name" , PRIMARY KEY (k, n)) WITHOUT ROWID;
    INSERT INTO sqlitedata VALUES ('x', 1, 5), ('y', 'bad', x'00ff'), ('z', 2, NULL);
    CREATE UNIQUE INDEX ix_two ON sqlitedata (n, k);
    CREATE INDEX ix_expr ON sqlitedata (lower(k));
    CREATE TABLE inline_unique (a INT UNIQUE);
"""


@pytest.fixture()
def make(tmp_path):
    def build(name, script):
        path = f"{tmp_path}/{name}"
        with closing(sqlite3.connect(path)) as connection:
            connection.executescript(script)
        return path

    return build


def test_catalogs(spark, make):
    path = make("odd.db", ODD)
    columns = sqlite_columns(spark, path).drop("file")
    assert rows(columns, "table", "cid") == [
        ("inline_unique", 0, "a", "INT", False, False, None),
        ("sqlitedata", 0, "k", "TEXT", True, True, None),
        ("sqlitedata", 1, "n", "INT", True, True, "random()"),
        ("sqlitedata", 2, 'odd "name', "", False, False, None),
    ]
    assert rows(sqlite_indexes(spark, path).drop("file")) == [("ix_two", "sqlitedata", True, ["n", "k"])]
    assert rows(sqlite_counts(spark, path, "sqlitedata").drop("file")) == [(3,)]
    assert rows(sqlite_counts(spark, path, "inline_unique").drop("file")) == [(0,)]
    assert rows(sqlite_counts(spark, path, "nothing")) == []


def test_missing_file_is_an_error(spark, tmp_path):
    for path in (f"{tmp_path}/none.db", f"{tmp_path}/*.db"):
        with pytest.raises(Exception, match="no SQLite file"):
            sqlite_columns(spark, path).collect()
    with pytest.raises(Exception, match="no SQLite file"):
        migrate(spark, f"{tmp_path}/none.db", f"{tmp_path}/out")


def test_cells_of_every_class(spark, make):
    path = make("cells.db", """CREATE TABLE t (c);
        INSERT INTO t VALUES (1), (0.5), ('x'), (x'00'), (NULL), (CAST(x'61ff62' AS TEXT));""")
    found = [r["c"].asDict() for r in read_cells(spark, path, "t").collect()]
    assert [(f["k"], f["i"], f["r"], f["t"], f["b"]) for f in found] == [
        ("integer", 1, None, None, None), ("real", None, 0.5, None, None), ("text", None, None, "x", None),
        ("blob", None, None, None, b"\x00"), ("null", None, None, None, None), ("text", None, None, "a�b", None),
    ]


def test_large_files_are_cut_into_even_ranges(spark, make):
    path = make("big.db", """CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT);
        WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 20000)
        INSERT INTO t SELECT CASE WHEN i <= 10000 THEN i WHEN i <= 19999 THEN 4000000000000 + i ELSE 9000000000000000000
            END, hex(randomblob(20)) FROM n;""")
    with closing(connect(path)) as connection:
        groups = occupied_spans(KeySpace(connection, "t", "rowid"), 8)
        sizes = [
            sum(connection.execute("SELECT count(*) FROM t WHERE id BETWEEN ? AND ?", r).fetchone()[0] for r in g)
            for g in groups
        ]
    assert sum(sizes) == 20000 and len(sizes) <= 16 and max(sizes) <= 2 * 20000 / 8
    cells = read_cells(spark, path, "t", split_bytes=100_000)
    assert cells.rdd.getNumPartitions() > 4
    assert cells.select("id.i").distinct().count() == 20000
    counted = sqlite_counts(spark, path, "t", split_bytes=100_000)
    assert counted.count() > 4 and counted.agg({"rows": "sum"}).first()[0] == 20000


def test_wide_rows_make_small_batches(spark, make):
    path = make("wide.db", """CREATE TABLE t (id INTEGER PRIMARY KEY, v BLOB);
        WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 200)
        INSERT INTO t SELECT i, zeroblob(500000) FROM n;""")
    reader = SqliteRawReader({"path": path, "table": "t"}, ["id", "v"])
    batches = [batch.num_rows for share in reader.partitions() for batch in reader.read(share)]
    assert sum(batches) == 200 and max(batches) <= 64 and batches[1] <= 34
    assert read_cells(spark, path, "t").selectExpr("sum(octet_length(v.b))").first()[0] == 200 * 500000


def test_narrow_rows_before_wide_ones(spark, make):
    path = make("grow.db", """CREATE TABLE t (id INTEGER PRIMARY KEY, v);
        WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 20300)
        INSERT INTO t SELECT i, CASE WHEN i <= 20000 THEN i ELSE zeroblob(200000) END FROM n;""")
    reader = SqliteRawReader({"path": path, "table": "t", "split_bytes": str(10**9)}, ["id", "v"])
    batches = [(batch.num_rows, batch.nbytes) for share in reader.partitions() for batch in reader.read(share)]
    assert sum(n for n, _ in batches) == 20300 and max(size for _, size in batches) < 2 * BATCH_BYTES


@pytest.mark.parametrize("rows_", [5_000, 40_000])
def test_shares_of_text_keys_together_cost_one_scan(make, rows_):
    path = make("text.db", f"""CREATE TABLE t (k TEXT PRIMARY KEY, v) WITHOUT ROWID;
        WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < {rows_})
        INSERT INTO t SELECT '{"https://example.com/" * 5}' || hex(randomblob(8)), i FROM n;""")

    def steps(connection, sql, bound=()):
        count = [0]
        connection.set_progress_handler(lambda: count.__setitem__(0, count[0] + 1), 100)
        found = connection.execute(sql, bound).fetchall()
        connection.set_progress_handler(None, 0)
        return count[0], found

    with closing(connect(path)) as connection:
        started = steps(connection, "SELECT count(v) FROM t")[0]
        count = [0]
        connection.set_progress_handler(lambda: count.__setitem__(0, count[0] + 1), 100)
        spans = KeyedTable.of(connection, "t").spans()
        # Spans take probes, not scans; each is then walked once.
        assert count[0] < 400 and len(spans) > 16
        shares = list(KeyedTable.of(connection, "t").shares(None, None, rows_ // 16))
        connection.set_progress_handler(None, 0)
        assert count[0] < 400 + 1.5 * started
        work, sizes = 0, []
        for share, rows_of in shares:
            held = 0
            for c in share:
                more, found = steps(connection, f"SELECT count(v) FROM t WHERE {c.sql}", c.bound)
                work, held = work + more, held + found[0][0]
            assert held == rows_of
            sizes.append(held)
    assert sum(sizes) == rows_ and work < 1.5 * started + 20
    assert max(sizes) <= 2 * rows_ / 16


#: Tables of 20,000 rows whose keys share long prefixes, hot leading columns, collations, directions and classes.
KEYED = {
    "prefixes": ("k TEXT PRIMARY KEY, v", f"CASE i % 2 WHEN 0 THEN '{'x' * 300}' ELSE '{'y' * 300}' END || hex(randomblob(8)), i"),
    "hot": ("a INT, b TEXT, v, PRIMARY KEY (a, b)", "CASE WHEN i % 10 = 0 THEN i ELSE 7 END, hex(randomblob(8)) || i, i"),
    "nocase": ("k TEXT COLLATE NOCASE PRIMARY KEY, v", "CASE i % 2 WHEN 0 THEN 'aB' ELSE 'Ab' END || i, i"),
    "blobs": ("k BLOB PRIMARY KEY, v", "randomblob(8), i"),
    "mixed": ("k, d INT, v, PRIMARY KEY (k DESC, d)", "CASE i % 5 WHEN 0 THEN i / 2 WHEN 1 THEN i / 2 + 0.5 WHEN 2 THEN 'é' || i % 9"
              " WHEN 3 THEN i % 7 * 1.0 ELSE CAST('b' || i % 3 AS BLOB) END, i, i"),
}


@pytest.fixture()
def keyed(make):
    script = "".join(
        f"""CREATE TABLE {name} ({columns}) WITHOUT ROWID;
        WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 20000)
        INSERT INTO {name} SELECT {values} FROM n;"""
        for name, (columns, values) in KEYED.items()
    )
    return make("keyed.db", script)


def test_shares_of_any_key_are_even(spark, keyed):
    cuts = plan_cuts(spark, {name: [keyed] for name in KEYED}, 20_000)
    with closing(connect(keyed)) as connection:
        for name in KEYED:
            seen, sizes = set(), []
            for share in cuts[name].shares:
                found = [r[0] for c in share.conditions for r in connection.execute(f"SELECT v FROM {name} WHERE {c.sql}", c.bound)]
                sizes.append(len(found))
                seen |= set(found)
            assert sum(sizes) == len(seen) == 20_000, name
            # Spans end in shares that are not full; the reader puts them together again.
            reader = SqliteRawReader({"table": name, "cuts": cuts[name].packed(), "split_bytes": "20000"}, ["v"])
            together = [sum(b.num_rows for b in reader.read(share)) for share in reader.partitions()]
            assert sum(together) == 20_000 and len(together) > 8
            assert max(together) <= 2 * 20_000 / len(together), name


def test_few_spans_are_walked_by_one_task_each(spark, keyed):
    with closing(connect(keyed)) as connection:
        for name in KEYED:
            table = KeyedTable.of(connection, name)
            spans = table.spans(8)
            assert len(spans) >= 4
            counted = [sum(table.count(c) for c in table.between(low, high)) for low, high in zip(
                [None, *[s[0] for s in spans[1:]]], [*[s[0] for s in spans[1:]], None])]
            assert sum(counted) == 20_000


def test_no_file_is_opened_on_the_driver(spark, keyed, tmp_path, monkeypatch):
    def refused(file, *args, **options):
        raise AssertionError(f"opened {file}")

    monkeypatch.setattr(sqlite3, "connect", refused)
    assert read_cells(spark, keyed, "hot", split_bytes=50_000).count() == 20_000
    assert read_cells(spark, keyed, "hot").select("v").count() == 20_000
    assert sqlite_counts(spark, keyed, "blobs", split_bytes=50_000).agg({"rows": "sum"}).first()[0] == 20_000
    report = migrate(spark, keyed, f"{tmp_path}/out", MigrateOptions(split_bytes=200_000))
    assert sum(r["source_rows"] for r in report.collect()) == 100_000


def test_small_tables_of_large_files_are_not_cut_finely(spark, make):
    path = make("uneven.db", """CREATE TABLE big (id INTEGER PRIMARY KEY, v); CREATE TABLE small (id INTEGER PRIMARY KEY, v);
        WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 2000)
        INSERT INTO big SELECT i, zeroblob(2000) FROM n;
        INSERT INTO small SELECT id, 1 FROM big LIMIT 100;""")
    cuts = plan_cuts(spark, {"big": [path], "small": [path]}, 100_000)
    assert len(cuts["big"].shares) > 20 and len(cuts["small"].shares) == 1


# --- pushed filters -----------------------------------------------------------------------------------------

CLASSES = """CREATE TABLE t (id INTEGER PRIMARY KEY, n NUMERIC, s TEXT COLLATE NOCASE, x, b BLOB);
    INSERT INTO t VALUES (1, 5, '5', 5, x'35'), (2, 5.5, 'abc', '5', x'00'), (3, 'five', 'ABC', 5.0, NULL), (4, NULL, NULL, x'35', 'text'),
        (5, '7', 'é', NULL, x''), (6, -9223372036854775808, 'a' || char(0), 9e999, x'ff'), (7, 0.0, '', -0.0, 1),
        (8, 1, CAST(x'61ff' AS TEXT), '�', 2.5);
    CREATE INDEX by_s ON t (s);"""
FILTERS = [
    "id.i = 3", "id.i IN (1, 4, 99)", "id.i > 6", "id.i <= 2 AND n.r = 5.5", "id.i <> 3", "id.i NOT IN (1, 2)", "n.i = 5", "n.r > 0",
    "n.r >= 0.0D", "n.k = 'text'", "n.k <> 'null'", "n.k IN ('null', 'real')", "n.i IS NULL", "n.i IS NOT NULL", "s.t = 'abc'",
    "s.t = '5'", "s.t IN ('ABC', 'é')", "s.t <> 'abc'", "s.t > 'a'", "s.t = ''", "x.t = '5'", "x.i = 5", "x.r = 5.0D", "x.r = 0.0D",
    "x.r = double('infinity')", "x.r < double('nan')", "x.t = '�'", "x.b = x'35'", "b.b > x'00'", "b.b = x''", "b.k = 'odd'", "n.i < 0",
    "s.t LIKE 'a%'", "id.i = 1 OR x.i = 5", "n IS NULL", "n IS NOT NULL AND id.i >= 7", "s.t IS NULL AND s.k = 'null'", "x.i = null",
]


def test_pushed_filters_keep_what_spark_would(spark, make):
    cells = read_cells(spark, make("classes.db", CLASSES), "t", push=True)
    # The same conditions as columns, which cannot be pushed.
    wanted = cells.select("id.i", *[F.coalesce(F.expr(c), F.lit(False)).alias(f"f{n}") for n, c in enumerate(FILTERS)]).collect()
    for n, condition in enumerate(FILTERS):
        kept = sorted(r[0] for r in cells.filter(condition).select("id.i").collect())
        assert kept == sorted(r["i"] for r in wanted if r[f"f{n}"]), condition


def test_the_plan_shows_pushed_filters(spark, make):
    cells = read_cells(spark, make("classes.db", CLASSES), "t", push=True)

    def explained(condition):
        plan = cells.filter(condition)._jdf.queryExecution()
        return plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    plan = explained("id.i = 3 AND s.t LIKE 'a%'")
    assert "PushedFilters: [IsNotNull(id.i), IsNotNull(s.t), EqualTo(id.i,3)]" in plan
    assert "Condition : StartsWith(s#" in plan and "Condition" not in explained("id.i = 3 AND s.t = 'abc'")


def test_given_filters(spark, make):
    path = make("classes.db", CLASSES)
    one, two = (read_cells(spark, path, "t", where=[D.EqualTo(("id", "i"), n)]) for n in (3, 4))
    # Frames with filters of their own may meet in one query, and be filtered further.
    assert rows(one.unionByName(two).select("id.i"), "i") == [(3,), (4,)]
    both = read_cells(spark, path, "t", where=[D.In(("id", "i"), (1, 2, 3)), D.EqualTo(("s", "k"), "text")])
    assert rows(both.filter("id.i > 1").unionByName(both.filter("id.i = 1")).select("id.i"), "i") == [(1,), (2,), (3,)]
    with pytest.raises(ValueError, match="cannot evaluate"):
        read_cells(spark, path, "t", where=[D.GreaterThan(("s", "t"), "a")])


def test_a_key_lookup_reads_a_key(spark, keyed, monkeypatch):
    """Steps of SQLite's machine, in hundreds, for all shares of a lookup."""
    count = [0]

    def counting(file):
        connection = connect(file)
        connection.set_progress_handler(lambda: count.__setitem__(0, count[0] + 1), 100)
        return connection

    with closing(connect(keyed)) as connection:
        key = connection.execute("SELECT b FROM hot WHERE a = 7 LIMIT 1 OFFSET 9000").fetchone()[0]
    for table, filters, n in (
        ("hot", [D.EqualTo(("a", "i"), 7), D.EqualTo(("b", "t"), key)], 1),
        ("nocase", [D.EqualTo(("k", "t"), "aB5000")], 1),
    ):
        columns = ["a", "b", "v"] if table == "hot" else ["k", "v"]
        reader = SqlitePushingReader({"table": table, "files": f'["{keyed}"]'}, columns)
        assert list(reader.pushFilters(filters)) == []
        monkeypatch.setattr(sqlite_files, "connect", counting)
        count[0] = 0
        assert sum(b.num_rows for share in reader.partitions() for b in reader.read(share)) == n
        assert count[0] < 5
        monkeypatch.undo()


def test_tables_without_rowid(spark, make):
    path = make("wr.db", """CREATE TABLE i (k INTEGER, v TEXT, PRIMARY KEY (k, v)) WITHOUT ROWID;
        CREATE TABLE s (k TEXT PRIMARY KEY, v) WITHOUT ROWID;
        WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 5000)
        INSERT INTO i SELECT i % 100, hex(i) || hex(randomblob(30)) FROM n;
        INSERT INTO s SELECT v, k FROM i;""")
    for table in ("i", "s"):
        assert read_cells(spark, path, table, split_bytes=50_000).count() == 5000
    assert read_cells(spark, path, "i", split_bytes=50_000).rdd.getNumPartitions() > 2
    assert read_cells(spark, path, "s", split_bytes=50_000).rdd.getNumPartitions() > 2


def test_mixed_keys_without_rowid(spark, make):
    path = make("mixed.db", """CREATE TABLE m (k PRIMARY KEY, v) WITHOUT ROWID;
        WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 3000)
        INSERT INTO m SELECT CASE i % 4 WHEN 0 THEN i WHEN 1 THEN i + 0.5 WHEN 2 THEN 'key' || i
            ELSE CAST('b' || i AS BLOB) END, hex(randomblob(40)) FROM n;""")
    cells = read_cells(spark, path, "m", split_bytes=30_000)
    assert sorted(rows(cells.groupBy("k.k").count())) == [
        ("blob", 750), ("integer", 750), ("real", 750), ("text", 750),
    ]


@pytest.mark.parametrize("declared", ["", "INTEGER", "TEXT", "NUMERIC", "REAL", "BLOB", "TEXT COLLATE NOCASE"])
def test_every_key_is_read_once(spark, make, declared):
    values = ["-1e999", "1e999", "-3.5", "-3", "0", "7", "7.5", "9223372036854775807", "-9223372036854775808", "''", "'a'",
              "'B'", "'12x'", "'12'", "'ab' || char(0)", "'abc'", "'é'", "'z' || hex(zeroblob(80))", "x''", "x'00'", "x'ff'"]
    path = make("keys.db", f"CREATE TABLE t (k {declared}, pad, PRIMARY KEY (k)) WITHOUT ROWID;" + "".join(
        f"INSERT OR IGNORE INTO t VALUES ({v}, zeroblob(400));" for v in values))
    with closing(connect(path)) as connection:
        expected = connection.execute("SELECT count(*) FROM t").fetchone()[0]
    cells = read_cells(spark, path, "t", split_bytes=1000).select("k").cache()
    assert (cells.count(), cells.distinct().count()) == (expected, expected)
    cells.unpersist()


def test_files_of_a_directory_and_missing_columns(spark, make, tmp_path):
    for n in range(5):
        make(f"part-{n}.db", f"CREATE TABLE t (id INT); INSERT INTO t VALUES ({n});")
    make("other.db", "CREATE TABLE u (x INT);")
    assert len(list_files(str(tmp_path))) == 6
    cells = read_cells(spark, str(tmp_path), "t")
    assert sorted(r[0] for r in cells.select("id.i").collect()) == [0, 1, 2, 3, 4]
    make("part-5.db", "CREATE TABLE t (other INT);")
    with pytest.raises(Exception, match="lacks columns"):
        read_cells(spark, str(tmp_path), "t", ["id"]).collect()


def test_migrate(spark, make, tmp_path):
    out = f"{tmp_path}/out"
    report = {r["table"]: r for r in migrate(spark, make("harbour.db", HARBOUR + ODD), out).collect()}
    assert set(report) == {"berths", "calls", "sqlitedata", "inline_unique"}
    assert sum(r["source_rows"] for r in report.values()) == 10 and all(r["ok"] for r in report.values())
    assert report["calls"]["index_ddl"] == ['CREATE INDEX "by_berth" ON "calls" ("berth", "arrived")']
    assert report["berths"]["ddl"] == (
        'CREATE TABLE "berths" (\n  "berth_no" INT64 PRIMARY KEY,\n  "covered" BOOL,\n'
        '  "depth" DECIMAL(5,1) NOT NULL DEFAULT 7.5\n)'
    )
    assert report["sqlitedata"]["warnings"] == ["Dropped default for sqlitedata.n"]
    assert (report["sqlitedata"]["loaded_rows"], report["sqlitedata"]["rejected_rows"]) == (2, 1)
    open_catalog(spark, f"{out}/tables")
    joined = spark.sql("SELECT ship, arrived, draught, depth, covered, manifest FROM calls LEFT JOIN berths ON berth = berth_no")
    assert rows(joined, "ship", "arrived") == [
        ("Fulmar", datetime.datetime(2022, 7, 1, 12, 30), 2.5, None, None, None),
        ("Petrel", datetime.datetime(2021, 3, 4, 5, 6, 7), 5.25, Decimal("6.2"), True, b"\x01\x02"),
        ("Petrel", datetime.datetime(2021, 3, 9, 23), 5.0, Decimal("11.5"), False, None),
        ("Skua", datetime.datetime(2020, 12, 31), None, Decimal("11.5"), False, None),
    ]
    (bad,) = spark.read.parquet(f"{out}/rejects/sqlitedata.parquet").collect()
    assert bad["k"] == "y" and [e["column"] for e in bad["errors"]] == ["n", 'odd "name']
    assert not os.path.exists(f"{out}/_staged")


def test_migrating_twice(spark, make, tmp_path):
    out = f"{tmp_path}/out"
    make("a.db", "CREATE TABLE t (id INT); INSERT INTO t VALUES (1); CREATE TABLE old (x INT);")
    migrate(spark, f"{tmp_path}/a.db", out)
    make("b.db", "CREATE TABLE t (id INT); INSERT INTO t VALUES (2);")
    with pytest.raises(FileExistsError, match="mode overwrite"):
        migrate(spark, f"{tmp_path}/b.db", out)
    assert rows(spark.read.parquet(f"{out}/tables/t.parquet")) == [(1,)]
    migrate(spark, f"{tmp_path}/b.db", out, MigrateOptions(mode="overwrite"))
    assert rows(spark.read.parquet(f"{out}/tables/t.parquet")) == [(2,)]
    assert os.listdir(f"{out}/tables") == ["t.parquet"]
    # A run that fails leaves what was there, and nothing else.
    make("c.db", "CREATE TABLE t (id INT); INSERT INTO t VALUES ('bad');")
    with pytest.raises(Exception, match="column id: not a INT64: bad"):
        migrate(spark, f"{tmp_path}/c.db", out, MigrateOptions(mode="overwrite", on_error="fail"))
    assert rows(spark.read.parquet(f"{out}/tables/t.parquet")) == [(2,)]
    assert sorted(os.listdir(out)) == ["rejects", "report", "tables"]
    with pytest.raises(ValueError, match="mode must be"):
        migrate(spark, f"{tmp_path}/b.db", out, MigrateOptions(mode="append"))


def test_only_files_that_hold_a_table_are_read(spark, make, tmp_path):
    for n in range(3):
        make(f"{n}.db", f"CREATE TABLE t{n} (id INT); INSERT INTO t{n} VALUES ({n});")
    reader = SqliteRawReader({"path": str(tmp_path), "table": "t1", "files": f'["{tmp_path}/1.db"]'}, ["id"])
    assert [share.files for share in reader.partitions()] == [[f"{tmp_path}/1.db"]]
    report = migrate(spark, f"{tmp_path}/*.db", f"{tmp_path}/out")
    assert sorted((r["table"], r["source_rows"]) for r in report.collect()) == [("t0", 1), ("t1", 1), ("t2", 1)]


def test_migrate_fails_on_request(spark, make, tmp_path):
    out = f"{tmp_path}/out"
    with pytest.raises(Exception, match="column n: not a INT64: bad"):
        migrate(spark, make("odd.db", ODD.replace(", 5)", ", 'five')")), out, MigrateOptions(on_error="fail"))
    assert not os.path.exists(f"{out}/_staged")


def test_conflicting_declarations_are_refused(spark, make, tmp_path):
    make("a.db", "CREATE TABLE t (id INT);")
    make("b.db", "CREATE TABLE t (id TEXT);")
    with pytest.raises(ValueError, match=r"declare these tables differently: \['t'\]"):
        migrate(spark, f"{tmp_path}/*.db", f"{tmp_path}/out")
    make("c.sq", "CREATE TABLE t (a INT, b INT); CREATE INDEX i ON t (a);")
    make("d.sq", "CREATE TABLE t (a INT, b INT); CREATE INDEX i ON t (b);")
    with pytest.raises(ValueError, match=r"declare these indexes differently: \['i'\]"):
        migrate(spark, f"{tmp_path}/*.sq", f"{tmp_path}/out")
    report = migrate(spark, f"{tmp_path}/*.sq", f"{tmp_path}/out", MigrateOptions(create_indexes=False))
    assert [(r["table"], r["source_rows"], r["indexes"]) for r in report.collect()] == [("t", 0, 0)]


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame(
        [(1, "buoy", True, Decimal("31.07"), float("nan")), (2, None, False, Decimal("4.60"), 0.1), (3, "x", None, None, None)],
        "id bigint, name string, flag boolean, amount decimal(10,2), score double",
    ).repartition(3)


def test_shards_round_trip(spark, typed, tmp_path):
    path = f"{tmp_path}/shards"
    export_sqlite(typed, path, "t", ["id"])
    assert all(name.endswith(".sqlite") for name in os.listdir(path) if not name.startswith("."))
    types = {"id": "INT64", "name": "TEXT", "flag": "BOOL", "amount": "DECIMAL(10,2)", "score": "FLOAT64"}
    good, rejects = assign_types(read_cells(spark, path, "t"), types)
    assert rejects.count() == 0
    assert [str(r) for r in rows(good, "id")] == [str(r) for r in rows(typed, "id")]
    with closing(connect(list_files(path)[0])) as connection:
        declared = [(c[1], c[2], c[5]) for c in connection.execute("PRAGMA table_info(t)")]
    assert declared == [
        ("id", "INTEGER", 1), ("name", "TEXT", 0), ("flag", "INTEGER", 0), ("amount", "NUMERIC", 0), ("score", "REAL", 0),
    ]


def test_shard_modes(spark, typed, tmp_path):
    path = f"{tmp_path}/shards"
    export_sqlite(typed, path, "t")
    with pytest.raises(FileExistsError):
        export_sqlite(typed, path, "t")
    export_sqlite(typed, path, "t", mode="append")
    assert read_cells(spark, path, "t").count() == 6
    export_sqlite(typed, path, "t", mode="overwrite")
    assert read_cells(spark, path, "t").count() == 3


def test_empty_table_leaves_one_shard(spark, typed, tmp_path):
    path = f"{tmp_path}/shards"
    export_sqlite(typed.filter("id > 10"), path, "t", ["id", "name"])
    assert len(list_files(path)) == 1
    assert read_cells(spark, path, "t").count() == 0


def test_failed_write_leaves_nothing(spark, typed, tmp_path):
    path = f"{tmp_path}/shards"
    with pytest.raises(Exception, match="UNIQUE constraint failed"):
        export_sqlite(typed.unionAll(typed).repartition(1), path, "t", ["id"])
    assert [n for n in os.listdir(path) if not n.startswith(".")] == []


def test_database_export(spark, typed, tmp_path):
    export_sqlite_database({"a": typed, "b": typed}, f"{tmp_path}/db")
    report = migrate(spark, f"{tmp_path}/db/*/*.sqlite", f"{tmp_path}/out")
    assert rows(report.select("table", "loaded_rows"), "table") == [("a", 3), ("b", 3)]


def test_a_task_gets_its_own_share_only(spark, tmp_path):
    path = str(tmp_path / "many.sqlite")
    with closing(sqlite3.connect(path)) as connection:
        connection.execute("CREATE TABLE t (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
        connection.executemany("INSERT INTO t VALUES (?, ?)", ((f"{n:040d}", n) for n in range(20_000)))
        connection.commit()
    cuts = plan_cuts(spark, {"t": [path]}, 2_000)
    assert len(cuts["t"].shares) > 200
    options = {"path": path, "table": "t", "split_bytes": "2000", "cuts": cuts["t"].packed(), "files": json.dumps([path] * 500)}
    for kind in (SqliteRawSource, SqliteCountSource):
        source = kind(dict(options))
        reader = source.reader(T.StructType([T.StructField("k", CELL), T.StructField("v", CELL)]))
        # What Spark sends to every task: it must not grow with the number of shares.
        assert len(pickle.dumps(reader)) + len(pickle.dumps(source)) < 4_000
        assert len(reader.partitions()) > 200
    # Where there would be very many shares, each is larger.
    assert share_bytes([10**6] * 3, 2_000) == 2_000
    assert share_bytes([10**9] * 3, 2_000) == 3 * 10**9 // MOST_SHARES
    assert sorted(r["v"]["i"] for r in read_cells(spark, path, "t", cuts=cuts["t"]).collect()) == list(range(20_000))
