"""Files laid out for lookups by several keys, and the differences of two catalogs."""

import glob
from bisect import bisect_right

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from typeloom.operators.drift import catalog_drift
from typeloom.sources import tables
from typeloom.sources.tables import write_table
from typeloom.sources.zorder import rank, split_points, zordered_layout


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(0, 40_000, 1, 4).selectExpr(
        "id", "pmod(xxhash64(id), 1000) AS x", "concat('k', lpad(pmod(xxhash64(id, 7), 1000), 4, '0')) AS y"
    )


def _read_share(path, column, value):
    """Share of the row groups whose statistics let a value of a column in."""
    let_in = total = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = [meta.schema.column(n).name for n in range(meta.num_columns)].index(column)
        for n in range(meta.num_row_groups):
            stats = meta.row_group(n).column(at).statistics
            total += 1
            let_in += stats.min <= value <= stats.max
    assert total >= 32
    return let_in / total


def test_a_filter_on_either_key_skips_most_files(spark, points, tmp_path):
    path = str(tmp_path / "z")
    write_table(points, path, zorder_by=["x", "y"], files=64)
    assert rows(spark.read.parquet(path), "id") == rows(points, "id")
    # A key's column of an 8 by 8 grid is an eighth of the files; cuts beside the grid's lines let in up to twice that and a few.
    assert max(_read_share(path, "x", v) for v in (13, 500, 987)) <= 0.3
    assert max(_read_share(path, "y", v) for v in ("k0013", "k0500", "k0987")) <= 0.3


def test_sorted_files_serve_the_first_key_only(points, tmp_path):
    path = str(tmp_path / "sorted")
    write_table(points, path, sort_by=["x", "y"], files=64)
    assert _read_share(path, "x", 500) <= 0.1 < 0.9 <= _read_share(path, "y", "k0500")


def test_split_points(spark):
    df = spark.range(0, 64).selectExpr("id AS a", "CAST(NULL AS date) AS b")
    found, none = split_points(df, ["a", "b"], bits=2)
    assert found == [16, 32, 48] and none == []


def test_ranks_are_cuts_reached(spark):
    points = sorted(n * n % 97 for n in range(15))
    df = spark.sql("SELECT CAST(id AS int) AS k FROM range(-3, 110) UNION ALL SELECT NULL")
    found = df.select("k", rank(F.col("k"), points, 4, df.schema["k"].dataType).alias("r")).collect()
    assert [r["r"] for r in found] == [0 if r["k"] is None else bisect_right(points, r["k"]) for r in found]


def test_ranks_take_few_steps(points):
    plan = zordered_layout(points, ["x", "y"])._jdf.queryExecution().optimizedPlan().toString()
    # One projection for each halving and its bits were 16, and made code that the JVM does not compile.
    assert plan.count("Project") <= 5


def test_few_files_of_a_large_table_become_more(spark, points, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_BYTES", 200_000)
    write_table(points, str(tmp_path / "s"), sort_by=["id"], files=2)
    write_table(points, str(tmp_path / "z"), zorder_by=["x", "y"], files=2)
    for name in ("s", "z"):
        sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/{name}/*.parquet")]
        assert sum(sizes) == 40_000 and len(sizes) >= 10 and max(sizes) <= 8_000
        assert rows(spark.read.parquet(str(tmp_path / name)), "id") == rows(points, "id")
    monkeypatch.undo()
    write_table(points, str(tmp_path / "few"), sort_by=["id"], files=2)
    assert len(glob.glob(f"{tmp_path}/few/*.parquet")) == 2


def test_awkward_keys(spark, tmp_path):
    df = spark.sql("""SELECT * FROM VALUES (1, NULL, DATE'2020-01-01', X'00'), (NULL, 'b', NULL, NULL), (1, 'b', DATE'2020-01-01', X'FF'),
        (1, 'b', DATE'2020-01-01', X'FF') AS t(a, `b c`, d, e)""").withColumn("f", F.lit(1.5).cast("decimal(9,2)"))
    path = str(tmp_path / "awkward")
    write_table(df, path, zorder_by=["a", "b c", "d", "e", "f"], files=3)
    assert sorted(map(str, rows(spark.read.parquet(path)))) == sorted(map(str, rows(df)))
    write_table(df.limit(0), str(tmp_path / "empty"), zorder_by=["a", "b c"])
    assert spark.read.parquet(str(tmp_path / "empty")).columns == df.columns
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "both"), sort_by=["a"], zorder_by=["d"])


def test_drift(spark):
    old = {
        "t": spark.range(500).selectExpr("id", "id * 3 AS price", "id * 5 AS tax", "'x' AS note", "id % 7 AS code"),
        "gone": spark.range(1),
    }
    new = {
        "t": spark.range(10, 510).selectExpr("id", "CAST(id % 7 AS string) AS code", "id * 3 AS cost", "id * 11 AS duty", "'x' AS note"),
        "come": spark.range(1),
    }
    assert rows(catalog_drift(old, new), "table", "column", "change") == [
        ("come", "id", "added", None, "INT64"),
        ("gone", "id", "dropped", "INT64", None),
        ("t", "code", "moved", "3", "2"),
        ("t", "code", "retyped", "INT64", "TEXT"),
        ("t", "duty", "added", None, "INT64"),
        ("t", "note", "moved", "2", "3"),
        ("t", "price", "renamed", "price", "cost"),
        ("t", "tax", "dropped", "INT64", None),
    ]


def test_no_drift(spark):
    same = {"t": spark.range(3)}
    assert rows(catalog_drift(same, same)) == []
    assert [r[2] for r in rows(catalog_drift({"t": spark.range(0).withColumnRenamed("id", "a")}, {"t": spark.range(0)}), "change")] == [
        "added", "dropped"]
    with pytest.raises(ValueError):
        catalog_drift({}, {})
