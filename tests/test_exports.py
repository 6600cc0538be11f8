import glob
import json

import pytest
from pyspark.sql import types as T

from tests.conftest import rows
from typeloom.operators.audit import PRIMARY_KEY, Constraint
from typeloom.sources.exports import export_csv, export_dump, export_json, export_markdown, export_sql_insert

TEXTS = ["a,b", 'q"q', "two\nlines", "p|q", " lead ", "", None, "#hash", "cr\rcr", "back\\slash", "é"]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(10, "Kestrel"), (11, None)], "id bigint, name string").coalesce(1)


def content(path):
    """The bytes of the part files in order, as text."""
    return "".join(open(f, encoding="utf-8", newline="").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_csv(users, tmp_path):
    export_csv(users, f"{tmp_path}/out")
    assert content(f"{tmp_path}/out") == "id,name\n10,Kestrel\n11,\n"


def test_csv_quotes_only_what_needs_it(spark, tmp_path):
    df = spark.createDataFrame([(t, "x") for t in TEXTS], "s string, t string").coalesce(1)
    export_csv(df, f"{tmp_path}/out")
    assert content(f"{tmp_path}/out") == (
        's,t\n"a,b",x\n"q""q",x\n"two\nlines",x\np|q,x\n lead ,x\n,x\n,x\n#hash,x\n"cr\rcr",x\nback\\slash,x\né,x\n'
    )


def test_csv_of_one_column_keeps_empty_rows(spark, tmp_path):
    df = spark.createDataFrame([("a",), (None,), ("",)], "s string").coalesce(1)
    export_csv(df, f"{tmp_path}/out")
    assert content(f"{tmp_path}/out") == 's\na\n""\n""\n'


def test_json(spark, tmp_path):
    schema = "i bigint, f double, b boolean, s string, n string"
    df = spark.createDataFrame([(1, float("inf"), True, 'a"\n', None), (2, 0.5, False, "", None)], schema).coalesce(1)
    export_json(df, f"{tmp_path}/out")
    lines = [json.loads(line) for line in content(f"{tmp_path}/out").splitlines()]
    assert lines == [
        {"i": 1, "f": None, "b": True, "s": 'a"\n', "n": None}, {"i": 2, "f": 0.5, "b": False, "s": "", "n": None},
    ]


def test_markdown(spark, tmp_path):
    df = spark.createDataFrame([(1, "p|q\nr"), (2, None)], "id bigint, s string").coalesce(1)
    export_markdown(df, f"{tmp_path}/out")
    assert content(f"{tmp_path}/out/head") == "| id | s |\n| --- | --- |\n"
    assert content(f"{tmp_path}/out/rows") == "| 1 | p\\|q r |\n| 2 | NULL |\n"


def test_sql_insert(users, tmp_path):
    export_sql_insert(users, 'us"ers', f"{tmp_path}/out")
    assert content(f"{tmp_path}/out") == (
        'INSERT INTO "us""ers" ("id", "name") VALUES (10, \'Kestrel\');\n'
        'INSERT INTO "us""ers" ("id", "name") VALUES (11, NULL);\n'
    )


def test_blobs_are_whole_unless_asked(spark, tmp_path):
    df = spark.createDataFrame([(bytes(33),)], T.StructType().add("b", T.BinaryType())).coalesce(1)
    export_csv(df, f"{tmp_path}/cut", short_blobs=True)
    export_csv(df, f"{tmp_path}/full")
    assert content(f"{tmp_path}/cut") == "b\n0x" + "00" * 16 + "… (33 bytes)\n"
    assert content(f"{tmp_path}/full") == "b\n0x" + "00" * 33 + "\n"


def test_existing_path_is_refused(users, tmp_path):
    export_csv(users, f"{tmp_path}/out")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        export_csv(users, f"{tmp_path}/out")
    export_csv(users, f"{tmp_path}/out", mode="overwrite")


def test_dump_runs_in_sqlite(spark, users, tmp_path):
    import sqlite3

    export_dump({"users": users}, f"{tmp_path}/out", [Constraint("users", PRIMARY_KEY, ("id",))])
    database = sqlite3.connect(":memory:")
    database.executescript(content(f"{tmp_path}/out/ddl/table=users") + content(f"{tmp_path}/out/rows/users"))
    assert database.execute("SELECT * FROM users ORDER BY id").fetchall() == rows(users, "id")
    assert [c[5] for c in database.execute("PRAGMA table_info(users)")] == [1, 0]
