"""Where SQLite files are, and read-only connections to them."""

from __future__ import annotations

import glob
import os
import sqlite3

from typeloom.functions.lexical import quoted


def local_path(path: str) -> str:
    path = path.removeprefix("file://")
    if "://" in path:
        raise ValueError(f"SQLite files are read through the file system, not from {path!r}")
    return path


def list_files(path: str) -> list[str]:
    """The SQLite files a path stands for, sorted; none at all is an error."""
    path = local_path(path)
    if os.path.isdir(path):
        names = sorted(e.name for e in os.scandir(path) if e.is_file() and e.name[0] not in "._")
        files = [os.path.join(path, name) for name in names]
    else:
        files = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
    if not files or not all(os.path.isfile(f) for f in files):
        raise FileNotFoundError(f"no SQLite file at {path!r}")
    return files


def connect(file: str) -> sqlite3.Connection:
    """A read-only connection; text that is not valid UTF-8 gets replacement characters."""
    connection = sqlite3.connect(f"file:{_uri_path(file)}?mode=ro", uri=True)
    connection.text_factory = lambda data: data.decode("utf-8", "replace")
    return connection


def _uri_path(file: str) -> str:
    return os.path.abspath(file).replace("%", "%25").replace("?", "%3f").replace("#", "%23")


def table_columns(connection: sqlite3.Connection, table: str) -> list[tuple]:
    """``(cid, name, decl, not_null, default, pk position)`` of each column; empty for an unknown table."""
    return connection.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
