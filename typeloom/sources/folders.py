"""Listing and removing folders on whatever file system a path names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def entry_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder, sorted; a missing folder is an error."""
    path, system = _resolve(spark, folder)
    return sorted(status.getPath().getName() for status in system.listStatus(path))


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that this library wrote."""
    path, system = _resolve(spark, folder)
    system.delete(path, True)


def path_exists(spark: SparkSession, folder: str) -> bool:
    """Whether a path names anything."""
    path, system = _resolve(spark, folder)
    return system.exists(path)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; one that is not there is left alone, and a rename that fails is an error."""
    if not path_exists(spark, source):
        return
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)):
        raise OSError(f"could not move {source!r} to {target!r}")


def swap_folders(spark: SparkSession, out: str, fresh: str, old: str, names: Sequence[str]) -> None:
    """Put the folders of ``fresh`` in the place of those of ``out``, which go to ``old``; all of them, or none."""
    done: list[tuple[str, str]] = []
    try:
        for name in names:
            for source, target in ((f"{out}/{name}", f"{old}/{name}"), (f"{fresh}/{name}", f"{out}/{name}")):
                move_folder(spark, source, target)
                done.append((source, target))
    except Exception:
        for source, target in reversed(done):
            move_folder(spark, target, source)
        raise
