"""What the corpus operators share: row keys, null-free texts and pieces of Arrow batches; and stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from typeloom.session import scratch, stored

__all__ = ["PIECE_CHARS", "digest", "pieces", "scratch", "slices", "stored", "text_of"]

#: Characters of text that a task turns into arrays at once.
PIECE_CHARS = 1_000_000


def text_of(column: str = "text") -> Column:
    """A text column in which a null is the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def digest(*columns: Column) -> Column:
    """16 bytes that name the values of some columns; a null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x01", *parts)))


def pieces(texts: list[str], limit: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``limit`` characters each, and one text at least."""
    start, size = 0, 0
    for n, text in enumerate(texts):
        if n > start and size + len(text) > limit:
            yield start, n
            start, size = n, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterator[pa.RecordBatch], columns: list[str], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes or list items in ``columns``, and one row at least.

    A batch holds a number of rows, whatever their size; a task that makes Python objects of it takes a slice at a time.
    """
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for name in columns:
            column = batch.column(name)
            length = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
            sizes += pc.fill_null(length(column), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for n, own in enumerate(sizes.tolist()):
            if n > start and size + own > limit:
                yield batch.slice(start, n - start)
                start, size = n, 0
            size += own
        if start < batch.num_rows:
            yield batch.slice(start)
