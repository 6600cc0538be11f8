"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its content.  A ledger keeps what each version of the rules found in each
blob; a run scans only the (blob, rules) pairs that the ledger lacks, appends them, and joins the findings back to all
rows that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import stored, text_of
from typeloom.llm.registry import load, query
from typeloom.session import fresh_path
from typeloom.sources.folders import path_exists

#: A new version makes every blob unseen again.
RULES = "1"

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key_block", "web_token")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----")
_WEB_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret of one text, in code points, sorted; ``kind`` counts in :data:`KINDS`.

    A run of hexadecimal digits is matched whole, so the least length can stand in its pattern.  Of the other two base
    kinds a match that fails its length is dropped and never tried again from further on.
    """
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for kind, pattern in ((2, _HEX), (3, _KEY_BLOCK), (4, _WEB_TOKEN)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def _joined(found: list[tuple[int, int, int]], kinds: int) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found if kind < kinds)


_FINDINGS = pa.schema(
    [
        ("blob", pa.binary()),
        ("rules", pa.string()),
        *((f"n_{kind}", pa.int64()) for kind in BASE_KINDS),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
    ]
)
FINDINGS = "blob binary, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(rules: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(text.as_py()) for text in batch.column(1)]
            columns = [batch.column(0), [rules] * len(found)]
            columns += [[sum(f[1] == n for f in of) for of in found] for n in range(len(BASE_KINDS))]
            columns.append([hashlib.sha256(_joined(of, len(BASE_KINDS)).encode()).hexdigest() for of in found])
            columns.append([_joined(of, len(KINDS)) for of in found])
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, _FINDINGS, strict=True)],
                schema=_FINDINGS,
            )

    return scan


def read_ledger(spark, ledger: str, rules: str = RULES) -> DataFrame:
    """What the ledger holds for one version of the rules, one row per blob; a missing ledger is empty."""
    if not path_exists(spark, ledger):
        return spark.createDataFrame([], FINDINGS)
    held = spark.read.schema(FINDINGS).parquet(ledger)
    return held.filter(F.col("rules") == rules).dropDuplicates(["blob"])


def scan_versions(versions: DataFrame, ledger: str, path: str = "doc_id", rules: str = RULES) -> DataFrame:
    """Findings of every row of ``versions``: its ``path``, the address of its ``text``, counts and spans.

    A null text is empty, an empty text has no finding, repeated rows each keep theirs.  Other columns are ignored, so
    their names cannot clash.  Only blobs that ``ledger`` lacks for ``rules`` are scanned; they are appended first.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(path).alias("path"), text_of().alias("text"))
    rows = rows.withColumn("blob", F.unhex(F.sha2(F.col("text"), 256)))
    seen = read_ledger(spark, ledger, rules).select("blob")
    unseen = rows.select("blob", "text").join(seen, "blob", "left_anti")
    unseen.groupBy("blob").agg(F.first("text").alias("text")).mapInArrow(_scan(rules), FINDINGS).write.mode(
        "append"
    ).parquet(ledger)
    # Written once more, the findings are a plain side of the join, in which Spark can split the rows of a hot blob.
    findings = stored(read_ledger(spark, ledger, rules), "findings")
    return rows.select("path", "blob").join(findings, "blob").withColumnRenamed("path", path)


@query("op5_secret_scans")
def op5_secret_scans(spark, sf):
    found = scan_versions(load(spark, sf, "documents"), fresh_path(spark, "ledger"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.lower(F.hex("blob")).alias("blob_sha256")
    )
