"""Centroid clustering with ns-bounds.

Every vector keeps, for each centroid, a distance and the round in which that was measured.  The history of all
centroids is kept too, so a stored distance is loosened by the norm of the centroid's whole displacement since that
round (which is never more than the sum of its moves).  While the loosened distance to the own centroid stays below all
others, the vector stays; where that fails, the distances in question are measured again, exactly, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import stored
from typeloom.llm.registry import load, query

CENTROIDS, DIMENSIONS, ROUNDS, SCALE = 16, 64, 3, 64
#: What bounds may lose to rounding, relative to the numbers in them.
SLACK = 1e-9
#: Components that a task holds as long numbers at once.
PIECE = 1 << 20

_STATE = "vec_id {id}, v binary, cluster int, near binary, seen binary, distance long, count long, sums array<long>"


def widest(dimensions: int) -> int:
    """Whole components are held within this of zero, so that a squared distance fits a long."""
    return 2 ** ((61 - (dimensions - 1).bit_length()) // 2)


def whole_components(embedding: str, dimensions: int, scale: int) -> tuple[Column, Column]:
    """Whether a vector is kept, and its whole components."""
    value = F.col(embedding)
    good = (F.size(value) == dimensions) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    most = float(widest(dimensions))
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(most)), F.lit(-most))
    return F.coalesce(good, F.lit(False)), F.transform(value, lambda x: F.floor(held(x)).cast("int"))


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """Norms of how far each centroid is, at the end of the history, from where it was in each round."""
    moved = np.stack([(history[-1] - then).astype(np.float64) for then in history])
    return np.sqrt((moved * moved).sum(axis=2))


def _measured(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    off = v - centroid
    return np.einsum("ij,ij->i", off, off)


def reassign(
    v: np.ndarray, history: list[np.ndarray], moved: np.ndarray, own: np.ndarray, near: np.ndarray, seen: np.ndarray
) -> tuple[np.ndarray, int]:
    """Clusters of the vectors under the last centroids, and how many distances were measured.

    ``near`` and ``seen`` hold the measured distances and their rounds, and are brought up to date where it was needed.
    """
    centroids, now = history[-1], len(history) - 1
    count, k = len(v), len(centroids)
    every = np.arange(count)
    drift = moved[seen, np.arange(k)]
    upper = near[every, own] + drift[every, own]
    lower = near - drift
    lower -= SLACK * (1 + near + drift + upper[:, None])
    lower[every, own] = np.inf
    failed = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    own = own.copy()
    if not len(failed):
        return own, 0

    # The own distance first: the exact one mostly settles it.
    exact = np.full((len(failed), k), np.iinfo(np.int64).max)
    measured = len(failed)
    for j in range(k):
        at = np.flatnonzero(own[failed] == j)
        if len(at):
            exact[at, j] = _measured(v[failed[at]], centroids[j])
            near[failed[at], j] = np.sqrt(exact[at, j].astype(np.float64))
            seen[failed[at], j] = now
    upper = near[failed, own[failed]]
    open_ = lower[failed] <= upper[:, None] * (1 + SLACK)
    for j in range(k):
        at = np.flatnonzero(open_[:, j])
        if len(at):
            exact[at, j] = _measured(v[failed[at]], centroids[j])
            near[failed[at], j] = np.sqrt(exact[at, j].astype(np.float64))
            seen[failed[at], j] = now
            measured += len(at)
    # Of equal distances the first, which is that of the smaller number.
    own[failed] = exact.argmin(axis=1)
    return own, measured


def _first(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    exact = np.stack([_measured(v, c) for c in centroids], axis=1)
    return exact.argmin(axis=1), np.sqrt(exact.astype(np.float64))


def _round(history: list[np.ndarray], last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's part of a round: the vectors with their new state, then a row of sums for each cluster it met."""
    k, dimensions = history[-1].shape
    moved = displacements(history)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field("vec_id").type
            step = max(PIECE // dimensions, 1)
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                n = part.num_rows
                raw = b"".join(part.column("v").to_pylist())
                v = np.frombuffer(raw, np.int32).reshape(n, dimensions).astype(np.int64)
                if len(history) == 1:
                    own, near = _first(v, history[0])
                    seen = np.zeros((n, k), np.int8)
                else:
                    near = np.frombuffer(b"".join(part.column("near").to_pylist()), np.float64).reshape(n, k).copy()
                    seen = np.frombuffer(b"".join(part.column("seen").to_pylist()), np.int8).reshape(n, k).copy()
                    own, _ = reassign(v, history, moved, part.column("cluster").to_numpy().astype(np.int64), near, seen)
                distance = None
                if last:
                    distance = pa.array(_measured(v, history[-1][own]))
                else:
                    order = np.argsort(own, kind="stable")
                    present, start = np.unique(own[order], return_index=True)
                    counts += np.bincount(own, minlength=k)
                    sums[present] += np.add.reduceat(v[order], start, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        part.column("v") if not last else pa.nulls(n, pa.binary()),
                        pa.array(own.astype(np.int32)),
                        pa.array([row.tobytes() for row in near] if not last else [None] * n, pa.binary()),
                        pa.array([row.tobytes() for row in seen] if not last else [None] * n, pa.binary()),
                        distance if last else pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.list_(pa.int64())),
                    ],
                    names=_NAMES,
                )
        met = np.flatnonzero(counts)
        if len(met):
            none = [pa.nulls(len(met), pa.binary())] * 3
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(met), kind),
                    none[0],
                    pa.array(met.astype(np.int32)),
                    *none[1:],
                    pa.nulls(len(met), pa.int64()),
                    pa.array(counts[met]),
                    pa.array(sums[met].tolist(), pa.list_(pa.int64())),
                ],
                names=_NAMES,
            )

    return run


_NAMES = ["vec_id", "v", "cluster", "near", "seen", "distance", "count", "sums"]


def _moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Means of the clusters, rounded down; an empty one stays.  There is one row per cluster and component."""
    rows = state.filter(F.col("count").isNotNull()).select("cluster", "count", F.posexplode("sums").alias("place", "value"))
    total = F.sum(F.col("value").cast("decimal(38,0)"))
    rows = rows.groupBy("cluster", "place").agg(F.sum("count").alias("count"), total.alias("total")).collect()
    moved = centroids.copy()
    for row in rows:
        moved[row["cluster"], row["place"]] = int(row["total"]) // row["count"]
    return moved


def cluster(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
) -> DataFrame:
    """``vec_id``, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each vector.

    A vector that is null, has another number of components, or a null or non-finite one, is left out.  Components are
    ``floor(scale * x)``, held within :func:`widest` of zero (2**27 for 64 of them).  The first centroids are the ``k`` vectors of least
    ``sha256('1:' || vec_id)``, and of equal ids the least vectors; a null id counts as no text.  If fewer than ``k``
    vectors are kept, there are as many centroids; without any the result is empty.  Repeated rows are vectors each.
    Ties go to the smaller cluster number.  An inertia beyond a long is held at the largest one.  Other columns are
    ignored.

    Vectors stay in the partitions they were read in.  Each round writes them with their state, and each task sends one
    row of sums for a cluster, however many of its vectors are in it.  The driver holds ``rounds`` times ``k``
    centroids.
    """
    if not 0 < k <= 4096 or rounds < 0 or rounds > 126 or not 0 < dimensions <= 4096:
        raise ValueError("k must be 1 to 4096, rounds 0 to 126, dimensions 1 to 4096")
    spark = vectors.sparkSession
    good, whole = whole_components("embedding", dimensions, scale)
    kept = vectors.filter(good).select("vec_id", whole.alias("w"))
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(name, "w").select("w").limit(k).collect()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame(
            [], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    history = [np.array([r["w"] for r in first], np.int64)]
    state = kept.mapInArrow(_packed, f"vec_id {kind}, v binary")
    for _ in range(rounds):
        state = stored(state.mapInArrow(_round(history, False), _STATE.format(id=kind)), "centroid-state")
        history.append(_moved_centroids(state, history[-1]))
        state = state.filter(F.col("count").isNull())
    final = stored(state.mapInArrow(_round(history, True), _STATE.format(id=kind)), "centroid-final")

    names = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(history[-1])]
    sums = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    held = lambda value: min(int(value), 2**63 - 1)
    inertia = held(sum(r["sum"] for r in sums))
    of = {r["cluster"]: held(r["sum"]) for r in sums}
    known = spark.createDataFrame(
        [(j, of.get(j, 0), sha) for j, sha in names], "cluster int, cluster_inertia long, centroid_sha256 string"
    )
    # One row per cluster.
    return final.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256"
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("w")
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(column), -1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array([row.tobytes() for row in values], pa.binary())], names=["vec_id", "v"]
        )


def _oracle() -> str:
    parts = [
        f"""
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(
           greatest(least({SCALE} * CAST(x AS DOUBLE), {widest(DIMENSIONS)}), -{widest(DIMENSIONS)})) AS BIGINT)) AS w
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
vectors AS (SELECT vec_id, rid, unnest(w) AS x, unnest(range({DIMENSIONS})) AS place FROM kept),
firsts AS (
  SELECT w, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), w) - 1 AS c
  FROM kept ORDER BY c LIMIT {CENTROIDS}),
centroids0 AS (SELECT c, unnest(w) AS x, unnest(range({DIMENSIONS})) AS place FROM firsts)"""
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"""
away{n} AS (
  SELECT v.vec_id, v.rid, k.c, CAST(sum((v.x - k.x) * (v.x - k.x)) AS BIGINT) AS distance
  FROM vectors v JOIN centroids{n} k USING (place) GROUP BY v.vec_id, v.rid, k.c),
own{n} AS (
  SELECT vec_id, rid, c, distance FROM away{n}
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c) = 1)""")
        if n < ROUNDS:
            parts.append(f"""
sums{n} AS (
  SELECT o.c, v.place, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n
  FROM own{n} o JOIN vectors v USING (rid) GROUP BY o.c, v.place),
centroids{n + 1} AS (
  SELECT c, coalesce((s - ((s % n) + n) % n) // n, x) AS x, place FROM centroids{n} LEFT JOIN sums{n} USING (c, place))""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM own{ROUNDS}
JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256
      FROM centroids{ROUNDS} GROUP BY c) USING (c)"""


@query("op11_centroid_clustering", _oracle())
def op11_centroid_clustering(spark, sf):
    return cluster(load(spark, sf, "embeddings"))
