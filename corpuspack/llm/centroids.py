"""Operator 11: centroid clustering of integer vectors with a LAESA pivot table.

The distances of every vector to a few fixed pivots are computed once and stored beside it. In each round the
centroids' own distances to the pivots bound every vector's distance to every centroid from below
(``|d(v, p) - d(c, p)| <= d(v, c)``, the largest over all pivots). A vector first meets the centroid of the
least bound; others are computed exactly only while their bound does not exceed the best distance so far.
Exact distances are sums of integer squares. Bounds are lowered by more than the stored distances can be off
by, so no nearest centroid, and no tie, is ever lost to rounding.

A round is one job over the stored table. Tasks return sums by centroid and component, which Spark adds up;
the driver sees ``n_centroids`` centroids, never vectors. Nothing is exchanged by cluster, so a cluster that
holds most vectors is no hot spot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.session import materialize

DIMS = 64
SCALE = 256
N_CENTROIDS = 40
N_PIVOTS = 16
ROUNDS = 5
#: Integer components below this keep the sum of 64 squared differences inside a long.
LIMIT = 1 << 27
#: Vectors handled together inside a task.
CHUNK = 4096
#: Pivot distances are stored in single precision; bounds give way by this share of the distances.
SLACK = 1e-6

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integer_vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v array<int>``: vectors of exactly ``dims`` finite components as ``floor(scale * x)``, others dropped.

    A component of ``LIMIT`` or beyond after scaling is an error: its distances would not fit a long.
    """
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    whole = lambda x: F.when(F.abs(x * scale) < LIMIT, F.floor(x * scale).cast("int")).otherwise(
        F.raise_error(F.lit("a vector component is too large for exact distances")).cast("int")
    )
    kept = embeddings.filter((F.size("embedding") == dims) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, whole).alias("v"))


def first_centroids(vectors: DataFrame, n: int = N_CENTROIDS, salt: int = 2) -> np.ndarray:
    """The ``n`` vectors with the smallest SHA-256 of ``salt:vec_id``, ascending; a null id comes last, equal ones by components."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(n).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), -1 if rows else DIMS)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to those of ``b`` (or to the one row ``b``)."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(starts: np.ndarray, n: int = N_PIVOTS) -> np.ndarray:
    """Up to ``n`` of the starts, each the one with the largest sum of distances to those before it."""
    if not len(starts):
        return starts
    chosen, total = [0], np.zeros(len(starts))
    while len(chosen) < min(n, len(starts)):
        total += np.sqrt(squares(starts, starts[chosen[-1]]).astype(float))
        total[chosen] = -1.0
        chosen.append(int(np.argmax(total)))
    return starts[chosen]


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(dtype)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vec_id, v, pivot_distances array<float>``, written once."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), pivots.shape[1], np.int64)
            far = np.sqrt(np.stack([squares(v, p) for p in pivots], axis=1).astype(float)).astype(np.float32)
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(pivots))
            lists = pa.ListArray.from_arrays(offsets, pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "v", "pivot_distances"])

    return materialize(vectors.mapInArrow(measure, "vec_id long, v array<int>, pivot_distances array<float>"), "pivot-table")


@dataclass(frozen=True)
class Search:
    """Nearest centroids by pivot bounds."""

    pivots: np.ndarray
    centroids: np.ndarray

    def nearest(self, v: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each row (ties: the smaller number), its squared distance, and how many exact
        distances that took. ``far`` holds the stored pivot distances of the rows."""
        own = np.sqrt(np.stack([squares(self.centroids, p) for p in self.pivots], axis=1).astype(float))
        bound = np.zeros((len(v), len(self.centroids)))
        for j in range(len(self.pivots)):
            a, b = far[:, j, None].astype(float), own[None, :, j]
            np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
        bound *= bound
        bound *= 1.0 - SLACK
        best = bound.argmin(axis=1)
        least = squares(v, self.centroids[best])
        computed = len(v)
        first = best.copy()
        for c in range(len(self.centroids)):
            rows = np.flatnonzero((bound[:, c] <= least) & (first != c))
            if not len(rows):
                continue
            d = squares(v[rows], self.centroids[c])
            computed += len(rows)
            better = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
            best[rows[better]], least[rows[better]] = c, d[better]
        return best, least, computed


def _chunks(batch: pa.RecordBatch, dims: int, n_pivots: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, CHUNK):
        part = batch.slice(at, CHUNK)
        yield part.column(0), _matrix(part.column(1), dims, np.int64), _matrix(part.column(2), n_pivots, np.float32)


def sums_by_cluster(table: DataFrame, search: Search) -> tuple[np.ndarray, list[list[int]], int]:
    """One round: counts and exact component sums of each cluster, and the number of exact distances."""
    k, dims = search.centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, computed = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            for _, v, far in _chunks(batch, dims, len(search.pivots)):
                best, _, n = search.nearest(v, far)
                computed += n
                counts += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    sums[c] += v[best == c].sum(axis=0)
        held = np.flatnonzero(counts)
        cluster, part = np.repeat(held, dims + 1), np.tile(np.arange(-1, dims), len(held))
        total = np.concatenate([counts[held, None], sums[held]], axis=1).ravel()
        cluster, part, total = np.append(cluster, -1), np.append(part, -1), np.append(total, computed)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array(total, pa.int64())], names=["cluster", "part", "total"])

    parts = table.mapInArrow(add, "cluster int, part int, total long").groupBy("cluster", "part")
    counts, sums, computed = np.zeros(k, dtype=object), [[0] * dims for _ in range(k)], 0
    for c, part, total in parts.agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():  # a row for each number of a centroid
        if c < 0:
            computed = int(total)
        elif part < 0:
            counts[c] = int(total)
        else:
            sums[c][part] = int(total)
    return counts, sums, computed


def moved(centroids: np.ndarray, counts: np.ndarray, sums: list[list[int]]) -> np.ndarray:
    """Non-empty centroids at the floor of their vectors' exact mean; empty ones stay."""
    return np.array([[s // n for s in own] if n else old for old, n, own in zip(centroids.tolist(), counts, sums)], dtype=np.int64)


@dataclass(frozen=True)
class Clustering:
    assigned: DataFrame  # vec_id, cluster, distance
    centroids: np.ndarray
    exact_distances: list[int]  # computed in each round; vectors * centroids without pivots


def cluster(embeddings: DataFrame, n_centroids: int = N_CENTROIDS, n_pivots: int = N_PIVOTS, rounds: int = ROUNDS) -> Clustering:
    """``rounds`` rounds of assigning and moving, then a last assignment, written once.

    Fewer vectors than centroids: each is a start. No kept vector: no centroids and an empty result. Repeated
    rows count as often as they occur; a null ``vec_id`` stays; other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings)
    centroids = first_centroids(vectors, n_centroids)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, [])
    pivots = choose_pivots(centroids, n_pivots)
    table = pivot_table(vectors, pivots)
    spent = []
    for _ in range(rounds):
        counts, sums, computed = sums_by_cluster(table, Search(pivots, centroids))
        centroids = moved(centroids, counts, sums)
        spent.append(computed)
    search = Search(pivots, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v, far in _chunks(batch, search.centroids.shape[1], len(search.pivots)):
                best, least, _ = search.nearest(v, far)
                yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(least, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = materialize(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    return Clustering(assigned, centroids, spent)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(embeddings: DataFrame) -> DataFrame:
    """The columns of ``RESULT`` for every kept vector (see ``cluster`` for odd inputs)."""
    found = cluster(embeddings)
    if not len(found.centroids):
        return embeddings.sparkSession.createDataFrame([], RESULT)
    sums = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s"))
    inertia = {r["cluster"]: r["s"] for r in sums.collect()}  # a row for each centroid
    at = F.col("cluster") + 1
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    k = range(len(found.centroids))
    return found.assigned.select(
        "vec_id", "cluster", "distance", of([inertia.get(c, 0) for c in k]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of([digest(c) for c in found.centroids]).alias("centroid_sha256"),
    )


def _rounds_sql() -> str:
    """The rounds written out: nearest centroids by packed (distance, number), then floors of exact means."""
    nearest = (
        "SELECT x.rid, x.vec_id, x.v, min(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 64 + c.n) AS best"
        " FROM vectors x, c{r} c GROUP BY x.rid, x.vec_id, x.v"
    )
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED ({nearest.format(r=r)})")
        if r < ROUNDS:
            out.append(
                f"m{r} AS MATERIALIZED (SELECT n, list(f ORDER BY i) AS v FROM (SELECT n, i, ((s - ((s % k) + k) % k) // k)::BIGINT AS f FROM ("
                f"SELECT best % 64 AS n, i, sum(v[i]) AS s, count(*) AS k FROM a{r}, range(1, {DIMS + 1}) t(i) GROUP BY ALL)) GROUP BY n)"
            )
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.n = c.n)")
    return ",\n".join(out)


#: The same rows in DuckDB.
CLUSTERS_SQL = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY key NULLS LAST, v) - 1 AS n, v FROM (
    SELECT sha256('2:' || vec_id::VARCHAR) AS key, v FROM vectors ORDER BY key NULLS LAST, v LIMIT {N_CENTROIDS})
), {_rounds_sql()}, last AS (
  SELECT a.vec_id, (a.best % 64)::INTEGER AS cluster, (a.best // 64)::BIGINT AS distance FROM a{ROUNDS} a
)
SELECT l.vec_id, l.cluster, l.distance, (sum(l.distance) OVER (PARTITION BY l.cluster))::BIGINT AS cluster_inertia,
  (sum(l.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last l JOIN c{ROUNDS} c ON c.n = l.cluster
"""
