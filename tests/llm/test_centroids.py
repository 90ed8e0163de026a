import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspack.llm import centroids
from corpuspack.llm.common import embeddings
from corpuspack.llm.queries import op11_laesa_clusters
from tests.conftest import SF_SMALL

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute_force(rows, n=centroids.N_CENTROIDS, rounds=centroids.ROUNDS):
    """Plain rounds over Python integers; rows are ``(vec_id, embedding)``."""
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e):
            kept.append((vec_id, [int(np.floor(256 * float(x))) for x in e]))
    name = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:n]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for k in range(len(centers)):
            own = [v for (_, v), (_, j) in zip(kept, near) if j == k]
            if own:
                centers[k] = [sum(column) // len(own) for column in zip(*own)]
    near = assign()
    total = sum(d for d, _ in near)
    return sorted(
        ((i is None, i or 0), k, d, sum(e for e, j in near if j == k), total, hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest())
        for (i, _), (d, k) in zip(kept, near)
    )


def got(df):
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), *tuple(r)[1:]) for r in df.collect())


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in embeddings(spark, SF_SMALL).collect()]
    assert got(op11_laesa_clusters(spark, SF_SMALL)) == brute_force(rows)


def test_ties_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-3, 4, (30, 64)) / 256.0
    rows = [(i % 25 if i % 9 else None, [float(x) for x in base[i % 30]]) for i in range(90)]
    rows += [(100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 65), (104, [float("nan")] + [0.0] * 63), (105, [float("-inf")] + [0.0] * 63)]
    rows += [(106, [None] + [0.0] * 63), (107, [-0.0] * 64), (108, [1e-30] * 64), (109, [-1e-30] * 64)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA).withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1))
    assert got(centroids.clusters(df)) == brute_force(rows)


def test_few_or_no_vectors(spark):
    few = [(i, [i / 7.0] * 64) for i in range(3)]
    assert got(centroids.clusters(spark.createDataFrame([(i, e, 0) for i, e in few], SCHEMA))) == brute_force(few)
    none = centroids.clusters(spark.createDataFrame([(1, None, 0)], SCHEMA))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_exact_distances_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(spark.createDataFrame([(1, [1e9] * 64, 0)], SCHEMA)).collect()


def test_pivots_spare_distances(spark):
    """On parted clusters most distances are never computed, and the result is the same with one pivot or many."""
    rng = np.random.default_rng(5)
    middles = rng.uniform(-40, 40, (12, 64))
    rows = [(i, [float(x) for x in middles[i % 12] + rng.normal(0, 0.3, 64)], 0) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    many, one = centroids.cluster(df), centroids.cluster(df, n_pivots=1)
    assert max(many.exact_distances) < 0.2 * 1500 * centroids.N_CENTROIDS
    assert max(many.exact_distances) < max(one.exact_distances)
    assert sorted(many.assigned.collect()) == sorted(one.assigned.collect())


def test_bounds_never_lose_the_nearest():
    """Vectors on a line through the pivots make bounds equal to distances, where rounding matters most."""
    rng = np.random.default_rng(6)
    line = rng.integers(-(1 << 20), 1 << 20, 64)
    points = np.array([line * k // 64 for k in range(-64, 65)], dtype=np.int64)
    search = centroids.Search(points[[0, 64, 128]], points[::3])
    far = np.sqrt(np.stack([centroids.squares(points, p) for p in search.pivots], axis=1).astype(float)).astype(np.float32)
    best, least, _ = search.nearest(points, far)
    all_of = np.stack([centroids.squares(points, c) for c in search.centroids], axis=1)
    assert (best == all_of.argmin(axis=1)).all() and (least == all_of.min(axis=1)).all()
