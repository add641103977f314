"""Clustering against all distances in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from logtable.llm.clustering import SAMPLE, Rotation, assign, clustered, with_inertia

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                centroids[j] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    return sorted(found, key=str), centroids


def run(spark, rows, k=5, rounds=3, dims=8):
    assigned, centroids = clustered(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3), k=k, rounds=rounds, dims=dims)
    return sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in assigned.collect()], key=str), centroids.tolist()


def vectors(n, dims, seed, clusters=0):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(max(1, clusters), dims)) * (3 if clusters else 0)
    return [(i, (centres[i % max(1, clusters)] + pick.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("clusters", [0, 4])
def test_against_all_distances(spark, clusters):
    rows = vectors(300, 8, 1, clusters)
    assert run(spark, rows) == brute(rows, 5, 3, 8)


def test_odd_rows_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(12, 8, 2) + [
        (None, [0.5] * 8), (None, [0.25] * 8), (50, None), (51, []), (52, [1.0] * 7), (53, [1.0] * 9), (54, [1.0] * 7 + [None]),
        (55, [1.0] * 7 + [nan]), (56, [1.0] * 7 + [-inf]), (57, [0.0] * 8), (57, [0.0] * 8), (57, [-0.001] * 8), (58, [100.0] * 8)]
    assert run(spark, rows) == brute(rows, 5, 3, 8)


def test_one_vector_in_most_rows_and_fewer_vectors_than_clusters(spark):
    rows = [(7, [1.0] * 8)] * 200 + vectors(3, 8, 3)
    assert run(spark, rows) == brute(rows, 5, 3, 8)
    assert run(spark, rows[:3] + rows[-1:]) == brute(rows[:3] + rows[-1:], 5, 3, 8)


def test_empty_table_gives_no_rows(spark):
    assert run(spark, [(1, None)]) == ([], [])
    assert with_inertia(*clustered(spark.createDataFrame([], SCHEMA))).count() == 0


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="may not fit a long"):
        run(spark, [(1, [1e9] * 8)])


def test_clashing_columns_and_inertia(spark):
    frame = spark.createDataFrame([(i, v, 0) for i, v in vectors(50, 64, 4)], SCHEMA).selectExpr(
        "*", "'z' AS v", "1 AS cluster", "2 AS distance", "3 AS h", "4 AS inertia", "5 AS outline")
    rows = with_inertia(*clustered(frame, k=3)).collect()
    assert all(r["inertia"] == sum(x["distance"] for x in rows) for r in rows)
    assert all(r["cluster_inertia"] == sum(x["distance"] for x in rows if x["cluster"] == r["cluster"]) for r in rows)


def test_bounds_never_lose_the_nearest_centroid():
    pick = random.Random(6)
    for scale in (1, 1000, 1 << 25):
        some = np.array([[pick.randrange(-scale, scale + 1) for _ in range(64)] for _ in range(600)], np.int32)
        centroids = np.concatenate([some[:30], some[:10]]).astype(np.int64)
        rotation = Rotation.fitted(some[:SAMPLE].astype(float))
        clusters, distances = assign(some, rotation.outline(some.astype(float)), centroids, rotation.outline(centroids.astype(float)))
        apart = ((some[:, None, :].astype(np.int64) - centroids[None]) ** 2).sum(axis=2)
        assert (clusters == apart.argmin(axis=1)).all() and (distances == apart.min(axis=1)).all()
