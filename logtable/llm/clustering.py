"""Centroid clustering in integers, with centroids filtered in PCA-rotated coordinates.

Each vector component x becomes the integer floor(``scale`` * x). A rotation is fitted once on
a bounded sample of the vectors (``SAMPLE`` of them, by the hash of their id); every vector is
stored with its integers, its ``LEADING`` leading rotated coordinates and the norm of the
others. The squared distance of two vectors is at least the squared distance of their leading
coordinates plus the squared difference of those norms. A vector is first compared in integers
with the centroid of the least bound; then with every other centroid whose bound is not above
that distance. So the rotation only decides how much is compared, never the result.

Each round adds up vectors inside each task and sends one row per task and cluster; the driver
sees ``k`` rows a round, and tasks get ``k`` centroids.

Defined results: vectors that are null, of other sizes, or hold null or non-finite components
are left out; rows that repeat are vectors of their own; a null id counts as an empty one where
ids are hashed, and equal ids start in the order of their components; with fewer than ``k``
vectors there are as many clusters as vectors. Components from 2^27 / ``scale`` on, whose
squared distances may not fit a long, are refused by an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logtable.plans.staging import stage

K, DIMS, ROUNDS, SCALE = 40, 64, 5, 256
SAMPLE, LEADING = 4096, 16
#: Integers from here on are refused.
TOO_LARGE = 1 << 27
#: How far rounding may raise a bound, of the squared norms: some 10,000 times what it does.
SLACK = 1e-9
#: Vectors whose bounds, and pairs whose distances, are worked out together.
SLAB, PAIRS = 4096, 1 << 15


class Rotation(NamedTuple):
    mean: np.ndarray
    axes: np.ndarray

    @classmethod
    def fitted(cls, vectors: np.ndarray) -> Rotation:
        mean = vectors.mean(axis=0)
        _, axes = np.linalg.eigh((vectors - mean).T @ (vectors - mean))
        return cls(mean, axes[:, ::-1])

    def outline(self, vectors: np.ndarray) -> np.ndarray:
        """Leading coordinates and the norm of the rest: distances of these bound distances."""
        turned = (vectors - self.mean) @ self.axes
        return np.column_stack([turned[:, :LEADING], np.linalg.norm(turned[:, LEADING:], axis=1)])


def _squared(some: np.ndarray, other: np.ndarray) -> np.ndarray:
    apart = some.astype(np.int64) - other
    return np.einsum("ij,ij->i", apart, apart)


def assign(vectors: np.ndarray, outlines: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number on ties, and its squared distance."""
    clusters, distances = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), np.int64)
    norms = (of_centroids * of_centroids).sum(axis=1)
    for at in range(0, len(vectors), SLAB):
        some, outline = vectors[at : at + SLAB], outlines[at : at + SLAB]
        every = (outline * outline).sum(axis=1)[:, None] + norms
        bounds = every - 2 * (outline @ of_centroids.T) - SLACK * (every + 1)
        first = bounds.argmin(axis=1)
        best = _squared(some, centroids[first])
        exact = np.full(bounds.shape, np.iinfo(np.int64).max)
        exact[np.arange(len(some)), first] = best
        left = bounds <= best[:, None]
        left[np.arange(len(some)), first] = False
        rows, columns = np.nonzero(left)
        for i in range(0, len(rows), PAIRS):
            r, c = rows[i : i + PAIRS], columns[i : i + PAIRS]
            exact[r, c] = _squared(some[r], centroids[c])
        found = exact.argmin(axis=1)
        clusters[at : at + SLAB], distances[at : at + SLAB] = found, exact[np.arange(len(some)), found]
    return clusters, distances


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def prepared(df: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``vec_id`` and the integers ``v`` of each vector that takes part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(
        F.coalesce((F.size("v") == dims) & finite, F.lit(False)))
    refusal = F.raise_error(F.lit(f"a component of {TOO_LARGE // scale} or more: squared distances may not fit a long"))
    return kept.withColumn("v", F.transform("v", lambda x: F.when(
        F.abs(x * scale) < TOO_LARGE, F.floor(x * scale).cast("int")).otherwise(refusal.cast("int"))))


def outlined(vectors: DataFrame, rotation: Rotation, dims: int) -> DataFrame:
    """``vectors`` with ``v`` as bytes, and their ``outline``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dims)
            rows = [pa.array([row.tobytes() for row in some], pa.binary()) for some in (values, rotation.outline(values.astype(float)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows], ["vec_id", "v", "outline"])

    return vectors.mapInArrow(add, vectors.select("vec_id", F.lit(b"").alias("v"), F.lit(b"").alias("outline")).schema)


def _assigner(centroids: np.ndarray, rotation: Rotation):
    """A function of a batch with ``v`` and ``outline``: its vectors, clusters and distances."""
    of_centroids = rotation.outline(centroids.astype(float))

    def found(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = _matrix(batch.column("v"), np.int32, centroids.shape[1])
        outlines = _matrix(batch.column("outline"), np.float64, of_centroids.shape[1])
        return vectors, *assign(vectors, outlines, centroids, of_centroids)

    return found


def moved(vectors: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """The centroids after one round."""
    found, (k, dims) = _assigner(centroids, rotation), centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            some, clusters, _ = found(batch)
            counts += np.bincount(clusters, minlength=k)
            np.add.at(sums, clusters, some)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"])

    parts = vectors.select("v", "outline").mapInArrow(add_up, "cluster int, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for row in added.collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return out


def clustered(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
    dims: int = DIMS, scale: int = SCALE, seed: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``cluster`` and squared ``distance`` of each vector, and the centroids.

    They start as the ``k`` vectors whose ``seed:vec_id`` has the least SHA-256, and move
    ``rounds`` times to the floor of their vectors' mean; one without vectors stays.
    """
    kept = prepared(df, vec_id, vector, dims, scale)
    schema = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("v", named.alias("h")).orderBy("h", "v").limit(k).collect()
    if not first:
        return df.sparkSession.createDataFrame([], schema), np.zeros((0, dims), np.int64)
    centroids = np.array([r["v"] for r in first], np.int64)
    sample = kept.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h", "v").limit(SAMPLE).collect()
    rotation = Rotation.fitted(np.array([r["v"] for r in sample], float))
    vectors = stage(outlined(kept, rotation, dims))
    for _ in range(rounds):
        centroids = moved(vectors, centroids, rotation)
    found = _assigner(centroids, rotation)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, clusters, distances = found(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(clusters, pa.int32()), pa.array(distances)], ["vec_id", "cluster", "distance"])

    return stage(vectors.mapInArrow(place, schema)), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the inertia of each cluster and of all, and the digest of its centroid.

    One row per cluster comes to the driver.
    """
    held = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values or [None]]), F.col("cluster") + 1)

    return assigned.withColumns({
        "cluster_inertia": of_cluster([held.get(i, 0) for i in range(len(centroids))], "long"),
        "inertia": F.lit(sum(held.values())).cast("long"),
        "centroid_sha256": of_cluster(digests, "string"),
    })
