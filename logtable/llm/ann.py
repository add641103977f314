"""Approximate nearest neighbours by balanced posting lists.

Vectors are scaled to length one, so the nearest by cosine are the nearest by distance. A
bounded sample gives the centroids, and every vector goes to the posting list of its nearest
centroid. Vectors near a boundary are replicated: also to each further centroid within
``REPLICATE`` times the nearest distance. Centroids form a graph (each joined to its nearest
ones and to a few at random) that is searched in memory, best first. A query selects the
lists whose centroid is within ``SELECT`` times the distance of its nearest one, and compares
itself with all members of these lists. Lists are balanced: one with more than ``LIST_ROWS``
members is dealt into parts, and a query that selects it goes to each part.

Vectors that are equal are indexed once, with their smallest ids: among ``k`` neighbours no
more than ``k + 1`` of them can occur, so nothing is lost.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers take
no part; a shorter vector counts as filled up with zeros; ties go to the smaller id; a null
id takes no part; rows that repeat an id and vector count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logtable.plans.staging import stage

#: Vectors that centroids are fitted on, and lists at most: half the square root of the vectors.
SAMPLE, MOST_LISTS = 20_000, 4096
REPLICATE, MOST_REPLICAS = 1.02, 4
#: Vectors without any structure need most lists for a recall of 0.95; where there are
#: clusters, few centroids lie within this ratio.
SELECT, LEAST_LISTS = 1.3, 4
#: The graph is searched a little beyond what is selected, as paths may lead through it.
BEYOND = 1.05
#: Members of a list that one task compares at a time.
LIST_ROWS = 2048
#: Neighbours of a centroid in the graph (nearest and random), centroids that a search opens
#: at least, and where it begins.
NEAR, FAR, FRONT, ENTRIES = 24, 8, 32, 16
ROUNDS = 8


class CentroidGraph:
    """Centroids, each with its neighbours; searched for many vectors at once."""

    def __init__(self, centroids: np.ndarray, seed: int = 5) -> None:
        self.centroids = centroids.astype(np.float32)
        n = len(centroids)
        dealt = np.random.default_rng(seed)
        near, far = min(NEAR, n - 1), min(FAR, n - 1)
        links = np.zeros((n, near + far), np.int32)
        for at in range(0, n, 1024):
            dots = self.centroids[at : at + 1024] @ self.centroids.T
            dots[np.arange(len(dots)), np.arange(at, at + len(dots))] = -np.inf
            links[at : at + 1024, :near] = np.argpartition(-dots, max(near - 1, 0), axis=1)[:, :near]
        links[:, near:] = dealt.integers(0, n, (n, far))
        self.links = links
        self.entries = dealt.permutation(n)[:ENTRIES].astype(np.int32)

    def search(self, vectors: np.ndarray, ratio: float, front: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the nearest centroids found, nearest first, and how near (dot
        products; -inf where fewer than ``front`` were found).

        Best first for all vectors in step: each opens its nearest unopened centroid and
        meets its neighbours, until all within ``ratio`` times the nearest distance, and
        ``FRONT`` in any case, are open.
        """
        n, lists = len(vectors), len(self.centroids)
        front = min(max(front, FRONT), lists)
        vectors = vectors.astype(np.float32)
        dots = np.full((n, front + len(self.entries) + self.links.shape[1]), -np.inf, np.float32)
        ids = np.full(dots.shape, -1, np.int32)
        opened = np.zeros(dots.shape, bool)
        met = np.zeros((n, lists), bool)
        rows = np.arange(n)

        def meet(active: np.ndarray, found: np.ndarray) -> None:
            """Add ``found`` (a row of centroids for each active vector) and keep the nearest."""
            width = found.shape[1]
            near = np.einsum("ij,ikj->ik", vectors[active], self.centroids[found])
            near[met[active[:, None], found]] = -np.inf
            met[active[:, None], found] = True
            dots[active, front : front + width] = near
            ids[active, front : front + width] = found
            opened[active, front : front + width] = False
            order = np.argsort(-dots[active, : front + width], axis=1, kind="stable")[:, :front]
            for kept in (dots, ids, opened):
                kept[active, :front] = np.take_along_axis(kept[active, : front + width], order, axis=1)

        meet(rows, np.tile(self.entries, (n, 1)))
        active = rows
        while len(active):
            far = _distance(dots[active, :front])
            within = (far <= ratio * BEYOND * far[:, :1]) | (np.arange(front) < FRONT)
            waiting = ~opened[active, :front] & np.isfinite(dots[active, :front]) & within
            active, waiting = active[waiting.any(axis=1)], waiting[waiting.any(axis=1)]
            if not len(active):
                break
            at = waiting.argmax(axis=1)
            opened[active, at] = True
            found = np.sort(self.links[ids[active, at]], axis=1)
            # A centroid twice among the links is met once.
            twice = np.concatenate([np.zeros((len(found), 1), bool), found[:, 1:] == found[:, :-1]], axis=1)
            found = np.where(twice, ids[active, at][:, None], found)
            meet(active, found)
        return ids[:, :front], dots[:, :front]


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Balanced k-means on the sphere: a centroid's pull falls with the members it has."""
    dealt = np.random.default_rng(seed)
    centroids = sample[dealt.permutation(len(sample))[:lists]].astype(np.float32)
    burden = np.zeros(len(centroids), np.float32)
    share = len(sample) / len(centroids)
    for _ in range(ROUNDS):
        own = np.concatenate([
            (sample[a : a + 4096].astype(np.float32) @ centroids.T - burden).argmax(axis=1)
            for a in range(0, len(sample), 4096)])
        sizes = np.bincount(own, minlength=len(centroids))
        sums = np.zeros(centroids.shape)
        np.add.at(sums, own, sample)
        moved = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)
        centroids = np.where(sizes[:, None] > 0, moved, centroids).astype(np.float32)
        burden = (0.02 * (sizes / share - 1)).clip(-0.02, 0.1).astype(np.float32)
    return centroids


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """``uid`` (the smallest id), ``vector`` and its ``k + 1`` smallest ``ids`` for each distinct vector."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    first = vectors.distinct().withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.get("ids", F.lit(0)).alias("uid"), "vector", "ids")


def nearest(
    table: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5,
    select: float = SELECT, replicate: float = REPLICATE,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found to each query row."""
    spark = table.sparkSession
    rows = table.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        is_query.alias("is_query")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    filled = F.concat("vector", F.array_repeat(F.lit(0.0), width - F.size("vector")))
    rows = rows.withColumn("vector", F.when(F.size("vector") == width, F.col("vector")).otherwise(filled))
    index = stage(distinct_vectors(rows.select("id", "vector"), k))
    n = index.count()
    lists = max(1, min(MOST_LISTS, math.isqrt(n) // 2))
    # The sample is bounded and chosen by hash, so reruns agree.
    sample = index.select("uid", "vector").orderBy(F.xxhash64("uid")).limit(SAMPLE).toArrow()
    directions = _matrix(sample.column("vector"), width)
    directions = directions / np.linalg.norm(directions, axis=1, keepdims=True)
    # At most MOST_LISTS centroids and their links are broadcast.
    graph = spark.sparkContext.broadcast(CentroidGraph(fit_centroids(directions, lists)))

    def lists_of(ratio: float, least: int, most: int):
        """Rows with the posting lists within ``ratio`` times the nearest distance."""

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    matrix = _matrix(some.column(1), width)
                    scaled = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
                    ids, dots = graph.value.search(scaled, ratio, most)
                    far = _distance(dots)
                    place = np.arange(ids.shape[1])
                    chosen = np.isfinite(dots) & ((far <= ratio * far[:, :1] + 1e-9) | (place < least)) & (place < most)
                    offsets = np.append(0, np.cumsum(chosen.sum(axis=1)))
                    found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[chosen], pa.int32()))
                    yield pa.RecordBatch.from_arrays([some.column(0), found], ["uid", "lists"])

        return find

    own = index.select("uid", "vector").mapInArrow(lists_of(replicate, 1, MOST_REPLICAS), "uid long, lists array<int>")
    members = stage(own.select("uid", F.explode("lists").alias("list")))
    # Lists are dealt into parts of LIST_ROWS members; one row per list is joined back.
    sizes = members.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("parts"))
    sizes = F.broadcast(sizes)  # no more rows than MOST_LISTS
    part = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    posting = members.join(sizes, "list").select("uid", "list", part.alias("part")).join(index.select("uid", "vector"), "uid")
    asked = rows.filter("is_query").select("id", "vector")
    queries = stage(index.join(asked.select("vector").distinct(), "vector", "left_semi").select("uid", "vector"))
    selected = queries.mapInArrow(lists_of(select, LEAST_LISTS, MOST_LISTS), "uid long, lists array<int>")
    sent = (
        selected.select(F.col("uid").alias("query"), F.explode("lists").alias("list")).join(sizes, "list")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(queries.select(F.col("uid").alias("query"), F.col("vector")), "query")
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ``k + 1`` nearest members of one part to each query that came to it."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "uid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = _matrix(left.column("vector"), width), _matrix(right.column("vector"), width)
        uids = right.column("uid").to_numpy()
        order = np.argsort(uids)
        b, uids = b[order], uids[order]
        lengths = np.sqrt((b * b).sum(axis=1))
        found = []
        for row, query in zip(a, left.column("query").to_pylist()):
            scores = (b * row).sum(axis=1) / (lengths * math.sqrt((row * row).sum()))
            best = np.argsort(-scores, kind="stable")[: k + 1]
            found.append((np.full(len(best), query), uids[best], scores[best]))
        return pa.table({name: np.concatenate(parts) for name, parts in zip(("query", "uid", "score"), zip(*found))})

    near = sent.select("query", "vector", "list", "part").groupBy("list", "part").cogroup(
        posting.select("uid", "vector", "list", "part").groupBy("list", "part")
    ).applyInArrow(compare, "query long, uid long, score double")
    # A replicated member is found in several lists; its score is the same in all.
    once = near.groupBy("query", "uid").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "uid"))
    top = once.withColumn("best", best).filter(F.col("best") <= k + 1)
    with_ids = top.join(index.select("uid", "ids"), "uid")
    # Every query row of a vector gets the found vectors' ids but its own.
    found = with_ids.groupBy("query").agg(F.flatten(F.collect_list(F.transform(
        "ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id"))))).alias("found"))
    of_vector = index.select(F.col("uid").alias("query"), "vector")
    asked = asked.distinct().join(of_vector, "vector").select(F.col("id").alias("query_id"), "query")
    answers = asked.join(found, "query").select("query_id", F.posexplode(F.slice(F.sort_array(
        F.filter("found", lambda f: f["vec_id"] != F.col("query_id"))), 1, k)).alias("at", "hit"))
    return answers.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
