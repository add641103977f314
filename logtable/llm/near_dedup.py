"""Near-duplicates by a multi-index Hamming join over MinHash signatures.

A document's set of word shingles gets a signature of ``SYMBOLS`` minima, ``BITS`` bits of
each; the first ``INDEXED`` are indexed. Two signatures that differ in ``most_errors`` of these
or fewer agree, in at least one of ``chunks`` chunks, in all symbols but ``CHUNK_ERRORS``
(pigeonhole). So each chunk is entered into an index once for every choice of symbols that may
be wrong, leaving them out; all pairs within the distance meet under a common key. Pairs that
also differ in no more than ``all_errors`` of all symbols are confirmed on the full sets.

Both distances follow from the threshold and ``miss_rate``, the share of pairs exactly at the
threshold that may be missed (``Distances.of``): at a similarity of 0.85, 64 minima differ in
9.6 places on average, and in more than 23 once in about 300,000 such pairs; 256 differ in 38
places, and in more than 65 once in some 200,000.

What keeps this linear where many documents are alike: documents with equal sets become one
first. Then every key links its members to its smallest one only; confirmed links give
components, and only keys whose members are still in several components are compared in
full, member by member, in blocks, leaving out pairs inside a component. That takes two walks
over the blocks, and no pair ever becomes a row: the first keeps the members of near pairs; the
second gets their full sets too, confirms pairs where they meet, and writes only links that
join two components of its block. So a group of documents that are almost, but not quite,
alike costs comparisons inside tasks, but rows in proportion to its size. Nothing is capped.

Defined results: a null or empty text has an empty set and is linked with nothing, as is a
row without an id; rows that repeat an id are one document and get one answer.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logtable.llm.common import release_memory
from logtable.llm.components import components
from logtable.llm.shingles import mixed, shingle_sets
from logtable.plans.staging import stage

WIDTH = 5
SYMBOLS, BITS = 256, 8
INDEXED, CHUNK_ERRORS = 64, 1
#: The share of pairs at the threshold that may be missed.
MISS_RATE = 1e-5
#: Members of one key, and shingles of theirs, that are compared with each other in one go.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: So many ids are broadcast at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles hashed at once for one signature, pairs compared at once.
SLAB, PAIRS = 1024, 1 << 16
#: Sets that one is compared with at once; the least threshold.
PARTNERS, LEAST = 256, 50

_seeds = np.random.default_rng(20240229)
FACTORS = _seeds.integers(0, 1 << 31, SYMBOLS, np.uint32) * np.uint32(2) + np.uint32(1)
ADDED = _seeds.integers(0, 1 << 32, SYMBOLS, np.uint32)
SALTS = _seeds.integers(0, 1 << 63, INDEXED, np.uint64)


class Distances(NamedTuple):
    """How many of the indexed symbols, and of all, two signatures may differ in."""

    threshold: int
    most_errors: int
    all_errors: int

    @classmethod
    def of(cls, threshold: int, miss_rate: float = MISS_RATE) -> Distances:
        wrong = (1 - threshold / 100) * (1 - 2.0**-BITS)
        return cls(threshold, *[_least_errors(n, wrong, miss_rate / 2) for n in (INDEXED, SYMBOLS)])

    @property
    def chunks(self) -> int:
        return self.most_errors // (CHUNK_ERRORS + 1) + 1


def _least_errors(n: int, wrong: float, rate: float) -> int:
    """The least number that ``n`` trials exceed no more often than ``rate``."""
    beyond = 1.0
    for errors in range(n):
        beyond -= math.comb(n, errors) * wrong**errors * (1 - wrong) ** (n - errors)
        if beyond <= rate:
            return errors
    return n


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` numbers of ``BITS`` bits: least values of as many linear functions of the hashes."""
    least = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), SLAB):
        np.minimum(least, (short[at : at + SLAB, None] * FACTORS + ADDED).min(axis=0), out=least)
    return (mixed(least.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.uint8)


def index_keys(signatures: np.ndarray, chunks: int) -> np.ndarray:
    """The keys of each signature: every chunk without one of its symbols, for each symbol.

    A chunk's key is a sum over its symbols, so leaving one out is a subtraction.
    """
    starts = np.arange(chunks) * INDEXED // chunks
    of = np.searchsorted(starts, np.arange(INDEXED), side="right") - 1
    parts = mixed(signatures[:, :INDEXED].astype(np.uint64) + SALTS)
    sums = np.add.reduceat(parts, starts, axis=1)
    return mixed(sums[:, of] - parts + SALTS[::-1]).view(np.int64)


def signed(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set and ``signature`` of each of ``docs``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for shingles in shingle_sets(batch.column(1), width):
                sizes.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                signatures.append(signature(shingles).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "digest", "signature"])
        release_memory()

    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return read.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, signature binary")


def keyed(classes: DataFrame, chunks: int) -> DataFrame:
    """``key`` and ``uid``: a row for each key of each class."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = index_keys(_matrix(batch.column(1)), chunks)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(keys) + 1) * INDEXED, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["uid", "keys"])

    entered = classes.select("uid", "signature").mapInArrow(enter, "uid long, keys array<long>")
    return entered.select("uid", F.explode("keys").alias("key"))


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, SYMBOLS)


def close_pairs(pairs: DataFrame, classes: DataFrame, distances: Distances) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) within the signature distance and of fitting sizes."""
    of, threshold, most = classes.select("uid", "signature", "n_shingles"), distances.threshold, distances.all_errors
    both = (
        pairs.join(of.withColumnsRenamed({"uid": "a", "signature": "sa", "n_shingles": "na"}), "a")
        .join(of.withColumnsRenamed({"uid": "b", "signature": "sb", "n_shingles": "nb"}), "b")
        .filter(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
        .select("a", "b", "sa", "sb")
    )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                errors = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(axis=1)
                yield batch.select([0, 1]).filter(pa.array(errors <= most))

    return both.mapInArrow(near, "a long, b long")


def full_sets(ids: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """``id`` and sorted ``shingles`` of the documents in ``ids`` (one column, distinct)."""
    wanted = stage(ids.toDF("_wanted"))
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(
        F.broadcast(wanted) if few else wanted, F.col("id") == F.col("_wanted"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])
        release_memory()

    return stage(texts.mapInArrow(sets, "id long, shingles array<long>").dropDuplicates(["id"]))


def confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, threshold: int) -> DataFrame:
    """Those of ``pairs`` whose full sets are similar enough."""
    ends = [pairs.select(F.col(end).alias("id")).distinct() for end in ("a", "b")]
    found = full_sets(ends[0].unionByName(ends[1]).distinct(), docs, doc_id, text, width)
    both = (
        pairs.join(found.withColumnsRenamed({"id": "a", "shingles": "one"}), "a")
        .join(found.withColumnsRenamed({"id": "b", "shingles": "other"}), "b")
        .withColumn("common", F.size(F.array_intersect("one", "other")))
    )
    union = F.size("one") + F.size("other") - F.col("common")
    return stage(both.filter(100 * F.col("common") >= threshold * union).select("a", "b"))


def _pairs_of_groups(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups that lie one after the other: the places of all pairs inside each."""
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    firsts, ones, others = np.cumsum(sizes) - sizes, [], []
    for first, size in zip(firsts.tolist(), sizes.tolist()):
        if size not in known:
            known[size] = np.triu_indices(size, 1)
        one, other = known[size]
        ones.append(one + first)
        others.append(other + first)
    none = np.zeros(0, np.int64)
    return np.concatenate(ones or [none]), np.concatenate(others or [none])


def _near_in_groups(table: pa.Table, distances: Distances) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of whole groups, sorted by (key, left, right): of different
    components, of fitting sizes, within the distance, and met here for the first time."""
    column = lambda name: table.column(name).to_numpy()
    component, size, block = column("component"), column("n_shingles"), column("block")
    left, right = column("left"), column("right")
    signatures = _matrix(table.column("signature").combine_chunks())
    keys = index_keys(signatures, distances.chunks)
    threshold = distances.threshold
    new = np.ones(table.num_rows, bool)
    new[1:] = (np.diff(column("key")) != 0) | (np.diff(left) != 0) | (np.diff(right) != 0)
    edges = np.append(np.flatnonzero(new), table.num_rows)
    key, found = column("key"), []
    # Groups are taken together until they make about PAIRS pairs.
    sizes = np.diff(edges)
    slabs = np.cumsum(sizes * (sizes - 1) // 2) // PAIRS
    for cut in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(slabs)) + 1):
        if not len(cut):
            continue
        base = edges[cut[0]]
        one, other = _pairs_of_groups(sizes[cut])
        one, other = one + base, other + base
        fits = component[one] != component[other]
        fits &= 100 * np.minimum(size[one], size[other]) >= threshold * np.maximum(size[one], size[other])
        # In a group of two blocks, pairs of one block belong to that block's own group.
        fits &= (left[one] == right[one]) | (block[one] != block[other])
        one, other = one[fits], other[fits]
        for at in range(0, len(one), PAIRS):
            a, b = one[at : at + PAIRS], other[at : at + PAIRS]
            near = (signatures[a, :INDEXED] != signatures[b, :INDEXED]).sum(axis=1) <= distances.most_errors
            a, b = a[near], b[near]
            near = (signatures[a] != signatures[b]).sum(axis=1) <= distances.all_errors
            a, b = a[near], b[near]
            # The first key that both have is the one that reports the pair.
            first = keys[a, (keys[a] == keys[b]).argmax(axis=1)] == key[a]
            found.append((a[first], b[first]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[f[0] for f in found]]), np.concatenate([none, *[f[1] for f in found]])


def _joining(table: pa.Table, ones: np.ndarray, others: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """The pairs of places that link their full sets and join two components that no earlier
    one of them has joined."""
    lists = table.column("shingles").combine_chunks()
    values, cuts = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sizes, component, root, links = np.diff(cuts), table.column("component").to_numpy(), {}, []

    def find(node: int) -> int:
        while root.get(node, node) != node:
            root[node] = node = root.get(root[node], root[node])
        return node

    order = np.argsort(ones, kind="stable")
    ones, others = ones[order], others[order]
    for low, high in zip(*_runs(ones)):
        one = ones[low]
        left = np.array([j for j in others[low:high] if find(component[j]) != find(component[one])], np.int64)
        mine = values[cuts[one] : cuts[one + 1]]
        for at in range(0, len(left), PARTNERS):
            some = left[at : at + PARTNERS]
            theirs = np.concatenate([values[cuts[j] : cuts[j + 1]] for j in some])
            place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            common = np.add.reduceat(mine[place] == theirs, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            for j in some[100 * common >= threshold * (len(mine) + sizes[some] - common)]:
                a, b = find(component[one]), find(component[j])
                if a != b:
                    root[a] = b
                    links.append((one, j))
    return links


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins and ends."""
    starts = np.flatnonzero(np.append(True, np.diff(values) != 0)) if len(values) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(values))


GROUP = ["key", "left", "right"]
MEMBER = [*GROUP, "block", "uid", "component", "n_shingles", "signature"]


def _by_group(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on tables of whole groups of rows that share (key, left, right)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            # The last group may go on in the next batch.
            same = np.ones(table.num_rows, bool)
            for name in GROUP:
                values = table.column(name).to_numpy()
                same &= values == values[-1]
            whole = int(table.num_rows - same[::-1].argmin()) if not same.all() else 0
            held = table.slice(whole)
            if whole:
                yield work(table.slice(0, whole))
        if held is not None and held.num_rows:
            yield work(held)
        held = None
        release_memory()

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(walk, schema)


def involved(rows: DataFrame, distances: Distances) -> DataFrame:
    """Those of ``rows`` that are in a near pair which they meet first in their group."""

    def work(table: pa.Table) -> pa.RecordBatch:
        found = np.unique(np.concatenate(_near_in_groups(table, distances)))
        some = table.take(pa.array(found, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([column.combine_chunks() for column in some.columns], some.schema.names)

    return _by_group(rows.select(*MEMBER), work, rows.select(*MEMBER).schema)


def linked(rows: DataFrame, distances: Distances) -> DataFrame:
    """``a``, ``b``: links between ``rows`` (with ``shingles``), enough to join what they join."""

    def work(table: pa.Table) -> pa.RecordBatch:
        found = _joining(table, *_near_in_groups(table, distances), distances.threshold)
        uid = table.column("uid").to_numpy()
        ends = [pa.array(uid[[pair[end] for pair in found]] if found else [], pa.int64()) for end in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return _by_group(rows.select(*MEMBER, "shingles"), work, "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = 85,
    miss_rate: float = MISS_RATE,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for each of ``docs``; documents are
    linked from ``threshold`` per cent of similarity (``LEAST`` or more) on."""
    if threshold < LEAST:
        raise ValueError(f"below {LEAST} per cent, chunks of signatures are too short to index")
    distances = Distances.of(threshold, miss_rate)
    documents = stage(signed(docs, doc_id, text, width))
    with_set = documents.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(
        with_set.groupBy("digest").agg(F.min("doc_id").alias("uid"), F.min(F.struct("n_shingles", "signature")).alias("s"))
        .select("digest", "uid", "s.n_shingles", "s.signature"))
    entries = keyed(classes, distances.chunks)
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("uid").alias("centre")).filter("members > 1")
    # Staged sides of one row a key let joins split the keys of very many documents.
    members = stage(entries.join(stage(shared), "key"))
    # First every member against the smallest of its key.
    star = members.filter("uid != centre").select(F.col("uid").alias("a"), F.col("centre").alias("b")).distinct()
    links = confirmed(stage(close_pairs(star, classes, distances)), docs, doc_id, text, width, threshold)
    found = components(links)
    # Then, in keys that still hold several components, every pair across them.
    placed = members.join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn(
        "component", F.coalesce("component", "uid"))
    sized = placed.join(classes.select("uid", "n_shingles", "signature"), "uid")
    mixed_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed_keys = stage(mixed_keys.filter("low != high").select("key"))
    in_mixed = stage(sized.join(mixed_keys, "key"))
    shingles = in_mixed.groupBy("key").agg(F.sum("n_shingles").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    block = F.pmod(F.xxhash64("uid"), blocks).cast("int")
    rows = (
        in_mixed.join(shingles, "key")
        .withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"left": F.least("block", "with"), "right": F.greatest("block", "with")})
    )
    near = stage(involved(rows, distances))
    sets = full_sets(near.select("uid").distinct(), docs, doc_id, text, width).withColumnRenamed("id", "uid")
    more = stage(linked(near.join(sets, "uid"), distances))
    every = components(links.unionByName(more))
    of_digest = classes.select("digest", "uid").join(every.withColumnRenamed("node", "uid"), "uid", "left").select(
        "digest", F.coalesce("component", "uid").alias("component"))
    joined = documents.join(of_digest, "digest", "left")
    has_links = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(has_links, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
