"""Substring dedup by suffix automata of reference shards.

A word goes if some window of ``WINDOW`` words around it also starts in a document with a
smaller id. Passages are removed by matching statistics: a suffix automaton of reference
passages, each state with the smallest document it occurs in, reads a document's words and
knows at each the longest passage that ends there.

Automata of a whole corpus have no size bound, and every document against every shard would
be quadratic. So both sides are first narrowed down, losing nothing:

1. Anchors: of each window the smallest hash of ``GRAM`` words. Equal windows have equal
   anchors, so only windows whose anchor occurs in several documents can repeat.
2. Of windows with such an anchor, runs (one anchor, consecutive windows) are compared by
   hash. A run that an earlier document has too is matched with the first of these; of first
   runs, single windows are. That gives each document the documents to be matched with, by
   one row per run, and every group of copies has but one first.

The passages of those first documents are the reference. They are dealt into shards of
about ``SHARD_WORDS`` words; the passages to be matched go to the shards of their documents,
where one automaton serves ``STREAM_WORDS`` words of them: a shard that very many documents
match is sent to as many tasks as they need. An automaton is bounded by a shard and the
longest document.

Defined results: a null text has no words; documents are compared by id, so rows that repeat
an id do not remove each other's words; a row without an id loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logtable.llm.shingles import STEP, by_bytes, mixed, window_hashes, word_hashes
from logtable.plans.staging import stage

WINDOW, GRAM = 50, 16
SHARD_WORDS, STREAM_WORDS = 50_000, 200_000
#: So many rows of two numbers are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
NOWHERE = (1 << 63) - 1


class SuffixAutomaton:
    """All passages of several word sequences, and the smallest document each occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NOWHERE]

    def _state(self, length: int, doc: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.least.append(doc)
        return len(self.length) - 1

    def _split(self, before: int, word: int, state: int, doc: int) -> int:
        """A state for the shorter passages of ``state`` that follow ``before``."""
        copy = self._state(self.length[before] + 1, doc, dict(self.next[state]), self.link[state])
        while before != -1 and self.next[before].get(word) == state:
            self.next[before][word] = copy
            before = self.link[before]
        self.link[state] = copy
        return copy

    def add(self, words: Sequence[int], doc: int) -> None:
        following, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for word in words:
            known = following[last].get(word)
            if known is not None:
                if length[known] != length[last] + 1:
                    known = self._split(last, word, known, doc)
                if doc < least[known]:
                    least[known] = doc
                last = known
                continue
            new = self._state(length[last] + 1, doc, {}, 0)
            at = last
            while at != -1 and word not in following[at]:
                following[at][word] = new
                at = link[at]
            if at != -1:
                known = following[at][word]
                link[new] = known if length[known] == length[at] + 1 else self._split(at, word, known, NOWHERE)
            last = new

    def finish(self) -> None:
        """Hand every state's smallest document to the shorter passages it ends with."""
        link, least = self.link, self.least
        for state in np.argsort(-np.array(self.length), kind="stable").tolist():
            above = link[state]
            if above >= 0 and least[state] < least[above]:
                least[above] = least[state]

    def matched(self, words: Sequence[int], doc: int, window: int) -> list[int]:
        """Where windows end whose words occur in a smaller document than ``doc``."""
        following, link, length, least = self.next, self.link, self.length, self.least
        state, size, ends = 0, 0, []
        for at, word in enumerate(words, 1):
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            step = following[state].get(word)
            if step is None:
                size = 0
                continue
            state, size = step, size + 1
            # Passages longer than the window are cut to it, so that the state is the window's.
            while length[link[state]] >= window:
                state = link[state]
            size = min(size, length[state])
            if size >= window and least[state] < doc:
                ends.append(at)
        return ends


def merged(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges put together where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def anchor_runs(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's words: for each run of windows with one anchor, the anchor's hash, the
    first window and the number of windows."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = window_hashes(hashes, gram)
    windows = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    at = windows.argmin(axis=1) + np.arange(len(windows))
    first = np.append(0, np.flatnonzero(np.diff(at)) + 1)
    return grams[at[first]], first, np.diff(np.append(first, len(at)))


_INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))


def passage_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hash of the passages from ``starts`` with ``lengths`` words."""
    powers = np.cumprod(np.append(np.uint64(1), np.full(len(hashes), STEP)))
    inverse = np.cumprod(np.append(np.uint64(1), np.full(len(hashes), _INVERSE)))
    sums = np.append(np.uint64(0), np.cumsum(hashes * powers[:-1]))
    return mixed((sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64))


def documents_of(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Each row's batch, place in it, and word hashes."""
    for batch in batches:
        for low, high in by_bytes(batch.column(text)):
            hashes, starts = word_hashes(batch.column(text).slice(low, high - low))
            for row in range(high - low):
                yield batch, low + row, hashes[starts[row] : starts[row + 1]]


def _rows(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_KEY = [("doc_id", pa.int64()), ("digest", pa.int64())]
KEY = ["doc_id", "digest"]


def _surveyed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Per document ``n_words``, the ``whole_sha256`` of its words, and its distinct anchors."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch, at, hashes in documents_of(batches, 2):
                words = (batch.column(2)[at].as_py() or "").encode().split()
                anchors = np.unique(anchor_runs(hashes, window, gram)[0]).view(np.int64)
                yield (batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), len(words),
                       hashlib.sha256(b" ".join(words)).hexdigest(), anchors)

        yield from _rows(pa.schema([*_KEY, ("n_words", pa.int64()), ("whole_sha256", pa.string()), ("anchors", pa.list_(pa.int64()))]), rows())

    return docs.mapInArrow(survey, "doc_id long, digest long, n_words long, whole_sha256 string, anchors array<long>")


def _run_rows(suspects: DataFrame, window: int, gram: int) -> DataFrame:
    """``passage`` (hash), ``doc_id``, ``digest``, ``start``, ``windows`` of runs with a shared anchor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch, at, hashes in documents_of(batches, 2):
                first, counts, passages = suspect_runs(hashes, batch.column(3)[at], window, gram)
                key = (batch.column(0)[at].as_py(), batch.column(1)[at].as_py())
                for passage, start, count in zip(passages.view(np.int64).tolist(), first.tolist(), counts.tolist()):
                    yield (passage, *key, start, count)

        yield from _rows(pa.schema([("passage", pa.int64()), *_KEY, ("start", pa.int32()), ("windows", pa.int32())]), rows())

    return suspects.select(*KEY, "text", "anchors").mapInArrow(
        find, "passage long, doc_id long, digest long, start int, windows int")


def suspect_runs(hashes: np.ndarray, shared: pa.ListScalar, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and passage hash of each run with a shared anchor."""
    anchors, first, counts = anchor_runs(hashes, window, gram)
    kept = np.isin(anchors.view(np.int64), shared.values.to_numpy())
    first, counts = first[kept], counts[kept]
    return first, counts, passage_hashes(hashes, first, counts + window - 1)


def _single_windows(suspects: DataFrame, window: int) -> DataFrame:
    """``passage``, ``doc_id``, ``digest``, ``start`` of each window in the runs listed as ``firsts``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("passage", pa.int64()), *_KEY, ("start", pa.int32())])
        for batch, at, hashes in documents_of(batches, 2):
            firsts = batch.column(3)[at].values
            starts, counts = (firsts.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            places = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            found = passage_hashes(hashes, places, np.full(len(places), window)).view(np.int64)
            n = len(places)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.full(n, batch.column(0)[at].as_py())),
                 pa.array(np.full(n, batch.column(1)[at].as_py())), pa.array(places, pa.int32())], schema=schema)

    return suspects.select(*KEY, "text", "firsts").mapInArrow(find, "passage long, doc_id long, digest long, start int")


def _passages(suspects: DataFrame, window: int, gram: int, shards: int) -> DataFrame:
    """Reference passages (``is_reference``) and passages to be matched, with their shards."""

    def shard_of(doc: int) -> int:
        return int(mixed(np.array([doc], np.int64).view(np.uint64))[0] % np.uint64(shards))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch, at, hashes in documents_of(batches, 2):
                doc, digest = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if batch.column(5)[at].as_py():
                    first, counts, _ = suspect_runs(hashes, batch.column(3)[at], window, gram)
                    ends = first + counts + window - 1
                    for low, high in merged(list(zip(first.tolist(), ends.tolist()))):
                        yield shard_of(doc), True, doc, digest, low, high - low, hashes[low:high].tobytes()
                by_ref: dict[int, list[tuple[int, int]]] = {}
                for hit in batch.column(4)[at].as_py() or []:
                    by_ref.setdefault(hit["first"], []).append((hit["start"], hit["start"] + hit["windows"] + window - 1))
                for ref, ranges in by_ref.items():
                    for low, high in merged(ranges):
                        yield shard_of(ref), False, doc, digest, low, high - low, hashes[low:high].tobytes()

        yield from _rows(pa.schema([("shard", pa.int64()), ("is_reference", pa.bool_()), *_KEY, ("start", pa.int32()),
                                    ("size", pa.int32()), ("words", pa.binary())]), rows())

    return suspects.select(*KEY, "text", "anchors", "hits", "is_reference").mapInArrow(
        deal, "shard long, is_reference boolean, doc_id long, digest long, start int, size int, words binary")


def _matches(window: int):
    def match(reference: pa.Table, stream: pa.Table) -> pa.Table:
        """What of a stream's passages occurs in smaller documents of the reference."""
        automaton = SuffixAutomaton()
        for doc, words in zip(reference.column("of_doc_id").to_pylist(), reference.column("of_words").to_pylist()):
            automaton.add(np.frombuffer(words, np.uint64).tolist(), doc)
        automaton.finish()
        found = []
        for doc, digest, start, words in zip(*(stream.column(c).to_pylist() for c in ("doc_id", "digest", "start", "words"))):
            ends = automaton.matched(np.frombuffer(words, np.uint64).tolist(), doc, window)
            found += [(doc, digest, start + low, start + high) for low, high in merged([(e - window, e) for e in ends])]
        schema = pa.schema([*_KEY, ("low", pa.int32()), ("high", pa.int32())])
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found) if found else ([],) * 4, schema)], schema=schema)

    return match


def _stripped(suspects: DataFrame) -> DataFrame:
    """Per changed document ``n_removed``, ``kept`` and ``kept_sha256``."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc, digest, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                    words, kept, at = text.encode().split(), [], 0
                    for low, high in merged([(s["low"], s["high"]) for s in spans]):
                        kept += words[at:low]
                        at = high
                    kept += words[at:]
                    joined = b" ".join(kept)
                    yield doc, digest, len(words) - len(kept), joined.decode(), hashlib.sha256(joined).hexdigest()

        yield from _rows(pa.schema([*_KEY, ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())]), rows())

    return suspects.select(*KEY, "text", "spans").mapInArrow(
        strip, "doc_id long, digest long, n_removed long, kept string, kept_sha256 string")


def _few(rows: DataFrame) -> DataFrame:
    """A table of few numbers, broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words, joined by one
    space) and ``kept`` (that text, where words were removed) for each of ``docs``."""
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    read = read.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    surveyed = stage(_surveyed(read, window, gram))
    anchors = surveyed.filter("doc_id IS NOT NULL").select(*KEY, F.explode("anchors").alias("anchor"))
    shared = stage(anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                   .filter("low != high").select("anchor"))
    of_doc = stage(anchors.join(shared, "anchor").groupBy(*KEY).agg(F.collect_set("anchor").alias("anchors")))
    ids = _few(of_doc.select("doc_id").distinct())
    # Rows that repeat an id and a text are one here.
    suspects = stage(read.join(ids, "doc_id", "left_semi").join(of_doc, KEY).dropDuplicates(KEY))

    runs = stage(_run_rows(suspects, window, gram))
    # Staged, so that a passage of very many documents can be split in the joins.
    first = stage(runs.groupBy("passage").agg(F.min("doc_id").alias("first")))
    marked = stage(runs.join(first, "passage").select(*KEY, "start", "windows", "first"))
    firsts = marked.filter("first = doc_id").groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows")).alias("firsts"))
    single = stage(_single_windows(suspects.join(firsts, KEY), window))
    earliest = single.groupBy("passage").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    again = single.join(stage(earliest.filter("first != last").select("passage", "first")), "passage").filter("first < doc_id")
    hits = stage(
        marked.filter("first < doc_id")
        .unionByName(again.select(*KEY, "start", F.lit(1).alias("windows"), "first")))
    references = stage(hits.select("first").distinct())
    reference_words = marked.join(references, F.col("doc_id") == references["first"], "left_semi").agg(F.sum("windows")).first()[0]
    shards = max(1, -(-(reference_words or 0) // SHARD_WORDS))

    of_hits = hits.groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows", "first")).alias("hits"))
    is_first = references.select(F.col("first").alias("doc_id"), F.lit(True).alias("is_reference"))
    passages = stage(_passages(
        suspects.join(of_hits, KEY, "left").join(is_first, "doc_id", "left").filter("hits IS NOT NULL OR is_reference"),
        window, gram, shards))
    salts = _few(stage(passages.filter("NOT is_reference").groupBy("shard").agg(
        F.ceil(F.sum("size") / STREAM_WORDS).cast("int").alias("salts"))))
    dealt = passages.join(salts, "shard")
    stream = dealt.filter("NOT is_reference").withColumn("salt", F.pmod(F.xxhash64(*KEY, "start"), F.col("salts")).cast("int"))
    reference = dealt.filter("is_reference").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    spans = stage(
        reference.select(*[F.col(c).alias(f"of_{c}") for c in ("shard", "salt", "doc_id", "words")]).groupBy("of_shard", "of_salt")
        .cogroup(stream.select("shard", "salt", *KEY, "start", "words").groupBy("shard", "salt"))
        .applyInArrow(_matches(window), "doc_id long, digest long, low int, high int"))
    of_spans = spans.groupBy(*KEY).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    stripped = _stripped(suspects.join(of_spans, KEY))
    # Null ids and texts are kept whole.
    renamed = stripped.withColumnsRenamed({"doc_id": "changed_id", "digest": "changed_digest"})
    same = (F.col("doc_id") == F.col("changed_id")) & (F.col("digest") == F.col("changed_digest"))
    return surveyed.drop("anchors").join(renamed, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept")
