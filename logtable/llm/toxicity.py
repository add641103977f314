"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words, lower-cased, and the first letters of its longer words (so an
unseen inflection of an insult still meets a known stem), each hashed to 32 bits; a term
counts once per text. The score is the logistic function of
``bias + sum of w_i + sum over pairs of <v_i, v_j>``: the pair weights learn combinations,
such as an insult with the mention of a group, that adding up single weights would miss.

The model is fitted on a bounded sample of the labelled rows, ``sample_rows`` of them chosen
by the hash of their id. Every term found in ``MIN_ROWS`` of them takes part, whatever its own
link with the label, as a term may matter only beside another: those with a link (chi-square
test; ``max_terms`` of them at most) have a number each and are fitted first, all others are
hashed into ``BUCKETS`` numbers and join them in a second fit, in small steps. A tenth of the
sample tells how many passes of the second fit are best (of fewer than ``2 * CHECKED`` rows
none is set apart, and it makes ``EPOCHS`` passes). The sample's rows are taken whole, in the
order of the hash, while they hold ``sample_numbers`` numbers at most; one task fits them, so a
lost executor costs a new fit and the driver sees no row of the sample. The model that it
passes on and broadcasts is bounded by ``max_terms`` and ``BUCKETS``. Scoring reads every whole
text.

Defined results: a null or empty text has no terms and gets the bias alone; without any
labelled row all scores are 0; an id labelled more than once is toxic if any row says so; a
null label is no label; of rows that repeat a labelled id, the sample takes the one whose
text has the least hash; rows that repeat are scored alike.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logtable.llm.common import release_memory
from logtable.plans.staging import stage

LETTERS = re.compile(r"[^\W\d_]+")
STEM = 4
TOXIC_FROM = 0.5
SAMPLE_ROWS, SAMPLE_NUMBERS, MAX_TERMS, MIN_ROWS = 20_000, 8_000_000, 4096, 3
#: Chi-square at one degree of freedom that chance exceeds once in a hundred thousand times.
CHI_SQUARE = 19.5
RANK, EPOCHS, STEPS, BATCH, RATE, DECAY = 8, 12, 800, 256, 0.1, 1e-4
#: Numbers that the terms without a link of their own share; numbers of one batch at most.
BUCKETS, ENTRIES = 1 << 18, 1 << 19
#: The second fit: one row in so many tells its passes; its rate times the terms of a text; first factors.
CHECKED, STRIDE, SPREAD = 10, 1.0, 0.01
#: Words whose terms a task remembers.
REMEMBERED = 200_000


def word_terms(word: str) -> tuple[int, ...]:
    whole = zlib.crc32(word.encode())
    return (whole, zlib.crc32(b"^" + word[:STEM].encode())) if len(word) > STEM else (whole,)


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def text_terms(text: str | None) -> set[int]:
    return {term for word in words_of(text) for term in word_terms(word)}


class Model(NamedTuple):
    """``terms`` maps a hashed term to its row in ``weights`` and ``factors``; ``buckets`` has the
    row of each bucket of other terms, -1 for none."""

    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    buckets: np.ndarray | None = None

    def packed(self) -> bytes:
        """The model as bytes, with single-precision factors."""
        buckets = None if self.buckets is None else self.buckets.astype(np.int32)
        # A plain tuple: tasks know this class by value, not by name.
        return pickle.dumps((self.terms, self.bias, self.weights.astype(np.float32), self.factors.astype(np.float32), buckets), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> Model:
        return cls(*pickle.loads(data))

    def number(self, term: int) -> int:
        found = self.terms.get(term, -1)
        return found if found >= 0 or self.buckets is None else int(self.buckets[term % len(self.buckets)])

    def margin(self, rows: list[int]) -> float:
        vectors = self.factors[rows]
        total = vectors.sum(axis=0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * (total @ total - (vectors * vectors).sum()))


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, terms: list[int], seed: int = 7) -> Model:
    """Logistic loss, AdaGrad, ``EPOCHS`` passes in a fixed random order, and ``STEPS`` steps at
    least. ``rows`` hold term numbers."""
    order_of = np.random.default_rng(seed)
    size = len(terms)
    weights, factors = np.zeros(size), order_of.normal(0, 0.05, (size, RANK))
    positive = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    bias = float(np.log(positive / (1 - positive)))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(rows))))):
        order = order_of.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = np.array([len(rows[i]) for i in some])
            index = np.concatenate([rows[i] for i in some]) if sizes.sum() else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(some)), sizes)
            vectors = factors[index]
            total = np.zeros((len(some), RANK))
            np.add.at(total, doc, vectors)
            squares = np.bincount(doc, (vectors * vectors).sum(axis=1), len(some))
            margin = bias + np.bincount(doc, weights[index], len(some)) + 0.5 * ((total * total).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]
            touched, place = np.unique(index, return_inverse=True)
            step_w = np.bincount(place, error[doc], len(touched)) + DECAY * weights[touched]
            step_v = np.zeros((len(touched), RANK))
            np.add.at(step_v, place, error[doc][:, None] * (total[doc] - vectors))
            step_v += DECAY * factors[touched]
            seen_w[touched] += step_w * step_w
            seen_v[touched] += step_v * step_v
            weights[touched] -= RATE * step_w / np.sqrt(seen_w[touched])
            factors[touched] -= RATE * step_v / np.sqrt(seen_v[touched])
            step_b = error.sum()
            seen_b += step_b * step_b
            bias -= RATE * step_b / np.sqrt(seen_b)
    return Model({term: i for i, term in enumerate(terms)}, float(bias), weights, factors)


def _batches(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of ``order`` of ``BATCH`` rows and ``ENTRIES`` numbers at most, or of one row."""
    at = entries = 0
    for place, size in enumerate(sizes[order].tolist()):
        if place > at and (place - at == BATCH or entries + size > ENTRIES):
            yield order[at:place]
            at, entries = place, 0
        entries += size
    if at < len(order):
        yield order[at:]


def _margins(model: Model, index: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of each entry, their sum for each of ``n`` texts, and the texts' margins."""
    vectors = model.factors[index]
    total = np.stack([np.bincount(doc, vectors[:, j], n) for j in range(RANK)], axis=1)
    squares = np.bincount(doc, (vectors * vectors).sum(axis=1), n)
    return vectors, total, model.bias + np.bincount(doc, model.weights[index], n) + 0.5 * ((total * total).sum(axis=1) - squares)


def fit_all(
    start: Model, rows: list[np.ndarray], labels: np.ndarray, size: int, passes: int,
    checked: tuple[list[np.ndarray], np.ndarray] | None = None, seed: int = 7,
) -> tuple[Model, list[float]]:
    """``start`` fitted further, with terms up to ``size``: AdaGrad in steps so small that all
    terms of a text together move its margin little. Also the mean loss of the ``checked`` rows
    and labels before the first pass and after each."""
    order_of = np.random.default_rng(seed)
    new = size - len(start.weights)
    weights = np.concatenate([start.weights, np.zeros(new)])
    factors = np.concatenate([start.factors, order_of.normal(0, SPREAD, (new, RANK))])
    model, losses = start._replace(weights=weights, factors=factors), []
    seen_w, seen_v, seen_b = np.ones(size), np.ones((size, RANK)), 1.0
    sizes = np.array([len(r) for r in rows], np.int64)
    rate = min(RATE, STRIDE / max(1.0, float(sizes.mean()))) if len(rows) else RATE
    place_of = np.zeros(size, np.int64)

    def together(some: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        some = list(some)
        return np.concatenate([*some, np.zeros(0, np.int64)]), np.repeat(np.arange(len(some)), [len(r) for r in some])

    def check(model: Model) -> None:
        if checked is not None:
            of = np.array([len(r) for r in checked[0]], np.int64)
            margins = [_margins(model, *together(checked[0][i] for i in some), len(some))[2]
                       for some in _batches(np.arange(len(of)), of)]
            losses.append(float(np.logaddexp(0, np.where(checked[1] > 0, -1, 1) * np.concatenate(margins)).mean()))

    # Without a pass, the terms that are new count nothing.
    check(start._replace(weights=weights, factors=np.concatenate([start.factors, np.zeros((new, RANK))])))
    for _ in range(passes):
        for some in _batches(order_of.permutation(len(rows)), sizes):
            index, doc = together(rows[i] for i in some)
            vectors, total, margin = _margins(model, index, doc, len(some))
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]
            touched = np.flatnonzero(np.bincount(index, minlength=size))
            place_of[touched] = np.arange(len(touched))
            place, each = place_of[index], error[doc]
            step_w = np.bincount(place, each, len(touched)) + DECAY * weights[touched]
            step_v = DECAY * factors[touched]
            for j in range(RANK):
                step_v[:, j] += np.bincount(place, each * (total[doc, j] - vectors[:, j]), len(touched))
            seen_w[touched] += step_w * step_w
            seen_v[touched] += step_v * step_v
            weights[touched] -= rate * step_w / np.sqrt(seen_w[touched])
            factors[touched] -= rate * step_v / np.sqrt(seen_v[touched])
            step_b = error.sum()
            seen_b += step_b * step_b
            model = model._replace(bias=float(model.bias - rate * step_b / np.sqrt(seen_b)))
        check(model)
    return model, losses


def fit_linked_then_all(rows: list[np.ndarray], labels: np.ndarray, linked: list[int]) -> Model:
    """A model of all numbers in ``rows``: below ``len(linked)`` those of the linked terms, from
    there on those of buckets."""
    n = len(linked)
    found = np.zeros(n + BUCKETS, np.int64)
    for row in rows:
        found[row] += 1
    kept = np.flatnonzero(found[n:] >= MIN_ROWS)
    buckets = np.full(BUCKETS, -1, np.int64)
    buckets[kept] = n + np.arange(len(kept))
    rows = [np.concatenate([r[r < n], buckets[r[r >= n] - n]]) for r in rows]
    rows = [r[r >= 0] for r in rows]
    passes = max(EPOCHS, -(-STEPS // -(-len(rows) // BATCH)))

    def fit(chosen: np.ndarray, passes: int, checked=None) -> tuple[Model, list[float]]:
        some, of = [rows[i] for i in chosen], labels[chosen]
        start = fit_machine([r[r < n] for r in some], of, linked)
        return fit_all(start._replace(buckets=buckets), some, of, n + len(kept), passes, checked) if passes else (start, [])

    every = np.arange(len(rows))
    last = np.random.default_rng(11).permutation(len(rows)) % CHECKED == 0
    if len(rows) < 2 * CHECKED:
        return fit(every, EPOCHS)[0]
    _, losses = fit(every[~last], passes, ([rows[i] for i in every[last]], labels[last]))
    return fit(every, int(np.argmin(losses)))[0]


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is kept from learning."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS, sample_numbers: int = SAMPLE_NUMBERS,
) -> Model | None:
    """A model from the labelled rows that are not held out; none without such rows."""
    chosen = (
        labels.filter(~held_out(doc_id)).filter(F.col(label).isNotNull())
        .groupBy(F.col(f"`{doc_id}`").alias("_label_id")).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample_rows)
    )
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    # sample_rows rows of two numbers are broadcast.
    labelled = texts.join(F.broadcast(chosen), F.col("id") == F.col("_label_id")).select(
        "_label", "text", F.xxhash64("_label_id").alias("of"), F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("place"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted(text_terms(t.as_py())), np.int64) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(found, pa.list_(pa.int64())), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["label", "terms", "of", "hash", "place"])
        release_memory()

    every = stage(labelled.mapInArrow(terms, "label int, terms array<long>, of long, hash long, place long"))
    # An id that repeats gives one row, so that sample_rows bounds what is collected. Aggregating
    # numbers alone needs no sort of texts.
    one = every.groupBy("of", "hash").agg(F.min("place").alias("place")).groupBy("of").agg(
        F.min_by("place", "hash").alias("place"))
    # A row has no more numbers than terms, nor than there are numbers. Both tables have
    # sample_rows rows at most.
    size = F.least(F.size("terms"), F.lit(max_terms + BUCKETS)).cast("long")
    so_far = F.sum("size").over(Window.orderBy("of"))
    within = every.select("place", "of", size.alias("size")).join(F.broadcast(one.select("place")), "place", "left_semi")
    within = within.withColumn("so_far", so_far).filter(F.col("so_far") <= sample_numbers).select("place")
    sample = stage(every.join(F.broadcast(within), "place", "left_semi").select("label", "terms"))
    rows, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not rows:
        return None
    with_term = sample.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("label").alias("hit"), F.count(F.lit(1)).alias("n"))
    # Chi-square of the two-by-two table of term and label.
    a, n, p = F.col("hit").cast("double"), F.col("n").cast("double"), float(toxic)
    cross = a * float(rows) - n * p
    chi = cross * cross * float(rows) / (n * (float(rows) - n + 1e-9) * max(p, 1e-9) * max(rows - p, 1e-9))
    kept = [r["term"] for r in with_term.filter(f"n >= {MIN_ROWS}").withColumn("chi", chi)
            .filter(F.col("chi") >= CHI_SQUARE).orderBy(F.desc("chi"), "term").limit(max_terms).collect()]
    number = {term: i for i, term in enumerate(kept)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One row's numbers at a time are Python objects.
            found = [np.array(sorted({number.get(t, len(number) + t % BUCKETS) for t in row.as_py()}), np.int32).tobytes()
                     for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["label", "numbers"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, held = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            held += [np.frombuffer(row.as_py(), np.int32).astype(np.int64) for row in batch.column(1)]
        model = fit_linked_then_all(held, np.array(labels, float), kept)
        yield pa.RecordBatch.from_arrays([pa.array([model.packed()], pa.binary())], ["model"])
        del held, model
        release_memory()

    # In an order that does not depend on files or tasks.
    numbered = sample.mapInArrow(numbers, "label int, numbers binary").repartition(1).sortWithinPartitions("numbers", "label")
    return Model.unpacked(bytes(stage(numbered.mapInArrow(fit, "model binary")).first()["model"]))


def scorer(spark: SparkSession, model: Model | None):
    """A function of a text column: its score."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, remembered = shared.value, {}

        def numbers(word: str) -> tuple[int, ...]:
            if len(remembered) > REMEMBERED:
                remembered.clear()
            found = remembered[word] = tuple(n for n in map(model.number, word_terms(word)) if n >= 0)
            return found

        def probability(text: str | None) -> float:
            if model is None:
                return 0.0
            found = {n for word in words_of(text) for n in (remembered[word] if word in remembered else numbers(word))}
            return 1 / (1 + math.exp(-min(max(model.margin(sorted(found)), -700.0), 700.0)))

        for texts in batches:
            yield pa.array([probability(t.as_py()) for t in texts], pa.float64())
        remembered.clear()
        release_memory()

    return score


def score_texts(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each of ``docs``."""
    scored = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"),
        scorer(docs.sparkSession, model)(F.col(f"`{text}`").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))
