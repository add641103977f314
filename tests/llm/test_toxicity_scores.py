"""Scores against pairs summed one by one, and the bounds of the sample."""

import math
import zlib

import numpy as np
import pytest

from logtable.llm import toxicity
from logtable.llm.toxicity import TOXIC_FROM, Model, learn, score_texts, text_terms
from tests.llm.conftest import LONG, ODD


def data(spark, n=400, extra=""):
    """Toxic where an insult meets a group; neither alone is."""
    rows = []
    for i in range(n):
        words = ["insult" if i % 2 else "praise", "group" if i // 2 % 2 else "thing", f"filler{i % 17}", f"other{i % 5}"]
        rows.append((i, " ".join(words) + extra, "insult" in words and "group" in words))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id long, toxic int").repartition(2)
    return docs, labels, rows


def margin(model, text):
    """Every weight, and every pair of factors, one by one."""
    numbers = sorted({n for n in map(model.number, text_terms(text)) if n >= 0})
    total = model.bias + math.fsum(float(model.weights[n]) for n in numbers)
    for i, a in enumerate(numbers):
        for b in numbers[i + 1 :]:
            total += math.fsum(float(x) * float(y) for x, y in zip(model.factors[a], model.factors[b]))
    return total


def test_scores_are_those_of_all_pairs(spark):
    docs, labels, rows = data(spark)
    model = learn(docs, labels)
    got = {r["doc_id"]: r for r in score_texts(docs, model).collect()}
    for i, text, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-margin(model, text))), abs=1e-4)
        assert got[i]["predicted"] == int(got[i]["score"] >= TOXIC_FROM)
    held = [(got[i]["predicted"], int(toxic)) for i, _, toxic in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_odd_texts(spark, odd):
    docs, labels, _ = data(spark)
    model = learn(docs, labels)
    got = score_texts(odd, model).collect()
    bias = 1 / (1 + math.exp(-model.bias))
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {round(r["score"], 6) for r in got if r["doc_id"] in (1, 2, 3)} == {round(bias, 6)}


def test_packed_models_keep_their_numbers():
    model = Model({5: 0, 9: 1}, 0.5, np.array([0.25, -1.0]), np.ones((2, 8)), np.array([-1, 1, 0], np.int64))
    again = Model.unpacked(model.packed())
    assert [again.number(t) for t in (5, 9, 1, 2, 3)] == [model.number(t) for t in (5, 9, 1, 2, 3)]
    assert again.margin([0, 1]) == pytest.approx(model.margin([0, 1]))


@pytest.mark.parametrize("most", [30, 300, 10**6])
def test_sampled_rows_are_whole_and_within_the_numbers(spark, monkeypatch, most):
    docs, labels, rows = data(spark, 60, " " + LONG[:2000])
    seen = spark.sparkContext.accumulator(0)
    sizes = spark.sparkContext.accumulator(0)
    real = toxicity.fit_linked_then_all

    def watched(held, found, linked):
        seen.add(len(held))
        sizes.add(sum(map(len, held)))
        return real(held, found, linked)

    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "STEPS", 1)
    monkeypatch.setattr(toxicity, "fit_linked_then_all", watched)
    model = learn(docs, labels, sample_numbers=most)
    learnable = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)
    assert sizes.value <= most and (model is None) == (seen.value == 0)
    assert seen.value == (learnable if most == 10**6 else seen.value) and seen.value < learnable + 1


def test_few_rows_learn_from_all_terms(spark):
    docs, labels, _ = data(spark, 12)
    model = learn(docs, labels)
    assert len(model.weights) > 0 and model.buckets is not None
