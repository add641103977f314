import random

import numpy as np
from pyspark.sql import functions as F

from logtable.llm import toxicity
from logtable.llm.queries import op3_toxicity
from logtable.llm.toxicity import fit_machine, learn, score_texts, text_terms
from tests.llm.conftest import by_id


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = op3_toxicity(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 300
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_pairs_are_learnt():
    """Terms that are toxic with one term and harmless with another, which no sum of weights tells apart."""
    cases = [[0, 2], [1, 3], [0, 3], [1, 2]]
    model = fit_machine([np.array(r, np.int64) for r in cases * 200], np.array([1, 1, 0, 0] * 200, float), [10, 11, 12, 13])
    margins = [model.margin(r) for r in cases]
    assert min(margins[:2]) > 1 and max(margins[2:]) < -1


def test_pairs_are_learnt_from_documents(spark, docs):
    """No term goes with the label by itself, so that a choice by single terms would keep none."""
    dealt, cases = random.Random(5), ["aa cc", "bb dd", "aa dd", "bb cc"]
    for filler in (0, 15):
        rows = [(i, " ".join([cases[i % 4], *dealt.sample([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)], filler)]), "s")
                for i in range(1000)]
        labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i, _, _ in rows], "doc_id long, toxic int")
        frame = docs(rows)
        held = score_texts(frame, learn(frame, labels)).filter("held_out").collect()
        assert len(held) > 100 and np.mean([r["predicted"] == (r["doc_id"] % 4 < 2) for r in held]) > 0.95


def test_labels_of_held_out_rows_are_not_read(spark, docs):
    dealt = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(dealt.choices(words, k=20)) + (" slur" if i % 4 == 0 else ""), "s") for i in range(400)]
    frame = docs(rows)
    held = {r["doc_id"] for r in frame.select("doc_id").filter(F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0")).collect()}
    true = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    false = spark.createDataFrame([(i, 1 - int(i % 4 == 0) if i in held else int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    one, other = by_id(score_texts(frame, learn(frame, true)), "score"), by_id(score_texts(frame, learn(frame, false)), "score")
    assert one == other
    assert all((s >= 0.5) == (i % 4 == 0) for i, s in one.items())
    assert {i for i, h in by_id(score_texts(frame, None), "held_out").items() if h} == held


def test_the_sample_bounds_the_rows(spark, docs, monkeypatch):
    seen, fit = spark.sparkContext.accumulator(0), toxicity.fit_linked_then_all
    monkeypatch.setattr(toxicity, "fit_linked_then_all", lambda rows, *rest: seen.add(len(rows)) or fit(rows, *rest))
    rows = [(1 if i < 500 else i, f"some words {chr(97 + i % 26)}", "s") for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in {i for i, _, _ in rows}], "doc_id long, toxic int")
    learn(docs(rows), labels, sample_rows=200)
    assert 0 < seen.value <= 101


def test_odd_documents_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, None), (5, 0), (99, 1), (None, 1)], "doc_id long, toxic int")
    scores = score_texts(odd, learn(odd, labels)).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    empty = labels.filter("false")
    assert learn(odd, empty) is None
    assert set(by_id(score_texts(odd, None), "score").values()) == {0.0}
    assert score_texts(none, learn(none, labels)).count() == 0


def test_terms():
    assert text_terms(None) == text_terms("") == text_terms("12 _ !") == set()
    assert text_terms("Word word WORD") == text_terms("word")
    assert text_terms("wordy") & text_terms("wording")
