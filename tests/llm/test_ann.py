import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtable.llm import ann
from logtable.llm.queries import op2_ann


def brute(rows, k=5):
    """Per query its k nearest rows, nearest first, ties to the smaller id."""
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in (i for i in good if i % 50 == 0):
        scores = [(-float(np.dot(good[q], v) / math.sqrt(good[q] @ good[q]) / math.sqrt(v @ v)), i) for i, v in good.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scores)[:k]]
    return out


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_and_scores(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    vectors, expected, found = dict(rows), brute(rows), answers(op2_ann(spark, sf_dir))
    assert set(found) == set(expected) and all(len(f) == 5 for f in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.95 * 5 * len(expected)
    for q, near in found.items():
        for i, score in near:
            a, b = np.array(vectors[q], float), np.array(vectors[i], float)
            assert score == pytest.approx(float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), abs=1e-12)


def test_odd_vectors(spark, monkeypatch):
    dealt = np.random.default_rng(1)
    rows = [(i, dealt.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # copies, more than k + 1
    rows += [(300, rows[3][1]), (300, rows[3][1]), (350, [2 * x for x in rows[3][1]])]
    rows += [(400, None), (450, []), (500, [0.0] * 6), (550, [None] * 6), (600, [math.nan] * 6), (650, [math.inf] * 6), (700, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("clash")).withColumn("uid", F.lit(1))
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    found = answers(ann.nearest(frame, F.col("vec_id") % 50 == 0, select=9.0))
    filled = [(i, v + [0.0] * (6 - len(v)) if v else v) for i, v in dict(rows).items()]
    expected = brute(filled)
    assert set(found) == set(expected)
    for q, near in expected.items():
        assert [i for i, _ in found[q]] == [i for i, _ in near]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in near])


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], schema)
    assert [i for i, _ in answers(ann.nearest(three, F.col("vec_id") % 50 == 0))[0]] == [1, 2]
    one = spark.createDataFrame([(0, [1.0, 0.0])], schema)
    assert ann.nearest(one, F.col("vec_id") % 50 == 0).count() == 0


def test_graph_finds_the_nearest():
    dealt = np.random.default_rng(2)
    centroids = dealt.normal(size=(600, 16))
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    vectors = dealt.normal(size=(200, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids, dots = ann.CentroidGraph(centroids).search(vectors, 1.0, 8)
    true = np.argsort(-(vectors @ centroids.T), axis=1)
    assert (ids[:, 0] == true[:, 0]).mean() > 0.98
    assert np.allclose(dots[:, 0], (vectors * centroids[ids[:, 0]]).sum(axis=1), atol=1e-5)
