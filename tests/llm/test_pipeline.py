"""Each stage of the corpus pipeline against what it must do to its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from logtable.plans.staging import stage
from tests.llm.test_near_dedup import expected as near_groups

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and gave."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, function in pipeline.STAGES:
        made = stage(function(spark, docs, SF_DIR))
        out[name] = (docs, made)
        docs = made
    return out


def rows(frame):
    return [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]


def test_columns_and_order(stages):
    assert list(stages) == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(made.columns == columns for name, (_, made) in stages.items() if name != "packing")
    for name in ("line dedup", "mixing"):
        assert stages[name][1].filter(F.col("n_chars") != F.char_length("text")).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = ({r[0] for r in rows(f)} for f in stages["toxicity"])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    gone = before - after
    assert gone and all(labels.get(i, 1) for i in gone) and after < before


def test_frequent_lines_go(stages):
    before, after = ({r[0]: r[1] for r in rows(f)} for f in stages["line dedup"])
    counts = {}
    key = lambda line: line.strip(" \t\n\x0b\f\r")
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    for text in before.values():
        for k in {lower(key(x)) for x in text.split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    assert after == {
        i: "\n".join(x for x in t.split("\n") if not key(x) or counts[lower(key(x))] < 10) for i, t in before.items()}


def test_one_of_each_group_stays(stages):
    before, after = stages["near dedup"]
    groups = near_groups(rows(before))
    assert {r[0] for r in rows(after)} == set(groups.values())


def test_mix_repeats_documents(stages):
    before, after = ({}, {})
    for made, frame in zip((before, after), stages["mixing"]):
        for i, text, source in rows(frame):
            made.setdefault(source, []).append((i, text))
    total = sum(len(t.split()) for docs in before.values() for _, t in docs)
    taken = sum(len(t.split()) for docs in after.values() for _, t in docs)
    assert abs(taken / total - 1) < 0.1
    assert all(after[s].count(d) <= 3 and d in before[s] for s in after for d in after[s])


def test_packing_takes_every_copy(stages):
    docs, packed = stages["packing"]
    assert packed.filter("piece = 0").count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).filter(
        "n > 4096 OR n != end").count() == 0


def test_run_is_its_stages(spark, stages):
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(tuple, pipeline.run(spark, SF_DIR).select(kept).collect())) == sorted(map(tuple, stages["packing"][1].select(kept).collect()))


def test_odd_documents(spark, docs, odd, none):
    for _, function in pipeline.STAGES:
        assert function(spark, none, SF_DIR).count() == 0
        assert function(spark, odd, SF_DIR).count() >= 0
    frame = docs([(i, f"text number {i} " + " ".join(random.Random(i).choices("abcdefg", k=30)), None) for i in range(30)])
    for _, function in pipeline.STAGES:
        frame = stage(function(spark, frame, SF_DIR))
    assert frame.count() >= 25
