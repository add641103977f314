"""Line dedup, mixing and chat format: Spark expressions only."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logtable.llm import queries
from logtable.llm.chat import CLOSE, format_chats, read_chats
from logtable.llm.line_dedup import LineRuns, drop_frequent_lines
from logtable.llm.mixing import mix_sources, source_targets
from logtable.llm.queries import op7_line_dedup, op8_mixing, op9_chat_format
from tests.llm.conftest import by_id

SF_DIR = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\f\r"


@pytest.mark.parametrize("query", [op7_line_dedup, op8_mixing, op9_chat_format])
def test_no_python_in_the_plan(spark, query):
    plan = query(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (5, 2), (6, 3)])
def test_lines(docs, batches, fan_out):
    dealt = random.Random(batches)
    pool = ["Licence A", " licence a\t", "RARE", "ÄRGER", "ärger", "", "  ", "menu | home"]
    rows = [(i, "\n".join(dealt.choices([*pool, f"own {i}"], k=dealt.randrange(6))), "s") for i in range(60)] + [(90, None, "s")]
    found = {r["doc"]["doc_id"]: r for r in drop_frequent_lines(docs(rows), min_docs=10, batches=batches, fan_out=fan_out).collect()}
    key = lambda line: lower(line.strip(SPACES))
    counts = {}
    for _, text, _ in rows:
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            counts[k] = counts.get(k, 0) + 1
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if counts.get(key(x), 0) < 10]
        assert (found[i]["kept"], found[i]["n_lines"], found[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
        assert found[i]["doc"]["digest"] == "digest"


def test_runs_are_merged_level_by_level(spark):
    store = LineRuns(spark, closed_at=3, fan_out=2, buckets=2)
    batch = lambda *hashes: spark.createDataFrame([(h,) for h in hashes], "h long")
    for hashes, levels in (((1, 1, 1, 2), [1]), ((1, 2, 3), [0, 1]), ((2, 4), [1, 1]), ((1, 5, 5), [0, 0, 1])):
        store.add(batch(*hashes))
        assert [len(level) for level in store.levels] == levels
    # Line 1 was closed after the first batch and not counted again.
    merged = {r["h"]: r["n"] for r in store.runs()[0].collect()}
    assert merged == {1: 3, 2: 3, 3: 1, 4: 1, 5: 2}
    assert {r["h"] for r in store.frequent().collect()} == {1, 2}
    store.drop()


def test_lines_of_odd_documents(odd, none):
    found = drop_frequent_lines(odd, min_docs=2)
    assert found.count() == odd.count()
    kept = {r["doc"]["doc_id"]: r["kept"] for r in found.collect()}
    assert kept[1] == kept[2] == "" and kept[3] == " \t\n\x0b\f\r " and kept[4] == kept[5] == kept[6] == "" and len(kept[9]) == 200_000
    assert drop_frequent_lines(none).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark, docs):
    rows = [(1, f"shared\nrow {i}", "a") for i in range(10)] + [(2, "shared\nother", "a"), (3, "every\n3", "a"), (4, "every\n4", "a")]
    kept = {r["kept"] for r in drop_frequent_lines(docs(rows), min_docs=3).collect()}
    assert kept == {t for _, t, _ in rows}
    kept = {r["kept"] for r in drop_frequent_lines(docs(rows), min_docs=2).collect()}
    assert kept == {f"row {i}" for i in range(10)} | {"other", "3", "4"}
    alone = docs([(None, "every\na", "a"), (None, "every\nb", "a")])
    assert {r["kept"] for r in drop_frequent_lines(alone, min_docs=2).collect()} == {"a", "b"}


def test_failed_steps_leave_no_run_behind(spark, docs, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(LineRuns, "frequent", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        drop_frequent_lines(docs([(1, "a\nb", "x"), (2, "a", "x")]), min_docs=2)
    assert {t.name for t in spark.catalog.listTables()} == before


def reshared(sizes, cap=3, weights=(1, 2, 3)):
    """Targets by sharing the excess again until none is above its cap."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    fixed = {}
    while True:
        rest, open_ = sum(sizes) - sum(fixed.values()), [i for i in range(len(sizes)) if i not in fixed]
        share = {i: rest * weight[i] / sum(weight[j] for j in open_) for i in open_}
        above = [i for i in open_ if share[i] > cap * sizes[i] + 1e-9]
        if not above:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in above}


@pytest.mark.parametrize("sizes", [[10], [5, 5, 5], [1000, 1, 1], [1, 1000, 3, 500, 2, 80], [100, 0, 7], [7, 1, 1, 1, 1, 90], [0, 0]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", size) for i, size in enumerate(sizes)]
    found = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert [found[s] for s, _ in rows] == pytest.approx(reshared(sizes))


def test_mix_takes_the_targets(docs):
    dealt = random.Random(6)
    rows = [(i, " ".join(["w"] * dealt.randrange(200)), dealt.choice(["a"] * 9 + ["b", None, "Z"])) for i in range(600)]
    frame = docs(rows)
    found = mix_sources(frame, block_words=16).collect()
    assert len(found) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    by_source = {}
    for r in found:
        s = by_source.setdefault(r["source"], [r["target"], 0, 0, r["source_size"]])
        s[1] += r["taken"]
        s[2] += r["size"]
    for target, taken, size, source_size in by_source.values():
        assert size == source_size and abs(taken - target) <= 64
    order = sorted(by_source, key=lambda s: (s is None, s))
    assert [by_source[s][0] for s in order] == pytest.approx(reshared([by_source[s][2] for s in order]))
    again = {(r["doc_id"], r["taken"]) for r in mix_sources(frame.repartition(7), block_words=16).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in found}


def test_small_sources_come_near_their_targets(docs):
    """Forty sources of ten words beside a large one: none takes nothing, or far from its target."""
    rows = [(i, "ten words " * 5, f"s{i:02}") for i in range(40)] + [(100 + i, "w " * 500, "zz") for i in range(60)]
    rows += [(900 + i, "word " * 37, "y") for i in range(3)]
    found = mix_sources(docs(rows), block_words=64).collect()
    by_source = {}
    for r in found:
        by_source.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert len(by_source) == 42 and all(r["taken"] <= 3 * r["size"] for r in found)
    for source, (target, taken) in by_source.items():
        assert taken > 0 and abs(taken - target) <= (32 if source == "zz" else 20), (source, target, taken)


def test_slots_of_one_source_a_document(spark, docs):
    rows = [(i, "a few words here", f"s{i}") for i in range(3000)]
    found = mix_sources(docs(rows), block_words=64).collect()
    assert len(found) == 3000 and abs(sum(r["taken"] for r in found) - sum(r["target"] for r in found)) <= 3000 * 2


def test_mix_of_odd_documents(odd, none):
    found = mix_sources(odd)
    assert found.count() == odd.count()
    assert by_id(found, "size") == {1: 0, 2: 0, 3: 0, 4: 2, 5: 2, 6: 60_000, 7: 60_000, 8: 6, 9: 1, None: 2}
    assert all(r["taken"] <= 3 * r["size"] for r in found.collect())
    assert mix_sources(none).count() == 0


CHATS = [
    (1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "a\\s\\h<part/>#\n"), (1, 2, "assistant", ""),
    (1, 3, "a: b\\n\n### x", None), (1, 4, None, "</turn>\n### user: "), (2, None, "assistant", "no turn"),
    (2, 7, "assistant", "x"), (2, 7, "assistant", "x"), (None, 0, "user", "no id"), (3, 0, "user", "é日本" * 50_000),
    *[(4, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(1100)],
]


def test_chats_read_back(spark):
    frame = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    frame = frame.selectExpr("*", "1 AS run", "'x' AS formatted", "2 AS turns").repartition(5)
    formatted = format_chats(frame)
    found = {r["conv_id"]: r for r in read_chats(formatted).collect()}
    spans = {r["conv_id"]: r["loss_spans"] for r in formatted.collect()}
    for conv in {c for c, *_ in CHATS}:
        rows = sorted((r for r in CHATS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in found[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in rows]
        text = found[conv]["formatted"]
        learnt = [text[s["start"] : s["start"] + s["length"]] for s in spans[conv]]
        plain = [t.replace("\\l", "<").replace("\\h", "#").replace("\\s", "\\") for t in learnt]
        assert plain == [r[3] or "" for r in rows if r[2] == "assistant"]
        blocks = 1 + sum((a[2] or "") != (b[2] or "") for a, b in zip(rows, rows[1:]))
        assert text.count(CLOSE) == blocks
    assert format_chats(frame.filter("false")).count() == 0


def test_the_loss_is_what_the_spans_mark(spark, monkeypatch):
    shifted = "transform(loss_spans, s -> named_struct('start', s.start + 1, 'length', s.length))"
    doubled = "flatten(array(loss_spans, loss_spans))"
    digests = lambda: {r["conv_id"]: r["loss_sha256"] for r in op9_chat_format(spark, SF_DIR).collect()}
    true = digests()
    for wrong in (shifted, doubled):
        monkeypatch.setattr(queries, "format_chats", lambda t: format_chats(t).selectExpr("conv_id", "formatted", f"{wrong} AS loss_spans"))
        assert digests()[-7] != true[-7]


def test_long_and_wide_loss_texts(spark):
    texts = ["<\U0001f600#" * 3000, "", "x" * 4096, "\U0001f600", "a\nb\\" * 5000]
    rows = [(1, 2 * i + j, role, text) for i, text in enumerate(texts) for j, role in enumerate(("user", "assistant"))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert read_chats(format_chats(frame)).first()["loss"] == "".join(texts)


def test_control_conversation(spark):
    row = op9_chat_format(spark, SF_DIR).filter(F.col("conv_id") == -7).first()
    text = r"\### Assistant: </turn> ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text)
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
