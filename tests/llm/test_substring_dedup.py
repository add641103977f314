import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from logtable.llm import substring_dedup
from logtable.llm.substring_dedup import SuffixAutomaton, merged, remove_repeats


def expected(rows, window=50):
    """doc_id, n_words, n_removed and digest by comparing all windows."""
    first, out = {}, set()
    words_of = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, words in words_of:
        for s in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, i), i)
    for i, words in words_of:
        gone = set()
        for s in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.add((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def got(frame):
    return {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in frame.collect()}


@pytest.mark.parametrize("shard,stream", [(50_000, 200_000), (100, 150)])
def test_spans_are_those_of_all_windows(docs, monkeypatch, shard, stream):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring_dedup, "STREAM_WORDS", stream)
    dealt = random.Random(1)
    fresh = lambda n: [f"v{dealt.randrange(30)}" for _ in range(n)]
    shared = [fresh(n) for n in (49, 50, 51, 60, 90, 200)]
    rows = []
    for i in range(60):
        words = fresh(dealt.randrange(40))
        for _ in range(dealt.randrange(4)):
            passage = dealt.choice(shared)
            cut = dealt.randrange(len(passage)) if dealt.random() < 0.4 else 0
            words += passage[cut:] + fresh(dealt.choice([0, 1, 30]))
        rows.append((i * 3 % 61, " ".join(words), "s"))
    rows += [(100, " ".join(["la"] * 130), "s"), (101, " ".join(["la"] * 70), "s"), (102, rows[0][1], "s"), (103, rows[0][1], "s")]
    dealt.shuffle(rows)
    found = remove_repeats(docs(rows))
    assert got(found) == expected(rows)
    for r in found.collect():
        if r["n_removed"]:
            assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=5), st.lists(st.integers(0, 2), max_size=20), st.integers(1, 6))
def test_automaton_finds_smaller_documents(references, words, window):
    automaton = SuffixAutomaton()
    for doc, reference in enumerate(references):
        automaton.add(reference, doc * 2)
    automaton.finish()
    for doc in range(-1, 2 * len(references) + 1, 2):
        ends = [
            e for e in range(window, len(words) + 1)
            if any(d * 2 < doc and r[s : s + window] == words[e - window : e] for d, r in enumerate(references) for s in range(len(r) - window + 1))
        ]
        assert automaton.matched(words, doc, window) == ends


def test_odd_documents(odd, none):
    found = remove_repeats(odd)
    assert found.count() == odd.count()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got(found) == expected(rows)
    assert {r["doc_id"]: r["n_removed"] for r in found.collect()}[7] == 60_000
    assert remove_repeats(none).count() == 0


def test_merged():
    assert merged([(5, 8), (1, 3), (3, 4), (7, 9)]) == [(1, 4), (5, 9)]
    assert merged([]) == []
