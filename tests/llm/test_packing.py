import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logtable.llm.packing import CAPACITY, WordTokenizer, pack, packed_sequences, plan_slots, token_pieces
from logtable.llm.queries import op1_packing, tokenizer_path

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ODD_TEXTS = [
    "it's <|endoftext|> x", "ÀÉß'S don't we'LL 12,3!!'s", "naïvé ①²", "a\x85b\xa0c", "\x1c x", "İstanbul ΣΑΣ", "", "  \t\n",
    "日本 ok", "'re're''ve", "<|startoftext|>", "a-b_c (d) 3.14", "e\u0301tude", "×÷", "A" * 5000,
]


def test_words_are_tokenised_as_whole_texts(tokenizer):
    got = WordTokenizer(tokenizer_path()).encode(pa.array(ODD_TEXTS))
    assert [g.tolist() for g in got] == [ids_of(tokenizer, t) for t in ODD_TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n'.,09aBéÉßø<|>-²Σ"), max_size=30), min_size=1, max_size=8))
def test_any_text_is_tokenised_alike(texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = WordTokenizer.shared(tokenizer_path()).encode(pa.array(texts))
    assert [g.tolist() for g in got] == [ids_of(tokenizer, t) for t in texts]


def test_words_are_learnt_again_when_too_many(tokenizer, monkeypatch):
    monkeypatch.setitem(WordTokenizer._plain.__globals__, "REMEMBERED", 5)
    encoder = WordTokenizer(tokenizer_path())
    for text in ("one two three four", "five six seven", "one two"):
        assert encoder.encode(pa.array([text]))[0].tolist() == ids_of(tokenizer, text)


def best_fit(lengths, capacity):
    """Longest first, each piece to the sequence that it fits best."""
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(free) if room >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(capacity - length)
    return len(free)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15), st.integers(40, 50))
def test_plan_is_best_fit(counts, capacity):
    ends, taken = {}, {length: set() for length in counts}
    places = []
    for s in plan_slots(counts, capacity):
        for rank in range(s.rank_from, s.rank_to):
            assert rank not in taken[s.length]
            taken[s.length].add(rank)
            k = rank - s.rank_from
            places.append((s.first + k // s.each, s.base + k % s.each * s.length, s.length))
    assert all(taken[n] == set(range(c)) for n, c in counts.items())
    for sequence, offset, length in sorted(places):
        assert ends.get(sequence, 0) == offset
        ends[sequence] = offset + length
        assert ends[sequence] <= capacity
    assert len(ends) == best_fit([n for n, c in counts.items() for _ in range(c)], capacity)


def check(rows, texts, tokenizer, capacity=CAPACITY):
    """Every document's ids once, in pieces that are cut only beyond the capacity; no gaps."""
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, found in pieces.items():
        ids = np.array([*ids_of(tokenizer, texts[doc]), 1], "<u4")
        for r in found:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and len(part) == r["length"]
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            assert r["length"] == capacity or r["start"] + r["length"] == len(ids)
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity


def test_query_packs_all(spark, tokenizer):
    rows = op1_packing(spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    check(rows, texts, tokenizer)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // CAPACITY) + 1


def test_odd_documents(odd, tokenizer):
    rows = pack(token_pieces(odd, tokenizer_path(), capacity=64), capacity=64).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    check(rows, texts, tokenizer, 64)
    assert [r["length"] for r in rows if r["doc_id"] == 1] == [1]
    assert sum(r["doc_id"] == 5 for r in rows) == 2  # rows that repeat are packed each


def test_no_documents(none):
    assert pack(token_pieces(none, tokenizer_path())).count() == 0


def test_sequences_hold_the_ids(docs, tokenizer):
    texts = [(i, " ".join(random.Random(i).choices(["ab", "cde", "f"], k=i * 7)), "s") for i in range(12)]
    pieces = token_pieces(docs(texts), tokenizer_path(), capacity=32, with_ids=True)
    packed = pack(pieces, 32)
    sequences = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packed_sequences(packed).collect()}
    for r in packed.collect():
        own = np.array([*ids_of(tokenizer, texts[r["doc_id"]][1]), 1])
        part = sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert part.tolist() == own[r["start"] : r["start"] + r["length"]].tolist()
