import random

import numpy as np
import pytest

from logtable.llm import near_dedup
from logtable.llm.components import components
from logtable.llm.near_dedup import BITS, CHUNK_ERRORS, INDEXED, SYMBOLS, Distances, index_keys, near_duplicates, signature
from tests.llm.conftest import by_id


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def expected(rows, threshold=85):
    """Components by comparing all pairs."""
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def edited(words, dealt, share):
    return [dealt.choice(["x", "yy", "zzz"]) + w if dealt.random() < share else w for w in words]


@pytest.mark.parametrize("block", [1024, 4])
def test_groups_are_those_of_all_pairs(docs, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    dealt, rows = random.Random(block), []
    for group in range(6):
        base = [f"g{group}w{dealt.randrange(400)}" for _ in range(120)]
        rows.append((len(rows), " ".join(base), "s"))
        for _ in range(14):  # around the threshold
            rows.append((len(rows), " ".join(edited(base, dealt, dealt.choice([0.002, 0.01, 0.02, 0.04]))), "s"))
    # A chain: each is near the one before and far from the first.
    chain = [f"c{i}" for i in range(150)]
    for _ in range(8):
        rows.append((len(rows), " ".join(chain), "s"))
        at = dealt.randrange(100)
        chain = chain[:at] + ["new"] + chain[at + 2 :] + [f"t{len(rows)}"]
    dealt.shuffle(rows)
    assert by_id(near_duplicates(docs(rows)), "component_id") == expected(rows)
    if block == 4:
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
        assert by_id(near_duplicates(docs(rows), threshold=80), "component_id") == expected(rows, 80)


def almost_alike(n, words=200, share=0.02, seed=8):
    dealt = random.Random(seed)
    base = [f"b{dealt.randrange(5000)}" for _ in range(words)]
    return [(i, " ".join(f"n{dealt.randrange(10**6)}" if dealt.random() < share else w for w in base), "s") for i in range(n)]


def test_almost_alike_documents_make_rows_in_proportion(spark, docs, monkeypatch):
    """Most pairs of these are a little below the threshold: none of them may become a row."""
    rows, staged = almost_alike(2000), []
    real = near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda df: staged.append(real(df)) or staged[-1])
    found = by_id(near_duplicates(docs(rows)), "component_id")
    by_columns = {tuple(df.columns): df.count() for df in staged}
    assert by_columns["a", "b"] <= 2 * len(rows)
    assert max(by_columns.values()) <= 2 * INDEXED * len(rows)
    few = rows[:300]
    assert by_id(near_duplicates(docs(few)), "component_id") == expected(few)
    assert len(set(found.values())) < len(rows)


@pytest.mark.parametrize("threshold, most, every", [(85, 23, 65), (80, 28, 79)])
def test_distances_follow_from_the_threshold(threshold, most, every):
    made = Distances.of(threshold)
    assert abs(made.most_errors - most) <= 1 and abs(made.all_errors - every) <= 2
    assert Distances.of(threshold, 1e-9).most_errors > made.most_errors
    wrong = (1 - threshold / 100) * (1 - 2.0**-BITS)
    dealt = np.random.default_rng(1)
    assert (dealt.binomial(SYMBOLS, wrong, 10**6) > made.all_errors).mean() <= 3e-5


def test_keys_meet_by_pigeonhole():
    dealt = np.random.default_rng(4)
    made = Distances.of(85)
    assert made.chunks * (CHUNK_ERRORS + 1) > made.most_errors
    one = dealt.integers(0, 256, (300, SYMBOLS), np.uint8)
    other = one.copy()
    for row in other:
        wrong = dealt.permutation(INDEXED)[:made.most_errors]
        row[wrong] ^= dealt.integers(1, 256, len(wrong), np.uint8)
    assert (index_keys(one, made.chunks) == index_keys(other, made.chunks)).any(axis=1).all()


def test_signatures_estimate_similarity():
    dealt = np.random.default_rng(5)
    errors = []
    for _ in range(200):
        every = dealt.integers(0, 1 << 63, 1150, np.uint64)
        errors.append((signature(every[:1075]) != signature(np.append(every[:1000], every[1075:]))).sum())
    # 1000 of 1150 in common: 0.8696 alike.
    assert abs(np.mean(errors) / SYMBOLS - 0.1304) < 0.01 and max(errors) <= Distances.of(85).all_errors


def test_odd_documents(odd, none):
    found = near_duplicates(odd)
    assert by_id(found, "component_id") == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, None: None}
    assert by_id(found, "n_shingles")[3] == 0 and by_id(found, "n_shingles")[4] == 1
    assert {i for i, k in by_id(found, "kept").items() if not k} == {5, 7}
    assert found.count() == odd.count()
    assert near_duplicates(none).count() == 0


def test_components(spark):
    links = [(1, 2), (3, 2), (4, 3), (9, 8), (8, 9), (7, 7)] + [(i, i + 1) for i in range(100, 160)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
