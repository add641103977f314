"""URL filter and exact dedup."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from logtable.llm import exact_dedup
from logtable.llm.exact_dedup import QuotientFilter, counted, exact_groups, filter_slices
from logtable.llm.queries import URL_RULES
from logtable.llm.url_filter import build_trie, filter_urls, look_up

RULES = (*URL_RULES, ("block", "a.b", "/x"), ("allow", "a.b", "/x/y"), ("allow", "b", ""), ("block", "b", ""), ("block", "Up.Case", "/"))


def longest(rules, host, path):
    """By trying every rule: the longest, then the one with the longer host, then block."""
    fits = [(len(r[1] + r[2]), len(r[1]), r[0] == "block", r) for r in rules
            if (host == r[1].lower() or host.endswith("." + r[1].lower())) and path.startswith(r[2])]
    return (max(fits)[3][1].lower() + max(fits)[3][2], max(fits)[3][0]) if fits else None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "com", "example", "www", "net", "up", "case", ""]), min_size=1, max_size=4),
       st.text(st.sampled_from("/xyen"), max_size=6))
def test_trie_finds_the_longest(labels, path):
    host = ".".join(labels)
    assert look_up(build_trie(RULES), host, path) == longest(RULES, host, path)


def test_urls(spark):
    urls = [
        "http://WWW.Example.com/en/1?q=://x", "https://example.com/en/", "http://example.com/english", "http://a.example.com/en/x#y",
        "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://example.com", "http://example.com?x/en/", "no scheme", "", None,
        "a://b://c/d", "http:///path", "http://a.b/x/y", "http://a.b/xy", "http://host\n/p", "http://up.case/", "x" * 100_000,
    ]
    frame = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string")
    found = {r["page_id"]: r for r in filter_urls(frame, RULES).collect()}
    for i, url in enumerate([*urls, urls[0]]):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        rule = longest(RULES, host, path)
        assert (found[i]["host"], found[i]["path"]) == (host, path)
        assert (found[i]["rule"], found[i]["verdict"]) == (rule or (None, "allow"))
    assert filter_urls(frame.filter("false"), RULES).count() == 0
    assert {r["verdict"] for r in filter_urls(frame, [], default="block").collect()} == {"block"}
    with pytest.raises(ValueError):
        build_trie([("maybe", "a", "/")])


hashes = st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40) | st.integers(2**63, 2**63 + 9), max_size=60)


@settings(max_examples=150, deadline=None)
@given(hashes, hashes, st.integers(0, 5))
def test_filters_merge_without_loss(one, other, bits):
    filters = []
    for part in (one, other):
        values = counted(np.array(part, np.uint64), np.ones(len(part), np.uint64))
        filters += [QuotientFilter.from_bytes(data) for _, data in filter_slices(*values, bits)]
    entries = [f.entries() for f in filters]
    every = counted(np.concatenate([e[0] for e in entries] or [np.zeros(0, np.uint64)]),
                    np.concatenate([e[1] for e in entries] or [np.zeros(0, np.uint64)]))
    true = {}
    for h in [*one, *other]:
        true[h] = true.get(h, 0) + 1
    assert dict(zip(every[0].tolist(), every[1].tolist())) == true


@pytest.mark.parametrize("size,fan_in", [(1 << 16, 64), (8, 2)])
def test_groups(docs, monkeypatch, size, fan_in):
    monkeypatch.setattr(exact_dedup, "FILTER_SIZE", size)
    monkeypatch.setattr(exact_dedup, "FAN_IN", fan_in)
    rows = [(i, ["a  b", "a\tb", "a b", " a b", "A b", None, "", "  "][i % 8] if i % 3 else f"own {i}", "s") for i in range(80)]
    found = {r["doc_id"]: r for r in exact_groups(docs(rows)).collect()}
    texts = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, _ in rows}
    for i, text in texts.items():
        same = [j for j, t in texts.items() if t == text]
        assert (found[i]["keep_id"], found[i]["group_size"], found[i]["kept"]) == (min(same), len(same), i == min(same))
        assert found[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_equal_fingerprints_are_compared_by_bytes(docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    found = {r["doc_id"]: r["keep_id"] for r in exact_groups(docs([(1, "a", "s"), (2, "b", "s"), (3, "a", "s"), (4, "c", "s")])).collect()}
    assert found == {1: 1, 2: 2, 3: 1, 4: 4}


def test_odd_documents(odd, none):
    rows = exact_groups(odd).collect()
    assert len(rows) == odd.count()
    assert sorted(r["doc_id"] for r in rows if r["kept"] and r["doc_id"]) == [1, 3, 6, 8, 9]
    assert [r["group_size"] for r in rows if r["doc_id"] == 5] == [4, 4] and {r["keep_id"] for r in rows if r["doc_id"] == 5} == {None}
    assert exact_groups(none).count() == 0


def test_urls_keep_columns_of_any_name(spark):
    pages = spark.createDataFrame([("http://a.example.com/en/x",)], "url string").selectExpr(
        "url", "'mine' AS _found", "'yours' AS found", "'old' AS Host", "1 AS RULE")
    row = filter_urls(pages, [("allow", "com", "/"), ("block", "example.com", "/en/")]).first().asDict()
    assert row == {"url": "http://a.example.com/en/x", "_found": "mine", "found": "yours", "host": "a.example.com",
                   "path": "/en/x", "rule": "example.com/en/", "verdict": "block"}


def test_the_longest_rule_wins_whichever_part_is_long():
    trie = build_trie([("block", "com", "/a/very/long/path/"), ("allow", "example.com", "/a/"), ("block", "b.org", "/x"), ("allow", "org", "/xyz")])
    assert look_up(trie, "example.com", "/a/very/long/path/1") == ("com/a/very/long/path/", "block")
    assert look_up(trie, "example.com", "/a/b") == ("example.com/a/", "allow")
    # Equally long: the one with the longer host.
    assert look_up(trie, "b.org", "/xyz") == ("b.org/x", "block")
