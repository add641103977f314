"""Patterns that would exhaust Java's stack run in RE2; the rest run in the JVM, and agree with it."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from logtable.functions.patterns import InvalidPattern, repeats_group, to_java, to_re2
from logtable.operators.filters import filter_regex, re2_match, regex_match
from logtable.operators.presets import tag_presets


@pytest.mark.parametrize("pattern", [
    r'"(?:[^"\\]|\\.)*"', r"^(?:a|b|cd)*$", r"(ab){2,}?", r"(?:a+)*", r"(|a)+", r"(ab|c){1,900}", r"((ab){9}){300}", r"(?i)(\w+\s?)+"])
def test_repeated_groups_are_told(pattern):
    assert repeats_group(pattern)


@pytest.mark.parametrize("pattern, java", [
    ("(a|b|c)*x", "(?-iu:[abc]*)x"), ("x{3,}", "x{3}x*"), ("x{3,}?", "x{3}x*?"), (r"(?:.|\n)*x", r"(?-iu:[[^\n][\n]]*)x"),
    (r"\Qab\E{2,}", "ab{2}b*"), ("(a|b){2,}", "(?-iu:[ab]{2}[ab]*)"), ("(ab)?c", "(?-iu:ab)?c"), (r"(\.\d{1,3}){3}", r"(?-iu:[\x2E][0-9]{1,3}){3}")])
def test_single_characters_are_no_groups(pattern, java):
    assert to_java(pattern) == java and not repeats_group(pattern)


@pytest.mark.parametrize("pattern, same", [
    (r"(?<n>a)+b", r"(?P<n>a)+b"), (r"[(?<]x(?<y>z)\Q(?<\E", r"[(?<]x(?P<y>z)\Q(?<\E"), (r"\(?<a", r"\(?<a"),
    (r"[]\](?<](?<q>[[:alpha:](?<])", r"[]\](?<](?P<q>[[:alpha:](?<])")])
def test_group_names_for_re2(pattern, same):
    assert to_re2(pattern) == same
    pc.match_substring_regex(pa.array([""]), pattern=same)


LONG = [
    (r'"(?:[^"\\]|\\.)*"', '"' + r'a\"' * 400_000 + '"', True), (r'"(?:[^"\\]|\\.)*"', '"' + "a" * 1_000_000, False),
    (r"^(?:a|b|cd)*$", "abcd" * 250_000, True), (r"^(?:a|b|cd)*$", "abcd" * 250_000 + "c", False),
    (r"^(?:a|b|c|d)*$", "abcd" * 250_000, True), (r"^(?:𝔸|b|\n)+$", "𝔸b\n" * 100_000, True), (r"^[𝔸b]{2,}$", "𝔸b" * 100_000, True),
    (r"^(\w+\s?)+$", "word " * 200_000 + "!", False), (r"^(?:[^x]|y){3,}$", "ab𝔸" * 100_000, True)]


def test_long_cells_end_no_executor(spark):
    for pattern, text, hit in LONG:
        rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "n int, s string")
        got = {r["n"]: r["hit"] for r in rows.select("n", regex_match(F.col("s"), pattern).alias("hit")).collect()}
        assert (got[1], got[3]) == (hit, None), pattern
        assert rows.select(regex_match(F.col("s"), pattern)).count() == 3


def test_both_ways_agree_with_re2(spark):
    pick = random.Random(12)
    atoms = ["a", "b", ".", "[ab]", "[^a]", r"\d", r"\n", "é", r"\x{1D538}"]
    texts = ["".join(pick.choice("ab1\né𝔸") for _ in range(pick.randint(0, 9))) for _ in range(150)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def some(depth):
        out = ""
        for _ in range(pick.randint(1, 3)):
            atom = pick.choice(atoms) if depth == 0 or pick.random() < 0.6 else f"({'?:' if pick.random() < 0.5 else ''}{some(depth - 1)})"
            out += atom + pick.choice(["", "", "", "*", "+", "?", "*?", "{2}", "{1,}", "{0,2}"])
        return out + (f"|{pick.choice(atoms)}" if pick.random() < 0.4 else "")

    patterns = [pick.choice(["", "^", "(?i)", "(?s)"]) + some(2) + pick.choice(["", "$"]) for _ in range(60)]
    assert {repeats_group(p) for p in patterns} == {True, False}
    for at in range(0, len(patterns), 20):
        part = patterns[at : at + 20]
        rows = frame.select("i", *[regex_match(F.col("t"), p).alias(f"p{k}") for k, p in enumerate(part)]).collect()
        for k, p in enumerate(part):
            want = pc.match_substring_regex(pa.array(texts), pattern=to_re2(p)).to_pylist()
            assert [r[f"p{k}"] for r in sorted(rows)] == want, p


def test_filters_and_presets_take_both(spark, table):
    log = table(["a", "b"], [("x y", "zz"), ("abab", "q"), (None, "abab!")])
    assert filter_regex(log, "^(ab)+$", columns=["a"]).count() == 1
    tags = tag_presets(log, [("(ab)+!", "one"), ("z+", "two"), ("(q|zz)+$", "three")], ["a", "b"])
    assert sorted(sorted(r["presets"]) for r in tags.collect()) == [["one"], ["three"], ["three", "two"]]


def test_what_re2_refuses_is_refused():
    for pattern in ("(a", "(a)(?=b)*", "(?P<x>a)\\1", "((a{1000}){1000})*"):
        with pytest.raises(InvalidPattern):
            re2_match(pattern)
