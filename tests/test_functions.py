import pytest
from pyspark.sql import functions as F

from logtable.functions import hashing, text, times
from logtable.functions.patterns import InvalidPattern, to_java
from logtable.operators.devinfo import norm_bool
from logtable.operators.filters import regex_match
from logtable.sources.config import java_format
from logtable.sources.devinfo_dump import copy_unescape


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["v"] for r in rows.select("i", expression.alias("v")).orderBy("i").collect()]


MATCHES = [
    ("b$", "ab\n", False), ("b$", "ab", True), ("a.b", "a\rb", True), ("a.b", "a\nb", False),
    ("(?s)a.b", "a\nb", True), ("(?m)^b$", "a\nb\nc", True), ("(?m)^$", "a\n", True),
    ("^$", "a\n", False), ("(?i)É", "é", True), (r"\bfoo\b", "éfoo", True),
    (r"\Boo\b", "foo", True), (r"[[:alpha:]]+1", "ab1", True), (r"[^[:alpha:]]", "abc", False),
    (r"[^\S]", "a", False), (r"[^\S]", " ", True), (r"\s", "\x0b", False), (r"[\s]", "\x0b", False),
    (r"\v", "\x0b", True), (r"\v", "\n", False), (r"[a&&b]", "&", True), (r"[a[b]", "[", True),
    ("(?P<n_x>a)b", "ab", True), ("(?<n>a)b", "ab", True), ("a{,2}", "a{,2}", True),
    ("x{2}", "xx", True), ("x{", "x{", True), ("(?U)a+$", "aa", True), (r"\Qa.b\E+", "a.bb", True),
    (r"\Qa.b\E", "axb", False), (r"\pL", "é", True), (r"\p{Greek}", "σ", True),
    (r"\P{Greek}", "σ", False), (r"\p{^Greek}", "a", True), (r"\x41\x{42}", "AB", True),
    (r"\101", "A", True), (r"[^a[:^digit:]]", "5", True), (r"[^a[:^digit:]]", "b", False),
    ("(?i:a)B", "AB", True), ("(?i:a)B", "Ab", False), ("a(?i)b|C", "c", True), ("[]a]", "]", True),
    ("[a-]", "-", True), ("[^\n]", "\n", False), ("(a|b)*c", "ababc", True), ("a#b", "a#b", True),
    (r"(?i)score - -1", "SCORE - -1", True), ("b\tc", "ab\tcd", True),
]

REFUSED = [
    "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", "a**", "a++", "a*?+", r"\1", "(", "a)", "[a", "a{1001}",
    "*", "(?z)", "\\", "(?<n", "x{2}{3}", r"\Z", r"\C", "(?>a)", "[[:foo:]]", "|*", "a{3,2}", r"\G",
]


def test_patterns_match_as_in_re2(spark):
    wrong = []
    for pattern, content, expected in MATCHES:
        got = column(spark, [content], F.col("s").rlike(to_java(pattern)))[0]
        if got != expected:
            wrong.append((pattern, content, got))
    assert not wrong


EDGES = [
    r"\ba", r"a\b", r"\ba?b", r"\b1{0,2}", r"\b\d+\b", r"\w\b\W", r"(a|1)\b", r"(?:1a)\b", r"(a)?\bb", r"a*\b-", r"\b(a|-)", r"a+\b",
    r"(?i)\bk", r"(?i)K\b", r"(?i)\bA1\b", r"\b\b1", r"a-|\b1", r"(a\b)-?", r"x?-a", r"a-+", r"-a*", r"(-a)+b?", r"a(?i)b|-", r"1-?a",
    r"[a1]\b", r"\ba|b\b", r"a(?s).b|-.1", r"^\b", r"\b$", r"\Ba", r"\b_", r"_\b",
]


def test_word_edges_and_needed_texts_as_in_re2(spark):
    import itertools

    import duckdb

    texts = ["".join(t) for n in range(5) for t in itertools.product("aB1- k"[:6 if n < 4 else 4], repeat=n)] + ["K", "aK", "ſa", "a_1", "-é1", "a\nb"]
    db = duckdb.connect()
    db.execute("CREATE TABLE texts AS SELECT unnest(?) AS s", [texts])
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    found = frame.select("s", *[regex_match(F.col("s"), p).alias(f"p{i}") for i, p in enumerate(EDGES)]).collect()
    for i, pattern in enumerate(EDGES):
        true = {r[0] for r in db.execute("SELECT s FROM texts WHERE regexp_matches(s, ?)", [pattern]).fetchall()}
        assert {r["s"] for r in found if r[f"p{i}"]} == true, pattern


@pytest.mark.parametrize("pattern", REFUSED)
def test_patterns_refused(pattern):
    with pytest.raises(InvalidPattern):
        to_java(pattern)


def test_reversed_range_is_refused_before_the_job(spark):
    with pytest.raises(InvalidPattern):
        regex_match(F.col("s"), "[z-a]")


def test_trim_and_fold(spark):
    assert column(spark, ["\t a b 　\n", None], text.gtrim(text.cell("s"))) == ["a b", ""]
    assert column(spark, ["ΑΣ É İ"], text.gfold("s")) == ["ας é i".replace("ς", "σ")]


def test_numbers(spark):
    values = ["1,234", "1e5", "12d", "0x1p2", "inf", "-Infinity", "1e400", ".5", "5.", "", "-", " 7 ", "1_0", "+3"]
    assert column(spark, values, text.parse_number("s")) == [
        1234.0, 1e5, None, None, float("inf"), float("-inf"), None, 0.5, 5.0, None, None, 7.0, None, 3.0,
    ]
    nan = column(spark, ["NaN", "nan", "-nan"], text.parse_number("s"))
    assert nan[0] != nan[0] and nan[1] != nan[1] and nan[2] is None


TIMES = [
    ("Tue Aug 19 13:02:41 BST 2025:90210", 1755604961000000),
    ("Tue Aug 19 13:02:41 GMT 2025", 1755608561000000),
    (" tue  AUG 19 13:02:41.25 XYZ 2025 ", 1755608561250000),
    ("Tue Aug 5 13:02:41 GMT 2025", None),
    ("1900000000", 1900000000000000), ("1900000000123", 1900000000123000),
    ("1900000000123456", 1900000000123456), ("1900000000123456789", 1900000000123456),
    ("-1900000000123456789", -1900000000123457), ("-5", -5000000),
    ("2031-04-09 17:45:12", 1933523112000000), ("2031-04-09 17:45:12,5", 1933523112500000),
    ("2031-04-09 17:45:12:99", 1933523112000000), ("2031-04-09T17:45:12.5+02:00", 1933515912500000),
    ("2031-04-09T17:45:12Z", 1933523112000000), ("2026-02-30 01:02:03", None),
    ("2031-04-09 24:00:00", None), ("", None), ("abc", None), ("2031-04-09", None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = column(spark, [t for t, _ in TIMES], F.unix_micros(times.parse_log_ts("s")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [expected for _, expected in TIMES]


def test_epoch_date_uses_the_given_zone(spark):
    assert column(spark, ["1900000000"], times.epoch_to_date(F.col("s").cast("bigint"))) == ["2030-03-17 17:46:40"]
    assert column(spark, ["1900000000"], times.epoch_to_date(F.col("s").cast("bigint"), "Europe/Paris")) == ["2030-03-17 18:46:40"]


def fnv(cells):
    state = hashing.FNV_OFFSET
    for part in cells:
        for byte in part.encode() + b"\0":
            state = ((state ^ byte) * hashing.FNV_PRIME) % 2**64
    return state


def test_row_hash(spark):
    rows = [("  Ab ", "ΣΑΣ", "x"), ("", "", ""), ("foo", "É" * 500, None), ("a", "b\0", "c")] * 40
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = df.withColumn("h", hashing.row_hash(["a", "b", "c"])).withColumn("u", hashing.unsigned(F.col("h")))
    expected = {fnv(["ab", "σασ", "x"]), fnv(["", "", ""]), fnv(["foo", "é" * 500, ""]), fnv(["a", "b\0", "c"])}
    assert {int(r["u"]) for r in got.select("u").distinct().collect()} == expected
    back = got.select((hashing.signed(F.col("u")) == F.col("h")).alias("same")).distinct().collect()
    assert [r["same"] for r in back] == [True]


def test_signed_rejects_what_is_no_identity(spark):
    assert column(spark, ["18446744073709551616", "-1", "x", ""], hashing.signed(F.col("s"))) == [None] * 4
    assert column(spark, ["18446744073709551615", "9223372036854775808"], hashing.signed(F.col("s"))) == [-1, -(2**63)]


def test_copy_unescape(spark):
    doubled = [(r"\\N", ""), (r"\N", r"\N"), (r"a\\tb", "a\tb"), (r"a\tb", r"a\tb"), (r"\\\\t", r"\\t"),
               (r"\\\t", "\\\t"), (r"\\\\\\t", "\\\\\t"), (r"x\\n\\r", "x\n\r"), ("", "")]
    assert column(spark, [a for a, _ in doubled], copy_unescape(F.col("s"))) == [b for _, b in doubled]
    server = [(r"\N", ""), (r"a\tb", "a\tb"), (r"a\\tb", r"a\tb"), (r"\q\n", "q\n")]
    assert column(spark, [a for a, _ in server], copy_unescape(F.col("s"), "postgres")) == [b for _, b in server]


def test_norm_bool(spark):
    assert column(spark, [" YES", "off", "1", "0", "maybe", ""], norm_bool(F.col("s"))) == [
        "true", "false", "true", "false", None, None]


@pytest.mark.parametrize("shape, expected", [
    ("<%s>", "<v>"), ("%5s|", "    v|"), ("%-3v|", "v  |"), ("100%% %s", "100% v"), ("plain", "plain%!(EXTRA string=v)"),
    ("%s %s", "v %!s(MISSING)"), ("%d", "%!d(string=v)"),
])
def test_format(spark, shape, expected):
    java = java_format(shape)
    assert column(spark, ["v"], F.format_string(java, "s")) == [expected]
