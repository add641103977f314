from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logtable.functions.patterns import InvalidPattern
from logtable.operators import annotate as notes
from logtable.operators import positions as places
from logtable.operators.columns import (
    ColumnView, initial_view, reorder_columns, reset_view, sort_column, toggle_columns,
)
from logtable.operators.devinfo import (
    GroupRules, apply_mappings, devinfo_query, entity_order, fold, list_categories, list_groups, with_group,
    with_group_table,
)
from logtable.operators.filters import filter_marked, match_spans, search
from logtable.operators.presets import (
    HOST_PRESETS, dedupe_ordered, filter_preset, many_preset_hits, merge_presets, preset_hits, tag_presets,
)
from logtable.operators.rows import with_line_no, with_row_id
from logtable.operators.series import (
    Extent, NoSeries, TooManySeries, bucket_of, bucket_series, normalise_series, scale_series, series_extent,
    series_points,
)
from logtable.operators.sorting import column_kind, sort_rows
from logtable.operators.view import LogView
from logtable.operators.windows import (
    Bounds, NoTimestamps, TimeWindow, bounds, expand_window, filter_window, restored_window, shift_window,
    time_bounds, time_column, window_from_row, window_from_text, window_profile, with_edge, with_ts,
)
from logtable.plans import ordered
from logtable.sources.config import field_mappings


def lines_of(df):
    return [r["line_no"] for r in df.collect()]


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


# --- ordered scans ---------------------------------------------------------------------------

@pytest.mark.parametrize("block", [3, 7, 1 << 17])
def test_ordered_scans_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    n = 100
    df = spark.range(1, n + 1).withColumnRenamed("id", "k").repartition(5)
    flagged = F.when(F.col("k") % 13 == 0, F.col("k"))
    flags = [k for k in range(1, n + 1) if k % 13 == 0]

    def values(found, column):
        return [r[column] for r in found.orderBy("k").collect()]

    near = ordered.neighbours(df, "k", flagged, "after", "before")
    assert values(near, "after") == [min((f for f in flags if f > k), default=None) for k in range(1, n + 1)]
    assert values(near, "before") == [max((f for f in flags if f < k), default=None) for k in range(1, n + 1)]
    assert values(ordered.running_last(df, "k", flagged, "v"), "v") == [
        max((f for f in flags if f <= k), default=None) for k in range(1, n + 1)]
    assert values(ordered.running_sum(df, "k", F.col("k"), "v"), "v") == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_line_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(16)
    got = with_line_no(df, "v").orderBy("line_no").collect()
    assert [(r.v, r.line_no) for r in got] == [(i, i + 1) for i in range(1000)]


# --- columns -----------------------------------------------------------------------------------

def test_columns(table):
    df = table(["When", "Rack Unit", "Blank", "Remark"], [("1", "m", " ", "d")])
    view = initial_view(df)
    assert view.visible == ["When", "Rack Unit", "Remark"]
    view, toggled, missing = toggle_columns(view, ["blank", "1", "WHEN", "9", "nope"])
    assert toggled == ["Blank", "When"] and missing == ["9", "nope"]
    assert view.visible == ["Rack Unit", "Blank", "Remark"]
    assert toggle_columns(view, ["all"])[0].visible == ["When", "Rack Unit", "Blank", "Remark"]
    moved, named, missing = reorder_columns(view, ["remark", "2", "x"])
    assert named == ["Remark", "Rack Unit"] and missing == ["x"]
    assert moved.order == ("Remark", "Rack Unit", "When", "Blank")
    assert moved.select(df).columns == ["Remark", "Rack Unit", "Blank", "line_no"]
    with pytest.raises(ValueError):
        reorder_columns(view, ["x"])
    with pytest.raises(ValueError):
        toggle_columns(view, [])
    assert reset_view(df).visible == ["When", "Rack Unit", "Blank", "Remark"]


def test_sort_column():
    view = ColumnView(("﻿When", "Rack Unit", "Blank", "Remark"), frozenset({"Blank"}))
    assert [sort_column(view, by) for by in ("when", "rack unit", 3, "0", "Line", "off", "", None)] == [
        "﻿When", "Rack Unit", "Remark", "#", "#", None, None, None]
    for bad in ("4", "-1", "nope"):
        with pytest.raises(ValueError):
            sort_column(view, bad)


# --- sorting -----------------------------------------------------------------------------------

SORTS = [
    ("number", ["70", "305", "", "4,800", "70.0", "-0.5"], [3, 6, 1, 5, 2, 4], [4, 2, 1, 5, 6, 3]),
    ("time", ["2031-04-09 17:45:12", "1900000000", "Thu Oct 12 03:20:41 UTC 2028:77", " "], [4, 3, 2, 1], [1, 2, 3, 4]),
    ("text", ["oak", "Pine", "Oak", "elm", "", "oak"], [5, 4, 3, 1, 6, 2], [2, 1, 6, 3, 4, 5]),
    ("mixed", ["yew", "52", "2031-04-09 17:45:12", "7", "fir", ""], [6, 4, 2, 3, 5, 1], [1, 5, 3, 2, 4, 6]),
    ("number", ["", " "], [1, 2], [1, 2]),
]


@pytest.mark.parametrize("kind, values, up, down", SORTS)
def test_typed_sort(table, kind, values, up, down):
    df = table(["v"], [(v,) for v in values])
    assert column_kind(df, "v") == kind
    assert lines_of(sort_rows(df, "v")) == up
    assert lines_of(sort_rows(df, "v", desc=True)) == down


def test_sort_by_line(table):
    df = table(["v"], [("b",), ("a",), ("c",)])
    assert lines_of(sort_rows(df, "#", desc=True)) == [3, 2, 1]
    assert lines_of(sort_rows(df, None)) == [1, 2, 3]


# --- filters and the view -------------------------------------------------------------------------

def test_filter_toggle(table):
    view = LogView.of(table(["a", "b"], [("severity=error", "host=a"), ("severity=info", "host=b")]))
    on = view.filter("severity=error")
    off = on.toggle_filter()
    counts = [v.rows().count() for v in (on, off, off.toggle_filter(), on.filter(""), on.filter("").toggle_filter())]
    assert counts == [1, 2, 1, 2, 2]
    assert on.filter("error\thost").rows().count() == 1
    with pytest.raises(InvalidPattern):
        on.filter("(")


def test_search_and_spans(table):
    df = table(["a", "b"], [("Foo bar foo", "x"), ("É", "FOO"), (None, "none")])
    assert sorted(lines_of(search(df, " foo "))) == [1, 2]
    assert sorted(lines_of(search(df, "x"))) == [1] and search(df, "  ").count() == 0
    assert sorted(lines_of(search(df, "o\tx"))) == [1]
    spans = {(r.line_no, r.column): r.starts for r in match_spans(df, "FOO").collect()}
    assert spans == {(1, "a"): [0, 8], (2, "b"): [0]}
    assert [r.starts for r in match_spans(table(["a"], [("aaaa",)]), "aa").collect()] == [[0, 2]]


def test_combined_view(spark, table):
    rows = [("2026-01-26 06:00:0%d" % i, "ab"[i % 2], str(9 - i)) for i in range(8)] + [("no time", "a", "0")]
    df = with_ts(with_row_id(table(["time", "k", "v"], rows)))
    marked = df.filter(F.col("k") == "a").select("row_id", F.lit("red").alias("mark"), F.lit(None).cast("string").alias("comment"))
    assert sorted(lines_of(filter_marked(df, marked))) == [1, 3, 5, 7, 9]
    view = LogView.of(df).only_marked(marked).sort("v")
    assert lines_of(view.to_df()) == [9, 7, 5, 3, 1]
    view = view.between(TimeWindow(utc(2026, 1, 26, 6, 0, 2), utc(2026, 1, 26, 6, 0, 6)))
    assert lines_of(view.to_df()) == [7, 5, 3]
    assert [(r.line_no, r.pos) for r in view.positions().orderBy("pos").collect()] == [(7, 1), (5, 2), (3, 3)]
    assert lines_of(view.between(None).only_marked(None).reset_layout().to_df()) == list(range(1, 10))
    off = TimeWindow(utc(2026, 1, 1), utc(2026, 1, 2), enabled=False)
    assert filter_window(df, off).count() == 9


def test_positions(spark, table, monkeypatch):
    df = with_row_id(table(["v"], [(str(i % 10),) for i in range(40)]))
    view = LogView.of(df).sort("v", desc=True)
    expected = sorted(range(1, 41), key=lambda n: (-((n - 1) % 10), n))
    for limit in (100, 2):
        monkeypatch.setattr(places, "PAGE_ROWS", limit)
        got = view.page(9, 4).orderBy("pos").collect()
        assert [(r.line_no, r.pos) for r in got] == [(expected[p - 1], p) for p in range(9, 13)]
        got = view.last(3).orderBy("pos").collect()
        assert [(r.line_no, r.pos) for r in got] == [(expected[p - 1], p) for p in (38, 39, 40)]
    placed = view.positions()
    red = df.filter(F.col("v") == "7").select("row_id").distinct().withColumns(
        {"mark": F.lit("red"), "comment": F.lit(None).cast("string")})
    assert [places.next_marked(placed, red, p) for p in (0, 9, 12)] == [9, 10, None]
    assert [places.prev_marked(placed, red, p) for p in (9, 10, 41)] == [None, 9, 12]
    assert [places.next_hit(placed, "9", p) for p in (1, 4, 40)] == [2, 1, 1]
    assert [places.prev_hit(placed, "9", p) for p in (1, 3)] == [4, 2]
    assert places.next_hit(placed, "x", 1) is None
    seven = red.first()["row_id"]
    assert places.position_of(placed, seven) == 9 and places.position_of(placed, 1) == 1
    rows = view.filter("[5-9]").rows()
    said = ["found", "not in current filter", "out of bounds", "out of bounds"]
    assert [places.row_at_line(df, rows, n)[0] for n in (6, 1, 0, 41)] == said
    wanted = spark.createDataFrame([(6,), (1,), (0,), (41,)], "line_no int")
    found = {r["line_no"]: r["status"] for r in places.rows_at_lines(df, rows, wanted).collect()}
    assert [found[n] for n in (6, 1, 0, 41)] == said


# --- annotations ------------------------------------------------------------------------------------

def pairs(df):
    return sorted(tuple(r) for r in df.select("row_id", "mark", "comment").collect())


def test_annotations(spark):
    ann = spark.createDataFrame([(1, "red", None), (2, None, "two"), (3, "green", "three")], notes.SCHEMA)
    rows = spark.createDataFrame([(1,), (1,), (4,)], "row_id bigint")
    assert sorted(tuple(r) for r in notes.annotate(rows, ann).collect()) == [(1, "red", ""), (1, "red", ""), (4, "", "")]
    assert pairs(notes.set_mark(ann, rows, "amber")) == [(1, "amber", None), (2, None, "two"), (3, "green", "three"), (4, "amber", None)]
    assert pairs(notes.set_mark(ann, rows, None)) == [(2, None, "two"), (3, "green", "three")]
    assert pairs(notes.set_comment(ann, rows.filter("row_id = 1"), "x"))[0] == (1, "red", "x")
    assert pairs(notes.set_comment(ann, ann.filter("row_id = 2"), "")) == [(1, "red", None), (3, "green", "three")]
    incoming = spark.createDataFrame([(1, "mauve", "one"), (3, "red", ""), (9, "red", "absent"), (4, "green", None)], notes.SCHEMA)
    present = spark.createDataFrame([(1,), (3,), (3,), (4,)], "row_id bigint")
    assert pairs(notes.merge_annotations(ann, incoming, present)) == [
        (1, "red", "one"), (2, None, "two"), (3, "red", "three"), (4, "green", None)]
    with pytest.raises(ValueError):
        notes.set_mark(ann, rows, "mauve")


# --- time windows ------------------------------------------------------------------------------------

def test_time_column():
    assert time_column(["Time", "Host", "Details"]) == "Time"
    assert time_column(["date", "ts", "﻿Timestamp "]) == "﻿Timestamp "
    assert time_column(["Date", "ts"]) == "Date" and time_column(["x"]) is None


LIMITS = Bounds(utc(2026, 1, 1), utc(2026, 1, 2))


def test_window_arithmetic():
    hour = timedelta(hours=1)
    window = TimeWindow(utc(2026, 1, 1, 6), utc(2026, 1, 1, 8))
    assert shift_window(window, LIMITS, 3 * hour) == TimeWindow(utc(2026, 1, 1, 9), utc(2026, 1, 1, 11))
    assert shift_window(window, LIMITS, -9 * hour) == TimeWindow(LIMITS.low, utc(2026, 1, 1, 2))
    assert shift_window(window, LIMITS, 99 * hour) == TimeWindow(utc(2026, 1, 1, 22), LIMITS.high)
    assert shift_window(TimeWindow(utc(2025, 1, 1), utc(2027, 1, 1)), LIMITS, hour) == TimeWindow(LIMITS.low, LIMITS.high)
    empty = TimeWindow(LIMITS.high, LIMITS.high)
    assert shift_window(empty, LIMITS, hour) == TimeWindow(LIMITS.high - timedelta(minutes=15), LIMITS.high)
    assert expand_window(window, LIMITS, -9 * hour).start == LIMITS.low
    assert expand_window(window, LIMITS, 99 * hour).end == LIMITS.high
    assert with_edge(None, utc(2026, 1, 1, 5), LIMITS, "start") == TimeWindow(utc(2026, 1, 1, 5), LIMITS.high)
    assert with_edge(window, utc(2026, 1, 1, 9), LIMITS, "start") == TimeWindow(utc(2026, 1, 1, 9), utc(2026, 1, 1, 9))
    assert with_edge(window, utc(2025, 1, 1, 9), LIMITS, "end") == TimeWindow(LIMITS.low, LIMITS.low)
    assert window_from_text(LIMITS, " 2026-01-01 06:00", "2027-01-01 00:00:00") == TimeWindow(utc(2026, 1, 1, 6), LIMITS.high)
    for start, end, message in (("x", "y", "invalid start"), ("2026-01-01 06:00", "", "invalid end"),
                                ("2026-01-01 06:00", "2026-01-01 05:00", "after end")):
        with pytest.raises(ValueError, match=message):
            window_from_text(LIMITS, start, end)
    inverted = TimeWindow(utc(2026, 1, 1, 9), utc(2026, 1, 1, 7))
    assert restored_window(inverted, LIMITS) == TimeWindow(LIMITS.low, LIMITS.high)


def test_bounds_and_row_edge(table):
    df = with_ts(table(["ts", "v"], [("100", "a"), ("x", "b"), ("400", "c"), ("", "d")]))
    assert bounds(df) == Bounds(utc(1970, 1, 1, 0, 1, 40), utc(1970, 1, 1, 0, 6, 40))
    assert time_bounds(df).first()["has_time"]
    assert window_from_row(df, None, 3, "start").start == utc(1970, 1, 1, 0, 6, 40)
    with pytest.raises(NoTimestamps):
        window_from_row(df, None, 2, "start")
    with pytest.raises(NoTimestamps):
        bounds(df.filter("line_no = 2"))
    assert filter_window(df, TimeWindow(utc(1970, 1, 1), utc(1971, 1, 1))).count() == 2


@pytest.mark.parametrize("width, step", [(10, 5), (5, 10), (1, 1), (7, 3), (1000, 5), (60, 13)])
def test_window_profile(table, monkeypatch, width, step):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    seconds = [0, 0, 1, 5, 10, 12, 30, 31, 31, 59, 60]
    df = with_ts(table(["time"], [(str(1000 + s),) for s in seconds] + [("none",)]))
    got = window_profile(df, timedelta(seconds=width), timedelta(seconds=step)).orderBy("position").collect()
    size, starts = min(width, 60), [0]
    while starts[-1] + size < 60:
        starts.append(min(starts[-1] + step, 60 - size))
    assert [(r.start_us // 10**6 - 1000, r.rows) for r in got] == [
        (s, sum(s <= x <= s + size for x in seconds)) for s in starts]


# --- series -----------------------------------------------------------------------------------------

def series(spark, points, low, high, width, agg, fill):
    df = spark.createDataFrame([("k", t, float(v), i) for i, (t, v) in enumerate(points)],
                               "series string, ts bigint, val double, ord bigint").repartition(3)
    found = bucket_series(df, width, agg, fill, extent=Extent(low, high, ("k",)))
    return [r["value"] for r in found.orderBy("x").collect()]


def by_definition(points, low, high, width, agg, fill):
    """A bucket holds the readings up to its end and after the end of the one before."""
    steps, span = max(1, width - 1), max(1, high - low)
    in_time = [v for _, _, v in sorted((t, i, v) for i, (t, v) in enumerate(points))]
    times, out = sorted(t for t, _ in points), []
    for x in range(width):
        inside = [v for t, v in zip(times, in_time) if -(-(t - low) * steps // span) == x]
        before = [v for t, v in zip(times, in_time) if -(-(t - low) * steps // span) < x]
        value = None
        if inside:
            value = {"last": inside[-1], "avg": sum(inside) / len(inside), "max": max(inside), "min": min(inside)}[agg]
        out.append(before[-1] if value is None and before and fill == "hold" else value)
    return out


SPANS = [
    ([(104, 3.5), (100, 7), (111, -2), (104, 9), (107, 0.25), (111, 6)], 100, 111, 6),
    ([(41, 8)], 12, 41, 4), ([(60, 2), (62, 5)], 60, 75, 16), ([(90, 4), (90, 4.5), (93, 1)], 90, 93, 1),
    ([(33, 1), (33, 2)], 33, 33, 5), ([(-2**61, 1), (2**61, 2)], -2**61, 2**61, 3),
]


@pytest.mark.parametrize("agg, fill", [("last", "hold"), ("avg", "none"), ("max", "hold"), ("min", "none")])
@pytest.mark.parametrize("points, low, high, width", SPANS)
def test_buckets(spark, points, low, high, width, agg, fill):
    assert series(spark, points, low, high, width, agg, fill) == by_definition(points, low, high, width, agg, fill)


def test_not_a_number_readings(spark):
    nan = float("nan")
    assert series(spark, [(1, nan), (1, 5)], 1, 2, 2, "max", "none") == [None, None]
    assert series(spark, [(1, 5), (1, nan), (1, 7)], 1, 2, 2, "min", "none") == [5, None]
    assert series(spark, [(1, 5), (1, nan)], 1, 3, 3, "last", "hold") == [None, None, None]


def test_points_and_cap(table):
    rows = [("5", "b", "1.5"), ("3", " ", "2"), ("x", "c", "1"), ("4", "d", "n/a"), ("9", "a", "1e2")]
    points = series_points(table(["t", "k", "v"], rows), "t", "k", "v")
    assert sorted(tuple(r) for r in points.collect()) == [("(empty)", 3, 2.0, 2), ("a", 9, 100.0, 5), ("b", 5, 1.5, 1)]
    assert series_extent(points, 3) == Extent(3, 9, ("b", "(empty)", "a"))
    assert series_extent(points, None) == Extent(3, 9, ())
    assert bucket_series(points, 4, max_keys=None).count() == 12
    with pytest.raises(TooManySeries):
        series_extent(points, 2)
    with pytest.raises(NoSeries):
        series_extent(points.filter("ts > 99"))


def test_scale_and_normalise(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 9.0), ("a", 2, 99.0), ("b", 0, -5.0), ("b", 1, None)],
                               "series string, x bigint, value double")

    def ys(mode, layout):
        found = normalise_series(scale_series(df, mode), layout).orderBy("series", "x").collect()
        return [r["y"] for r in found]

    linear, log = ys("linear", "split"), ys("log1p", "split")
    assert log[1] > linear[1] and linear[0] == 0 and linear[2] == 1 and linear[3] == 0.5 and linear[4] is None
    assert ys("linear", "overlay")[3] == 0 and ys("log1p", "overlay")[3] == 0
    assert ys("symlog", "overlay")[3] == 0 and ys("symlog", "overlay")[0] > 0


def test_bucket_of(spark):
    df = spark.createDataFrame([(None,), (-5,), (0,), (1,), (5,), (10,), (99,)], "t bigint")
    got = [r[0] for r in df.select(bucket_of(F.col("t"), Extent(0, 10, ()), 5)).collect()]
    assert got == [0, 0, 0, 1, 2, 4, 4]
    assert df.select(bucket_of(F.col("t"), Extent(0, 10, ()), 1)).distinct().count() == 1


# --- device information ------------------------------------------------------------------------------

RAW = "line_no bigint, category string, id string, time string, field_name string, field_value string, field_value_lc string, agentid string, extra string"


def raw_rows(spark):
    rows = [
        (1, "sw_main", "1", "", "rate", "YES", "yes", "", "e1"), (2, "sw_main", "1", "t1", "rate", "NO", "no", "a7", ""),
        (3, "host_a", "9", "t", "note", "It's", "it's", "a1", ""), (4, "sw_main", "1", "t2", "", "x", "x", "", "e2"),
        (5, "", "1", "", "f", "v", "v", "", ""), (6, "host_a", "2", "", "state", "1", "1", "", ""),
        (7, "sw_port", "1", "", "state", "9", "9", "", ""), (8, "host_a", "2", "", "secret", "s", "s", "", ""),
    ]
    return spark.createDataFrame(rows, RAW).repartition(4)


def test_fold_and_query(spark):
    fields = fold(raw_rows(spark))
    got = {(r.category, r.id, r.field_name): (r.group_category, r.raw_value, r.time, r.agentid, r.extra) for r in fields.collect()}
    assert got[("sw_main", "1", "rate")] == ("sw", "YES", "t1", "a7", "e1") and len(got) == 5
    mappings = field_mappings(spark, {
        "sw": {"rate": {"label": "Rate", "bool_normalize": True, "unit": "x", "format": "<%s>"}, "state": {"label": "by group"}},
        "sw_port": {"state": {"label": "by category"}}, "host": {"secret": {"hide": True}, "state": {"enum": {"1": "up"}, "desc": "d"}},
    })
    table = ordered.in_order(apply_mappings(fields, mappings), entity_order()).orderBy("pos")
    assert [(r.group_category, r.id, r.field_label, r.value, r.desc) for r in table.collect()] == [
        ("host", "2", "state", "up", "d"), ("host", "9", "note", "It's", ""),
        ("sw", "1", "Rate", "<true x>", ""), ("sw", "1", "by group", "9", "")]
    assert devinfo_query(fields, group="host", search=" T'S ").count() == 1
    assert devinfo_query(fields, category="host_a", id="2").count() == 2
    assert [r.group_category for r in list_groups(raw_rows(spark)).orderBy("seen").collect()] == ["sw", "host"]
    assert [r.category for r in list_categories(raw_rows(spark)).orderBy("seen").collect()] == ["sw_main", "host_a", "sw_port"]


def test_fold_of_a_hot_entity(spark):
    """One entity owns nine fields of ten; what its rows say of it reaches every field."""
    n = F.col("id")
    hot = n % 10 > 0
    raw = spark.range(1, 20_001, numPartitions=4).select(
        n.alias("line_no"), F.when(hot, "big").otherwise("small").alias("category"),
        F.when(hot, "1").otherwise((n % 70).cast("string")).alias("id"),
        F.when(n == 777, "a7").otherwise("").alias("agentid"), F.when(n > 9_000, n.cast("string")).otherwise("").alias("time"),
        F.concat(F.lit("f"), n.cast("string")).alias("field_name"), n.cast("string").alias("field_value"),
        n.cast("string").alias("field_value_lc"), F.lit("").alias("extra"))
    fields = fold(raw)
    assert "Window" not in fields._jdf.queryExecution().optimizedPlan().toString()
    assert fields.count() == 20_000 and fields.filter("raw_value = field_seen").count() == 20_000
    big = fields.filter("category = 'big'").select("seen", "agentid", "time", "extra").distinct().collect()
    assert [tuple(r) for r in big] == [(1, "a7", "9001", "")]


def test_fill_carries_over_blocks(spark):
    rows = [(s, x, v) for s, values in {"a": {0: 1.0, 3: 2.0, 17: 3.0}, "b": {9: 4.0}, "c": {}}.items()
            for x in range(20) for v in [values.get(x)]]
    df = spark.createDataFrame(rows, "series string, x bigint, v double").repartition(5)
    for block in (1, 2, 7, 64):
        got = {(r.series, r.x): r.out for r in ordered.running_last_of(df, "series", "x", F.col("v"), "out", block).collect()}
        last = {}
        for s, x, v in rows:
            last[s] = v if v is not None else last.get(s)
            assert got[s, x] == last[s]
        assert len(got) == len(rows)


@pytest.mark.parametrize("few", [40, 1_000])
def test_ranks_are_found_by_brackets(spark, few):
    """Ties, NULL and NaN, ascending and descending, at any depth, whatever the sample brings."""
    n = F.col("id")
    df = spark.range(4_000).select(
        n.alias("line_no"), F.when(n % 7 > 0, (n * 37 % 50).cast("string")).alias("a"),
        F.when(n % 11 == 0, F.lit(float("nan"))).when(n % 5 > 0, (n * 13 % 400) / 2.0).alias("b")).repartition(4)
    for down in (False, True):
        keys = [(F.col("a"), down), (F.col("b"), not down), (F.col("line_no"), False)]
        want = [r.line_no for r in ordered.ordered(df, keys).collect()]
        for start, end in ((1, 3), (1_999, 2_040), (3_990, 5_000), (4_001, 4_010)):
            got = ordered.ranked_between(df, keys, start, end, few=few).orderBy("pos").collect()
            assert [r.pos for r in got] == list(range(start, min(end, 4_000) + 1))
            assert [r.line_no for r in got] == want[start - 1 : end]
            assert set(got[0].asDict() if got else ["line_no", "a", "b", "pos"]) == {"line_no", "a", "b", "pos"}
    assert ordered.ranked_between(df.limit(0), [(F.col("line_no"), False)], 1, 5, few=few).count() == 0


def test_many_presets(table):
    df = table(["text"], [("an Alpha beta 12",), ("",), (None,), ("beta",), ("é gamma ", ), ("alphabet\nGAMMA",), ("beta gamma beta",)])
    presets = [("beta", "b"), (r"a\s+beta", "ab"), ("(?i)gamma", "g"), ("^beta|[0-9]+", "n"), ("(be|ta)+$", "loop"), ("beta", "again"), ("", "all"), ("nowhere", "no")]
    one = sorted(map(tuple, preset_hits(df, presets, ["text"]).select("line_no", "preset").collect()))
    assert sorted(map(tuple, many_preset_hits(df, presets, ["text"]).select("line_no", "preset").collect())) == one
    assert {p for _, p in one} == {"b", "ab", "g", "n", "loop", "again", "all"} and (7, "g") in one and (2, "all") in one
    assert many_preset_hits(df, [], ["text"]).count() == 0
    assert many_preset_hits(df.limit(0), presets, ["text"]).count() == 0
    with pytest.raises(InvalidPattern):
        many_preset_hits(df, [("(", "bad")], ["text"])


def test_group_rules(spark):
    rules = GroupRules(nosplit=(" a_b ",), exact={"x_y": "z", "e_f": ""}, prefix={"sw_": "sw", "sw_p": "ports", "": "never"})
    names = ["a_b", "x_y", "e_f", "sw_port", "sw_main", "_x", "plain", "", " a_c "]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, category string")
    got = [r.group_category for r in with_group(df, rules).orderBy("i").collect()]
    assert got == ["a_b", "z", "e", "ports", "sw", "_x", "plain", "", "a"]


def test_group_table_is_the_same_as_rules(spark):
    rules = GroupRules(nosplit=(" a_b ",), exact={"x_y": "z", "e_f": ""}, prefix={"sw_": "sw", "sw_p": "ports", "": "never", "é": "accent"})
    table = [("nosplit", n, None) for n in rules.nosplit] + [("exact", k, v) for k, v in rules.exact.items()]
    table += [("prefix", k, v) for k, v in rules.prefix.items()]
    names = ["a_b", "x_y", "e_f", "sw_port", "sw_main", "_x", "plain", "", " a_c ", "élan_x", None, "sw_port"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, category string")
    many = with_group_table(df, spark.createDataFrame(table, "kind string, key string, target string"))
    want = [r.group_category for r in with_group(df, rules).orderBy("i").collect()]
    assert [r.group_category for r in many.orderBy("i").collect()] == want
    none = spark.createDataFrame([], "kind string, key string, target string")
    plain = [r.group_category for r in with_group(df, GroupRules(prefix={})).orderBy("i").collect()]
    assert [r.group_category for r in with_group_table(df, none).orderBy("i").collect()] == plain


# --- presets ------------------------------------------------------------------------------------------

def test_presets(spark, table):
    base = spark.createDataFrame([(0, "disk.*full", "space"), (1, "fan [0-9]+", "cooling")], "ord int, pattern string, description string")
    file = spark.createDataFrame([(0, " fan [0-9]+ ", "airflow "), (1, "door open", "d"), (2, "fan [0-9]+", "again")], base.schema)
    merged = merge_presets(base, file).orderBy("layer", "ord").collect()
    assert [(r.pattern, r.description) for r in merged] == [
        ("disk.*full", "space"), ("fan [0-9]+", "airflow"), ("door open", "d")]
    listed = spark.createDataFrame([(i, v) for i, v in enumerate([" hall ", "attic", "hall", ""])], "ord int, v string")
    assert [r.v for r in dedupe_ordered(listed, "v").orderBy("ord").collect()] == ["hall", "attic"]
    df = table(["Details"], [("x os classification score - -1",), ("failed to learn y : no updated classification.",), ("ok",)])
    tags = {r.line_no: len(r.presets) for r in tag_presets(df, HOST_PRESETS).collect()}
    assert tags == {1: 1, 2: 1, 3: 0}
    assert lines_of(filter_preset(df, HOST_PRESETS, HOST_PRESETS[1][1])) == [2]
    with pytest.raises(KeyError):
        filter_preset(df, HOST_PRESETS, "none")
