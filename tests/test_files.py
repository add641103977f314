import csv
import glob
import json
from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from logtable.operators import annotate as notes
from logtable.operators.filters import filter_regex, search
from logtable.operators.presets import tag_presets
from logtable.operators.rows import with_row_id, with_roles
from logtable.operators.view import LogView
from logtable.operators.windows import TimeWindow, with_ts
from logtable.plans.staging import clear_staging, stage, staging_root
from logtable.sinks.export import export_csv
from logtable.sinks.session import write_annotations, write_session
from logtable.sources.host_csv import read_host_csv
from logtable.sources.session import read_annotations, read_session

CELLS = ["Time", "Details"]
ROWS = [("2031-04-09 06:00:27", 'a "quoted", cell'), ("2031-04-09 07:00:27", "two\nlines"), ("", " padded "), ("x", "")]


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


@pytest.fixture
def log(table):
    return with_roles(with_row_id(table(CELLS, ROWS)), "host")


@pytest.fixture
def ann(spark, log):
    first, second = (log.filter(F.col("line_no") == n).first()["row_id"] for n in (1, 2))
    return spark.createDataFrame([(first, "red", None), (second, None, 'say "hi"')], notes.SCHEMA)


def exported(path):
    rows = []
    for part in sorted(glob.glob(f"{path}/part-*")):
        with open(part, newline="") as text:
            header, *body = csv.reader(text)
        assert header == [*CELLS, "Mark", "Comment"]
        rows += [tuple(r) for r in body]
    return rows


def test_export(spark, log, ann, tmp_path):
    view = LogView.of(log).sort("Details", desc=True)
    export_csv(view, ann, str(tmp_path / "a.csv"))
    marked = {1: ("red", ""), 2: ("", 'say "hi"')}
    expected = [(*ROWS[n - 1], *marked.get(n, ("", ""))) for n in (2, 3, 1, 4)]
    assert exported(tmp_path / "a.csv") == expected
    back = read_host_csv(spark, str(tmp_path / "a.csv")).orderBy("line_no")
    assert [tuple(r)[1:] for r in back.collect()] == expected


def test_export_of_an_empty_view(log, ann, tmp_path):
    nothing = LogView.of(log).filter("^never$").sort("Details")
    export_csv(nothing, ann, str(tmp_path / "all.csv"))
    assert [r[:2] for r in exported(tmp_path / "all.csv")] == ROWS
    export_csv(nothing, ann, str(tmp_path / "none.csv"), fallback_all=False)
    assert exported(tmp_path / "none.csv") == []


@pytest.mark.parametrize("format", ["parquet", "json", "document"])
def test_session_round_trip(spark, log, ann, tmp_path, format):
    window = TimeWindow(utc(2031, 4, 9, 6, 30), utc(2040, 1, 1))
    path = str(tmp_path / ("s" if format == "parquet" else "s.json"))
    write_session(log, ann, path, window, note="n", format=format)
    saved = read_session(spark, path)
    assert saved.rows.orderBy("line_no").select(*CELLS, "row_id", "line_no").collect() == (
        log.orderBy("line_no").select(*CELLS, "row_id", "line_no").collect())
    assert sorted(map(tuple, saved.annotations.collect())) == sorted(map(tuple, ann.collect()))
    assert saved.window == TimeWindow(utc(2031, 4, 9, 6, 30), utc(2031, 4, 9, 7, 0, 27)) and saved.note == "n"
    assert saved.rows.schema["Details"].metadata["role"] == "primary"
    assert saved.columns.visible == CELLS


def snapshot(**changes):
    document = {
        "version": 1,
        "header": [{"Name": "Time", "Index": 0, "Role": 2, "Visible": True}, {"Name": "D", "Index": 1, "Role": 1, "Visible": False}],
        "rows": [{"cols": ["100", "d"], "height": 2, "id": 2**64 - 1, "originalIndex": 1}, {"cols": ["200"], "id": 5, "originalIndex": 2}],
        "marked": {str(2**64 - 1): "red", "5": "mauve"}, "comments": {"5": "c"},
        "timeWindow": {"enabled": False, "start": "0001-01-01T00:00:00Z", "end": "0001-01-01T00:00:00Z"},
    }
    return json.dumps({**document, **changes}, indent=2)


def test_saved_document(spark, tmp_path):
    path = tmp_path / "old.json"
    path.write_text(snapshot())
    saved = read_session(spark, str(path))
    assert sorted(map(tuple, saved.rows.select("Time", "D", "row_id", "line_no").collect())) == [("100", "d", -1, 1), ("200", "", 5, 2)]
    assert sorted(map(tuple, saved.annotations.collect())) == [(-1, "red", None), (5, None, "c")]
    assert saved.window is None and saved.columns.visible == ["Time"]
    path.write_text(snapshot(timeWindow={"enabled": True, "start": "1970-01-01T00:03:00Z", "end": "1970-01-01T01:02:00+01:00"}))
    fitted = read_session(spark, str(path)).window
    assert fitted == TimeWindow(utc(1970, 1, 1, 0, 1, 40), utc(1970, 1, 1, 0, 3, 20))


def test_refused_documents(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text(snapshot(version=2))
    with pytest.raises(ValueError, match="version 2"):
        read_session(spark, str(path))
    path.write_text(snapshot(marked={"x": "red"}))
    with pytest.raises(PySparkException):
        read_session(spark, str(path)).annotations.collect()
    path.write_text(snapshot(timeWindow={"enabled": True, "start": "soon", "end": ""}))
    with pytest.raises(ValueError, match="invalid time"):
        read_session(spark, str(path))


@pytest.mark.parametrize("format", ["parquet", "json", "document"])
def test_annotations_alone(spark, log, ann, tmp_path, format):
    path = str(tmp_path / ("m" if format == "parquet" else "m.json"))
    write_annotations(ann, path, format)
    none = spark.createDataFrame([], notes.SCHEMA)
    merged = notes.merge_annotations(none, read_annotations(spark, path), log)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, ann.collect()))


TRICKY = ['a, "b": [{', "}], \\", 'c\\",\n', "", "\t,,,", "], {}, \"marked\": {", "é,\u2028ü"]


def joined(path):
    return "".join(part.read_text() for part in sorted(path.glob("part-*")))


def test_written_document_is_one_object(spark, table, tmp_path):
    rows = with_row_id(table(["A", "B"], [(text, text[::-1]) for text in TRICKY] * 30), ["A"])
    found = rows.select("row_id", "A", "line_no").filter(f"line_no <= {len(TRICKY)}").collect()
    marks = spark.createDataFrame([(r.row_id, "red" if r.line_no % 2 else None, r.A or None) for r in found], notes.SCHEMA)
    write_session(rows, marks, str(tmp_path / "s.json"), format="document")
    whole = json.loads(joined(tmp_path / "s.json"))
    assert [r["cols"] for r in whole["rows"]] == [[text, text[::-1]] for text in TRICKY] * 30
    assert [r["originalIndex"] for r in whole["rows"]] == list(range(1, 30 * len(TRICKY) + 1))
    assert whole["marked"] == {str(r.row_id % 2**64): "red" for r in found if r.line_no % 2}
    assert whole["comments"] == {str(r.row_id % 2**64): r.A for r in found if r.A}
    write_session(rows.limit(0), marks.limit(0), str(tmp_path / "none.json"), format="document")
    empty = json.loads(joined(tmp_path / "none.json"))
    assert (empty["rows"], empty["marked"], empty["comments"], empty["version"]) == ([], {}, {}, 1)
    assert read_session(spark, str(tmp_path / "none.json")).rows.count() == 0


@pytest.mark.parametrize("split, indent", [(1500, None), (2500, 2), (1 << 20, 2)])
def test_document_in_splits(spark, tmp_path, split, indent):
    """Commas, quotes, brackets and escapes in texts, wherever the splits fall."""
    cells = [[a, b] for a in TRICKY for b in TRICKY]
    document = {
        "comments": {str(i): text for i, text in enumerate(TRICKY)}, "other": [[1, {"rows": [2, 3]}], "x,y"],
        "note": "n, [", "version": 1, "marked": {},
        "header": [{"Name": "A,", "Index": 0, "Role": 0, "Visible": True}, {"Name": "B", "Index": 1, "Role": 0, "Visible": True}],
        "rows": [{"cols": c, "id": i, "originalIndex": i + 1, "extra": {"a": [1, 2]}} for i, c in enumerate(cells)],
    }
    (tmp_path / "d.json").write_text(json.dumps(document, indent=indent, ensure_ascii=split == 2500))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        saved = read_session(spark, str(tmp_path / "d.json"))
        got = saved.rows.orderBy("line_no").select("`A,`", "B", "row_id").collect()
        noted = dict(saved.annotations.select("row_id", "comment").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == [(*c, i) for i, c in enumerate(cells)]
    assert noted == {i: text for i, text in enumerate(TRICKY) if text}
    assert saved.note == "n, ["


@pytest.mark.parametrize("text", ['{"version": 1, "rows": [', '{"version": 1, "note": "a, ', "", '{"version": 1}}'])
def test_texts_that_are_no_document(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match="not one JSON document"):
        read_session(spark, str(tmp_path / "bad.json"))


def test_members_that_are_null(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"version":1,"header":null,"rows":null,"comments":{},"marked":null}')
    saved = read_session(spark, str(tmp_path / "n.json"))
    assert (saved.rows.count(), saved.annotations.count(), saved.window) == (0, 0, None)


def test_large_json_session(spark, tmp_path):
    """JSON sessions are written and read in parts, whatever their size."""
    rows = spark.range(0, 210_000, numPartitions=6).select(
        F.col("id").cast("string").alias("Details"), F.col("id").alias("row_id"), (F.col("id") + 1).alias("line_no"))
    marks = rows.select("row_id", F.lit("red").alias("mark"), F.lit(None).cast("string").alias("comment"))
    path = str(tmp_path / "s.json")
    write_session(rows, marks, path, format="json")
    saved = read_session(spark, path)
    assert saved.rows.filter("Details = row_id AND line_no = row_id + 1").count() == 210_000
    assert saved.annotations.filter("mark = 'red'").count() == 210_000
    assert len(glob.glob(f"{path}/rows/part-*")) == 6


def test_staging_follows_the_session(spark):
    df = spark.range(5)
    assert staging_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert stage(df).count() == 5
    clear_staging(spark)
    assert stage(df).count() == 5


def test_row_operators_on_a_stream(spark, tmp_path):
    """What looks at one row at a time runs on a stream as it is."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("error one\ninfo two\nerror three 12\n")
    lines = spark.readStream.text(str(tmp_path / "in")).withColumn("time", F.lit("100"))
    rows = with_ts(with_row_id(tag_presets(search(filter_regex(lines, "^error"), "ONE|three"[4:]), [("[0-9]+", "n")]), ["value"]), "time")
    query = rows.writeStream.format("memory").queryName("rows_out").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = spark.sql("SELECT value, presets FROM rows_out").collect()
    assert [(r.value, r.presets) for r in got] == [("error three 12", ["n"])]
