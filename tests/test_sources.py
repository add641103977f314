import gzip
import io
import csv as pycsv

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation, functions as F

from logtable.operators.rows import column_profile, default_columns, with_row_id
from logtable.sources.config import field_mappings, group_rules, read_presets
from logtable.sources.devinfo_dump import parse_devinfo, read_devinfo_dump
from logtable.sources.host_csv import read_host_csv
from logtable.sources.lines import read_lines
from logtable.sources.plugin_log import parse_plugin, plugin_records, read_plugin_log
from logtable.sources.stats_log import parse_stats, read_stats_log


@pytest.fixture(params=["one split", "many splits"])
def splits(request, spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    if request.param == "many splits":
        spark.conf.set(names[0], "2048")
        spark.conf.set(names[1], "0")
    yield request.param
    for name in names:
        spark.conf.unset(name)


def small_blocks(monkeypatch, size=16):
    import logtable.plans.ordered as ordered
    import logtable.sources.devinfo_dump as dump
    monkeypatch.setattr(ordered, "BLOCK", size)
    monkeypatch.setattr(dump, "FAN", max(2, size // 4))


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("line_no").select(*columns).collect()]


def numbered(spark, lines):
    return spark.createDataFrame([(i + 1, l) for i, l in enumerate(lines)], "line_no bigint, value string").repartition(3)


def test_lines_are_numbered_in_file_order(spark, tmp_path, splits):
    for name, first in (("b.log", 500), ("a.log", 0)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(first, first + 500)))
    lines = read_lines(spark, str(tmp_path))
    assert rows(lines, "line_no", "value") == [(i + 1, f"line {i}") for i in range(1000)]


def test_csv(spark, tmp_path, splits, monkeypatch):
    small_blocks(monkeypatch)
    header = ["Time", "Rack Unit", "Blank", "Details"]
    body = [[f"2031-04-09 17:45:{i % 60:02d}", f"a,{i}", "", f'say "{i}"\nthen, more\n\nend'] for i in range(100)]
    body += [["x", "y", "", "plain"]] * 2 + [["", "", "", " padded "]]
    out = io.StringIO()
    pycsv.writer(out, lineterminator="\r\n").writerows([header, *body])
    path = tmp_path / "host.csv"
    path.write_text("﻿" + out.getvalue(), newline="")
    df = read_host_csv(spark, str(path))
    assert df.columns == ["line_no", *header]
    assert rows(df, *[f"`{c}`" for c in header]) == [tuple(r) for r in body]
    assert default_columns(df) == ["Time", "Rack Unit", "Details"]
    ids = with_row_id(df).groupBy("row_id").count().filter("count > 1").collect()
    assert [r["count"] for r in ids] == [2]


def test_csv_without_line_breaks(spark, tmp_path, splits):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n" + "\n".join(f"{i},,"[:-1] for i in range(300)) + "\n\n,x\n")
    assert rows(read_host_csv(spark, str(path)), "a", "b") == [(str(i), "") for i in range(300)] + [("", "x")]


@pytest.mark.parametrize("body", ["a,b\n1\n", "a,b\n1,2,3\n", 'a,b\n1,x"y\n', 'a,b\n1,"open\n'])
def test_csv_malformed_fails_even_on_count(spark, tmp_path, body):
    path = tmp_path / "bad.csv"
    path.write_text(body)
    with pytest.raises((PySparkException, ValueError)):
        read_host_csv(spark, str(path)).select("a").count()


def test_csv_files_stand_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,x"\n2,y\n')
    (tmp_path / "b.csv").write_text('a,b\n3,"two\nlines"\n')
    with pytest.raises(ValueError, match="a.csv"):
        read_host_csv(spark, str(tmp_path / "*.csv"))
    assert rows(read_host_csv(spark, str(tmp_path / "b.csv")), "a", "b") == [("3", "two\nlines")]
    (tmp_path / "a.csv").write_text('a,b\n1,x"\n2,y"\n')
    with pytest.raises(PySparkException, match="a.csv"):
        read_host_csv(spark, str(tmp_path / "*.csv")).collect()
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    assert rows(read_host_csv(spark, str(tmp_path / "*.csv")), "a", "b") == [("1", "x"), ("3", "two\nlines")]


@pytest.mark.parametrize("body", ["3,x\n", '3,"two\nlines"\n'])
def test_csv_headers_must_agree(spark, tmp_path, body):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    (tmp_path / "b.csv").write_text("a,c\n" + body)
    with pytest.raises(ValueError, match="header"):
        read_host_csv(spark, str(tmp_path / "*.csv"))


def test_csv_refusals(spark, tmp_path):
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError):
        read_host_csv(spark, str(empty))
    with pytest.raises(ValueError):
        read_host_csv(spark, "x.txt")


PLUGIN = [
    "sw-3:77:1772600405.125:Wed Mar  4 05:00:05 2026: Warn: Poller::ask_radio:58: unit(7) gave no answer, 3 tries",
    "sw-3:77:1772600406.5:Wed Mar  4 05:00:06 2026: loop::tick:9:()::1: served 12, waiting 0",
]


def test_plugin_fields(spark):
    got = rows(parse_plugin(numbered(spark, PLUGIN)), "level", "module", "function", "line", "time", "message")
    assert got == [
        ("Warn", "Poller", "ask_radio", "58", "2026-03-04 05:00:05", "unit(7) gave no answer, 3 tries"),
        ("", "loop", "tick", "9", "2026-03-04 05:00:06", "()::1: served 12, waiting 0"),
    ]


def test_plugin_odd_heads(spark):
    lines = [
        "sw-12:1:2:payload only", "sw-21:1:2:Sat May 16 21:40:03 2026: x",  # not a start: goes on
        "sw:1:2:Mon Feb 30 21:40:03 2026: m::f:1: Warn: late level",
        "sw:1:2:Mon Feb  3 21:40:03 2026: Info: no place here", "sw:1:2:",
        "sw:1:2:Error:", "sw:1:2:Abc Feb 03 21:40:03 2026: a::b:2:", "sw-20:7:8.5:Debug: m::f:3: Info: kept",
    ]
    got = rows(parse_plugin(numbered(spark, lines)), "process", "time", "level", "module", "line", "message")
    assert got == [
        ("sw-12", "", "", "", "", "payload only\nsw-21:1:2:Sat May 16 21:40:03 2026: x"),
        ("sw", "Mon Feb 30 21:40:03 2026", "Warn", "m", "1", "late level"),
        ("sw", "2026-02-03 21:40:03", "Info", "", "", "no place here"),
        ("sw", "", "", "", "", ""), ("sw", "", "", "", "", "Error:"),
        ("sw", "Abc Feb 03 21:40:03 2026", "", "a", "2", ""),
        ("sw-20", "", "Debug", "m", "3", "Info: kept"),
    ]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_plugin_file_multi_line(spark, tmp_path, splits, monkeypatch, end):
    small_blocks(monkeypatch)
    for name in ("a.log", "b.log"):
        text = "preamble" + end + "more" + end
        for i in range(150):
            text += f"sw-12:{i}:{i}.5:Sat May 16 21:40:03 2026: main::f:{i}: first" + end + end + f"body {name} {i}" + end + end
        (tmp_path / name).write_text(text, newline="")
    df = read_plugin_log(spark, str(tmp_path))
    expected = [(k + 1, str(i), f"first\n\nbody {name} {i}")
                for k, (name, i) in enumerate((n, i) for n in ("a.log", "b.log") for i in range(150))]
    assert rows(df, "line_no", "pid", "message") == expected


def test_plugin_file_without_a_head_is_never_put_together(spark, monkeypatch):
    small_blocks(monkeypatch)
    head = "sw:{0}:1770000000.500000:Mon Jan 05 01:02:03 2026: Error: P::f:{0}: text"
    lines = [("a", head.format(1)), ("a", "more")] + [("b", f"no head {i}") for i in range(200)]
    lines += [("c", f"preamble {i}") for i in range(50)] + [("c", head.format(2)), ("c", ""), ("c", "last")]
    frame = spark.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(lines)], "line_no bigint, file string, value string")
    records = plugin_records(frame.repartition(3))
    assert rows(records, "line_no", "record") == [(1, head.format(1) + "\nmore"), (2, head.format(2) + "\n\nlast")]
    # Lines are left out below the aggregation that collects.
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in line and "file#" in line for line in plan[plan.index("collect_list"):].splitlines())


def test_plugin_without_records(spark, tmp_path):
    (tmp_path / "x.log").write_text("nothing here\n")
    with pytest.raises(ValueError):
        read_plugin_log(spark, str(tmp_path / "x.log"))
    assert read_plugin_log(spark, str(tmp_path / "x.log"), require_rows=False).count() == 0


STATS = "x 1900000000 collector 412 queue.depth 17\n\n x 1900000060 collector +412 queue.depth  19 \ntoo few fields\nx 1900000060 collector 412 state running   ok\n"


def test_stats(spark, tmp_path, splits):
    path = tmp_path / "today.txt"
    path.write_text(STATS)
    skipped = Observation()
    df = read_stats_log(spark, str(path), skipped=skipped)
    assert rows(df, "line_no", "date", "timestamp", "pid", "process", "key", "value") == [
        (1, "2030-03-17 17:46:40", "1900000000", "412", "collector", "queue.depth", "17"),
        (2, "2030-03-17 17:47:40", "1900000060", "412", "collector", "queue.depth", "19"),
        (3, "2030-03-17 17:47:40", "1900000060", "412", "collector", "state", "running ok"),
    ]
    assert skipped.get["skipped"] == 1


@pytest.mark.parametrize("line", ["x soon p 1 k v", "x 1 p one k v"])
def test_stats_bad_number(spark, line):
    lines = numbered(spark, ["x 1 p 2 k v", line])
    with pytest.raises(PySparkException):
        parse_stats(lines).select("key").collect()
    assert parse_stats(lines, mode="DROP").count() == 1


COPY_HEAD = "COPY public.devinfo (category, id, time, field_name, field_value, field_value_lc, agentid, extra) FROM stdin;"
DUMP = [
    "SET x;", COPY_HEAD,
    "sw_main\t10.0.0.1\t1900000000\tsw_mac_discovery_rate\tYES\tyes\t\te1",
    "sw_main\t10.0.0.1\t\tsw_mac_discovery_rate\tNO\tno\ta7\t",
    "sw_port\t10.0.0.1/1\t1900000001\talert_status\t1\t\ta7\t", "only\tthree\tfields", "\\.", "ignored\t\t\t\t\t\t\t",
]
INSERT = [
    "INSERT INTO public.devinfo VALUES ('host_a','h1','1','note','it''s',NULL,'a1',NULL),",
    " ('host_a','h1','1','note2','x','x','a1','');",
]


def test_copy_dump(spark):
    got = rows(parse_devinfo(numbered(spark, DUMP)), "category", "field_value", "field_value_lc", "agentid", "extra")
    assert got == [("sw_main", "YES", "yes", "", "e1"), ("sw_main", "NO", "no", "a7", ""), ("sw_port", "1", "1", "a7", "")]


def test_insert_dump(spark):
    got = rows(parse_devinfo(numbered(spark, DUMP + INSERT)), "line_no", "category", "field_name", "field_value", "extra")
    assert got[3:] == [(4, "host_a", "note", "it's", ""), (5, "host_a", "note2", "x", "")]


def test_insert_details(spark, monkeypatch):
    small_blocks(monkeypatch, 2)
    lines = [
        "insert into public.devinfo (category, id,", " time, f, v, l, a, e)", "values",
        "('c','1','','f','semi;colon (x)','','',''", "),('c','2','','f','line one",
        "copy public.devinfo x from stdin", "insert into public.devinfo values (''q", "two','','','')",
        ", ('short','row'),", "('c',3,null,'f', (1+2) ,'NULL','','a')", ";",
        "INSERT INTO public.devinfo select 1;", COPY_HEAD,
        "insert into public.devinfo values ('\t'\t(\tf\tv;\t\t\t", "\\.",
        "INSERT INTO public.devinfo VALUES ('d','4','','f','v','','',''); -- done",
    ]
    got = rows(parse_devinfo(numbered(spark, lines)),
               "line_no", "category", "id", "time", "field_value", "field_value_lc", "extra")
    long = "line one\ncopy public.devinfo x from stdin\ninsert into public.devinfo values ('q\ntwo"
    assert got == [
        (1, "c", "1", "", "semi;colon (x)", "semi;colon (x)", ""),
        (2, "c", "2", "", long, long, ""),
        (3, "c", "3", "", "1+2", "1+2", "a"),
        (4, "insert into public.devinfo values ('", "'", "(", "v;", "v;", ""),
        (5, "d", "4", "", "v", "v", ""),
    ]


def test_line_numbers_count_rows_with_and_without_insert(spark):
    alone = rows(parse_devinfo(numbered(spark, DUMP)), "line_no", "category")
    assert alone == [(1, "sw_main"), (2, "sw_main"), (3, "sw_port")]
    assert rows(parse_devinfo(numbered(spark, DUMP + INSERT)), "line_no", "category")[:3] == alone
    assert rows(parse_devinfo(numbered(spark, INSERT + DUMP)), "line_no", "category")[2:] == [(n + 2, c) for n, c in alone]


@pytest.mark.parametrize("depth", [1, 9, 40])
def test_nested_brackets_over_lines(spark, monkeypatch, depth):
    small_blocks(monkeypatch, 8)
    value = ["(" * (depth // 2), "(" * (depth - depth // 2) + "x", ")" * (depth // 2), ")" * (depth - depth // 2)]
    lines = ["insert into public.devinfo values ('c','1','','f',", *value, ",'','',''),", ") ('d','2','','f','y','','','');"]
    expected = [("c", "1", "x"), ("d", "2", "y")]
    assert [(c, i, v.strip()) for c, i, v in rows(parse_devinfo(numbered(spark, lines)), "category", "id", "field_value")] == expected
    assert rows(parse_devinfo(numbered(spark, ["".join(lines)])), "category", "id", "field_value") == expected


@pytest.mark.parametrize("lines, error", [
    (["insert into public.devinfo values ('a',"], ValueError),
    (["insert into public.devinfo values ('a', (1);"], PySparkException),
    (["insert into public.devinfo values ('a;"], ValueError),
])
def test_broken_insert(spark, lines, error):
    with pytest.raises(error):
        parse_devinfo(numbered(spark, lines)).collect()


def test_long_lines_of_an_insert(spark, monkeypatch):
    """Effects meet in blocks, whole lines never do: no text is collected to tell what lines start in."""
    import logtable.sources.devinfo_dump as dump
    monkeypatch.setattr(dump, "FAN", 64)
    big, lines = "x" * 200_000, ["INSERT INTO public.devinfo VALUES"]
    for i in range(200):
        lines += [f"('sw_a','{i}','1','f','{big}", "it''s (;','v','a','')" + (";" if i == 199 else ",")]
    found = parse_devinfo(numbered(spark, lines))
    got = found.select("id", F.length("field_value").alias("n"), F.right("field_value", F.lit(7)).alias("end")).collect()
    assert sorted((int(r["id"]), r["n"], r["end"]) for r in got) == [(i, len(big) + 8, "it's (;") for i in range(200)]
    labelled = dump._labelled(numbered(spark, ["a"]).withColumn("_kind", F.lit("")))
    assert "collect_list" not in labelled._jdf.queryExecution().optimizedPlan().toString()


def test_dump_files(spark, tmp_path, splits, monkeypatch):
    """One long statement and one long COPY block, cut anywhere, read the same."""
    small_blocks(monkeypatch)
    text = "INSERT INTO public.devinfo VALUES\n" + ",\n".join(
        f"('c','{i}','','f','it''s\n;{i}','','','')" for i in range(200)) + ";\n"
    text += COPY_HEAD + "\n" + "".join(f"k\t{i}\t\tf\tv{i}\t\t\t\r\n" for i in range(200)) + "\\.\n"
    (tmp_path / "d.dump").write_text(text, newline="")
    with gzip.open(tmp_path / "d2.dump.gz", "wt", newline="") as out:
        out.write(text)
    expected = [("c", str(i), f"it's\n;{i}") for i in range(200)] + [("k", str(i), f"v{i}") for i in range(200)]
    for name in ("d.dump", "d2.dump.gz"):
        df = read_devinfo_dump(spark, str(tmp_path / name))
        assert rows(df, "category", "id", "field_value") == expected
        assert rows(df, "line_no") == [(i + 1,) for i in range(400)]


def test_config_files(spark, tmp_path):
    (tmp_path / "groups.yaml").write_text("nosplit: [a_b]\nexact: {x_y: z}\nprefix:\n  sw_p: ports\n")
    rules = group_rules(spark, str(tmp_path / "groups"))
    assert rules.prefix == {"sw_": "sw", "sw_p": "ports"} and rules.nosplit == ("a_b",) and rules.exact == {"x_y": "z"}
    assert group_rules(spark, str(tmp_path / "none")).prefix == {"sw_": "sw"}
    (tmp_path / "mappings.json").write_text('{"sw": {"f": {"label": "L", "enum": {"1": "up"}, "hide": true}}}')
    got = field_mappings(spark, str(tmp_path / "mappings")).collect()
    assert [(r.scope, r.field_name, r.mapping.label, r.mapping.enum, r.mapping.hide) for r in got] == [("sw", "f", "L", {"1": "up"}, True)]
    (tmp_path / "p.json").write_text('{"presets": ["a", {"pattern": "b", "description": "B"}, " "]}')
    assert [tuple(r) for r in read_presets(spark, str(tmp_path / "p.json")).orderBy("ord").collect()] == [(0, "a", ""), (1, "b", "B")]
    assert read_presets(spark, str(tmp_path / "absent.json")).count() == 0


def test_roles_keep_a_blank_primary_column(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("Time,Details,Other\n1,,\n2, ,\n")
    df = read_host_csv(spark, str(path))
    assert default_columns(df) == ["Time", "Details"]
    profile = {r["column"]: (r["role"], r["has_data"]) for r in column_profile(df).collect()}
    assert profile == {"Time": ("secondary", True), "Details": ("primary", False), "Other": ("normal", False)}
