"""Work that must not grow faster than the input, and the same rows by it."""

import pytest
from pyspark.sql import functions as F

PIECES = [
    " ('a', 'b''c', NULL, 'x, (y)', 'null', ' d ', e f, ''),", "('1','2','3','4','5','6','7','8'), ('short'), (1,2,3,4,5,6,7,8);",
    " x) , 'out (', ('a' b 'c','','','','','','','two\nlines')", "()", "(a,(b,c),d,e,f,g,h,i), (1,2,3,4,5,6,7,8)", "(,,,,,,,)", "''''('''',2,3,4,5,6,7,'''x''')",
]


def test_flat_tuples_are_cut_without_a_window_over_tokens(spark):
    """One window over all tokens spilled more than the input holds."""
    from logtable.sources.devinfo_dump import _token_rows, _tuple_rows

    pieces = spark.createDataFrame(list(enumerate(PIECES, 1)), "line_no bigint, text string")
    found, slow = _tuple_rows(pieces), _token_rows(pieces)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, slow.collect()))
    flat = _tuple_rows(pieces.filter("line_no != 5"))
    assert "Window" not in flat._jdf.queryExecution().toString()
    assert {r["line_no"]: len(r["rows"]) for r in found.collect()} == {1: 1, 2: 2, 3: 1, 5: 2, 6: 1, 7: 1}


@pytest.mark.parametrize("text", ["('a", "(a, b", "(a, ('b), c)"])
def test_malformed_pieces_are_refused_by_either_way(spark, text):
    from logtable.sources.devinfo_dump import _tuple_rows

    with pytest.raises(Exception, match="malformed INSERT VALUES"):
        _tuple_rows(spark.createDataFrame([(1, text)], "line_no bigint, text string")).collect()


def test_blocks_of_a_dump_stay_whole_when_their_join_turns_into_a_broadcast(spark, monkeypatch):
    """At 60 times sf0.1 a block's lines were read by several tasks: rows went, or a sound dump was refused."""
    import logtable.sources.devinfo_dump as dump

    monkeypatch.setattr(dump, "FAN", 32)
    lines, expected = ["INSERT INTO public.devinfo VALUES"], []
    for i in range(300):
        lines += [f"('c','{i}','','f','on (two", "lines','','',''),"]
        expected.append((str(i), "on (two\nlines"))
    lines += ["('c','last','','f','v','','','');", "COPY public.devinfo (a) FROM stdin;", *[f"c\t{i}\t\tf\tv\t\t\t" for i in range(100)], "\\."]
    expected += [("last", "v"), *[(str(i), "v") for i in range(100)]]
    dealt = spark.createDataFrame(list(enumerate(lines, 1)), "line_no bigint, value string").repartition(8)
    # A join is planned by shuffles first, and a broadcast once its sizes are known; small shuffles are not put together.
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "16k",
               "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {name: spark.conf.get(name, None) for name in changed}
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        found = dump.parse_devinfo(dealt).orderBy("line_no").select("line_no", "id", "field_value").collect()
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert [tuple(r) for r in found] == [(n, *row) for n, row in enumerate(expected, 1)]


def test_running_sorts_rows_once_and_plugin_lines_leave_their_path(spark):
    """Blocks are joined after the window, so that a task holds its rows in one sort."""
    from logtable.plans.ordered import running
    from logtable.sources.plugin_log import plugin_records

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(10).selectExpr("id AS line_no", "CAST(id AS STRING) AS value")
        plan = running(rows, "line_no", {"n": F.col("line_no")}, {"v": F.col("value")})._jdf.queryExecution().sparkPlan().toString()
        assert plan.index("Join") < plan.index("Window")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    lines = rows.withColumn("file", F.concat(F.lit("a/path"), "value"))
    joined = plugin_records(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(" in joined


def test_first_cells_are_found_in_rows_dealt_out_evenly(spark):
    """The sort of a fold held all rows of a split."""
    from logtable.operators.devinfo import fold_entities, fold_fields

    raw = spark.createDataFrame([("c", "1", "", "f", "v", "v", "", "", 1)], ", ".join(f"{c} string" for c in (
        "category", "id", "time", "field_name", "field_value", "field_value_lc", "agentid", "extra")) + ", line_no bigint")
    for folded in (fold_entities(raw), fold_fields(raw)):
        assert "RebalancePartitions [line_no" in folded._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_of_a_document_are_not_dealt_out_in_lists(spark, tmp_path):
    from logtable.sources.json_document import _depth_change, read_json_document

    texts = ['{"a": [1', '"x" ]}', '[{"]"', 'plain', '"}']
    changes = spark.createDataFrame([(t,) for t in texts], "t string").select(_depth_change(F.col("t"))).collect()
    assert [r[0] for r in changes] == [2, -2, 2, 0, 0]
    (tmp_path / "d.json").write_text('{"version": 1, "rows": [{"a": "x, [\\"y"}, {"b": [1, 2]}], "note": ""}')
    document = read_json_document(spark, str(tmp_path / "d.json"))
    assert sorted(r["text"] for r in document.member("rows").collect()) == ['{"a": "x, [\\"y"}', '{"b": [1, 2]}']
    assert document.small("version", "note") == {"version": 1, "note": ""}
