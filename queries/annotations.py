"""Marks, comments, sessions and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtable.operators.annotate import annotate, clean_marks, merge_annotations, set_comment, set_mark
from logtable.operators.positions import view_counts
from logtable.operators.rows import with_row_id
from logtable.operators.view import LogView
from logtable.operators.windows import TimeWindow, parse_input
from logtable.sinks.export import export_csv
from logtable.sinks.session import write_annotations, write_session
from logtable.sources.host_csv import read_host_csv
from logtable.sources.session import read_annotations, read_session
from queries.tables import (
    EVENT_CELLS, EVENT_LOG, event_log, fnv_sql, fresh_path, marks, marks_sql, read, shared_log,
)

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def keep(function):
        QUERIES[name], SQL[name] = function, sql
        return function

    return keep


ID = fnv_sql("account", "kind")
OLD = marks_sql("old", "kind IN ('error', 'signup', 'view')")
NEW = marks_sql("incoming", "kind IN ('error', 'click')").replace("n % 4", "(n + 1) % 4").replace(
    "n % 3", "(n + 1) % 3")


def old_marks(log):
    return marks(log, F.col("kind").isin("error", "signup", "view"))


def new_marks(log):
    moved = log.withColumn("account", (F.col("account").cast("int") + 1).cast("string"))
    rule = marks(moved, F.col("kind").isin("error", "click"))
    number = F.regexp_extract("comment", r"\d+", 0).cast("int") - 1
    return rule.withColumn(
        "comment", F.when(F.col("comment").isNotNull(), F.concat(F.lit("see user "), number.cast("string")))
    )


@query("annotate", f"""WITH {EVENT_LOG}, {OLD}
SELECT line_no, coalesce(mark, '') AS mark, coalesce(comment, '') AS comment
FROM log LEFT JOIN old USING (account, kind)""")
def annotated(spark, sf_dir):
    log = shared_log(spark, sf_dir)
    return annotate(log, old_marks(log)).select("line_no", "mark", "comment")


@query("merge_annotations", f"""WITH {EVENT_LOG}, {OLD}, {NEW},
present AS (SELECT DISTINCT account, kind FROM log WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'),
both_sides AS (SELECT account, kind, coalesce(n.mark, o.mark) AS mark, coalesce(n.comment, o.comment) AS comment
  FROM old o FULL JOIN (SELECT * FROM incoming SEMI JOIN present USING (account, kind)) n USING (account, kind))
SELECT {ID} AS row_id, mark, comment FROM both_sides""")
def merged(spark, sf_dir):
    log = shared_log(spark, sf_dir)
    fresh = log.filter(F.col("ts_parsed") >= F.to_timestamp_ntz(F.lit("2024-01-29 00:00:00")))
    return merge_annotations(old_marks(log), new_marks(log), fresh)


@query("set_marks", f"""WITH {EVENT_LOG}, {OLD},
chosen AS (SELECT DISTINCT account, kind FROM log WHERE CAST(value AS DOUBLE) > 60),
cleared AS (SELECT DISTINCT account, kind FROM log WHERE CAST(value AS DOUBLE) < 0.2),
first_step AS (SELECT account, kind, CASE WHEN c.account IS NULL THEN o.mark ELSE 'amber' END AS mark, o.comment
  FROM old o FULL JOIN chosen c USING (account, kind)),
second_step AS (SELECT account, kind, CASE WHEN c.account IS NULL THEN f.mark END AS mark, f.comment
  FROM first_step f LEFT JOIN cleared c USING (account, kind))
SELECT {ID} AS row_id, mark, comment FROM second_step WHERE mark IS NOT NULL OR comment IS NOT NULL""")
def set_marks(spark, sf_dir):
    log = shared_log(spark, sf_dir)
    value = F.col("value").cast("double")
    marked = set_mark(old_marks(log), log.filter(value > 60), "amber")
    return set_mark(marked, log.filter(value < 0.2), None)


@query("set_comments", f"""WITH {EVENT_LOG}, {OLD},
chosen AS (SELECT DISTINCT account, kind FROM log WHERE CAST(value AS DOUBLE) > 60),
cleared AS (SELECT DISTINCT account, kind FROM log WHERE CAST(value AS DOUBLE) < 0.2),
first_step AS (SELECT account, kind, o.mark, CASE WHEN c.account IS NULL THEN o.comment ELSE 'high value' END AS comment
  FROM old o FULL JOIN chosen c USING (account, kind)),
second_step AS (SELECT account, kind, f.mark, CASE WHEN c.account IS NULL THEN f.comment END AS comment
  FROM first_step f LEFT JOIN cleared c USING (account, kind))
SELECT {ID} AS row_id, mark, comment FROM second_step WHERE mark IS NOT NULL OR comment IS NOT NULL""")
def set_comments(spark, sf_dir):
    log = shared_log(spark, sf_dir)
    value = F.col("value").cast("double")
    commented = set_comment(old_marks(log), log.filter(value > 60), "high value")
    return set_comment(commented, log.filter(value < 0.2), "")


@query("clean_marks", """SELECT doc_id AS row_id, CASE quality * 2 + toxic WHEN 0 THEN 'amber'
  WHEN 1 THEN 'red' WHEN 2 THEN 'green' END AS mark, CASE WHEN toxic = 1 THEN 'toxic' END AS comment
FROM labels WHERE NOT (quality = 1 AND toxic = 1 AND doc_id < 0)""")
def cleaned(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    rule = F.col("quality") * 2 + F.col("toxic")
    return clean_marks(labels.select(
        F.col("doc_id").alias("row_id"),
        F.element_at(F.array(*map(F.lit, ("amber", "red", "green", "mauve"))), rule + 1).alias("mark"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("comment"),
    ))


@query("view_counts", f"""WITH {EVENT_LOG}, {OLD}, shown AS (
  SELECT coalesce(mark, '') AS mark, coalesce(comment, '') AS comment
  FROM log LEFT JOIN old USING (account, kind) WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')
SELECT count(*) AS rows, count(*) FILTER (mark <> '') AS marked_rows,
  count(*) FILTER (comment <> '') AS commented_rows, CAST(sum(length(comment)) AS BIGINT) AS comment_chars FROM shown""")
def counted(spark, sf_dir):
    log = shared_log(spark, sf_dir)
    late = log.filter(F.col("ts_parsed") >= F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")))
    return view_counts(annotate(late, old_marks(log)))


# --- files ----------------------------------------------------------------------------------

WINDOW = TimeWindow(parse_input("2024-01-02 00:00"), parse_input("2024-01-30 00:00"))


def session_log(spark, sf_dir):
    log = with_row_id(event_log(spark, sf_dir), ["account", "kind"])
    return log.drop("ts_parsed")


@query("session_parquet", f"""WITH {EVENT_LOG}, {OLD}
SELECT line_no, event, time, account, kind, value, props, coalesce(mark, '') AS mark,
  coalesce(comment, '') AS comment FROM log LEFT JOIN old USING (account, kind)
WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-30 00:00:00'""")
def session_parquet(spark, sf_dir):
    log = session_log(spark, sf_dir)
    path = fresh_path(spark)
    write_session(log, old_marks(log), path, WINDOW)
    saved = read_session(spark, path)
    from logtable.operators.windows import filter_window, with_ts

    shown = filter_window(with_ts(saved.rows), saved.window)
    return annotate(shown, saved.annotations).select("line_no", *EVENT_CELLS, "mark", "comment")


@query("session_json", f"""WITH {EVENT_LOG}, {OLD}
SELECT line_no, {ID} AS row_id, time, coalesce(mark, '') AS mark, coalesce(comment, '') AS comment
FROM log LEFT JOIN old USING (account, kind)""")
def session_json(spark, sf_dir):
    log = session_log(spark, sf_dir)
    path = fresh_path(spark, ".json")
    write_session(log, old_marks(log), path, WINDOW, format="json")
    saved = read_session(spark, path)
    return annotate(saved.rows, saved.annotations).select("line_no", "row_id", "time", "mark", "comment")


@query("session_document", f"""WITH {EVENT_LOG}, {OLD}
SELECT line_no, {ID} AS row_id, time, props, coalesce(mark, '') AS mark, coalesce(comment, '') AS comment
FROM log LEFT JOIN old USING (account, kind)""")
def session_document(spark, sf_dir):
    """Out as one JSON object in parts, and in again."""
    log = session_log(spark, sf_dir)
    path = fresh_path(spark, ".json")
    write_session(log, old_marks(log), path, WINDOW, format="document")
    saved = read_session(spark, path)
    return annotate(saved.rows, saved.annotations).select("line_no", "row_id", "time", "props", "mark", "comment")


@query("annotations_document", f"""WITH {EVENT_LOG}, {OLD} SELECT {ID} AS row_id, mark, comment FROM old""")
def annotations_document(spark, sf_dir):
    path = fresh_path(spark, ".json")
    write_annotations(old_marks(shared_log(spark, sf_dir)), path, format="document")
    return read_annotations(spark, path)


@query("annotations_file", f"""WITH {EVENT_LOG}, {OLD} SELECT {ID} AS row_id, mark, comment FROM old""")
def annotations_file(spark, sf_dir):
    path = fresh_path(spark, ".json")
    write_annotations(old_marks(shared_log(spark, sf_dir)), path, format="json")
    return read_annotations(spark, path)


@query("export_csv", f"""WITH {EVENT_LOG}, {OLD}
SELECT row_number() OVER (ORDER BY CAST(value AS DOUBLE) DESC, line_no) AS line_no, event, time, account, kind,
  value, props, coalesce(mark, '') AS "Mark", coalesce(comment, '') AS "Comment"
FROM log LEFT JOIN old USING (account, kind) WHERE kind <> 'view'""")
def exported(spark, sf_dir):
    log = shared_log(spark, sf_dir)
    path = fresh_path(spark, ".csv")
    view = LogView.of(log).filter(r"\t(click|error|purchase|signup)\t").sort("value", desc=True)
    export_csv(view, old_marks(log), path)
    return read_host_csv(spark, path)


@query("export_fallback", f"""WITH {EVENT_LOG}, {OLD}
SELECT line_no, event, kind, coalesce(mark, '') AS "Mark" FROM log LEFT JOIN old USING (account, kind)""")
def exported_fallback(spark, sf_dir):
    """An empty view exports every row in line order."""
    log = shared_log(spark, sf_dir)
    path = fresh_path(spark, ".csv")
    export_csv(LogView.of(log).filter("^nothing at all$").sort("value"), old_marks(log), path)
    return read_host_csv(spark, path).select("line_no", "event", "kind", "Mark")


@query("export_pages", """SELECT page_id + 1 AS line_no, url, replace(html, '>', E'>\\n') AS html,
  '' AS "Mark", '' AS "Comment" FROM pages""")
def exported_pages(spark, sf_dir):
    """Cells with quotes, commas and line breaks, there and back."""
    pages = read(spark, sf_dir, "pages").select(
        "url", F.replace("html", F.lit(">"), F.lit(">\n")).alias("html"), (F.col("page_id") + 1).alias("line_no")
    )
    log = with_row_id(pages, ["url"])
    path = fresh_path(spark, ".csv")
    export_csv(LogView.of(log), spark.createDataFrame([], "row_id bigint, mark string, comment string"), path)
    return read_host_csv(spark, path)
