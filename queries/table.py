"""Identity, numbering, columns, filters, sorts and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtable.functions.times import parse_log_ts
from logtable.operators import positions as places
from logtable.operators.columns import reorder_columns, reset_view, toggle_columns
from logtable.operators.filters import filter_marked, filter_regex, match_spans, regex_match, search
from logtable.operators.presets import (
    dedupe_ordered, filter_preset, many_preset_hits, merge_presets, preset_hits, tag_presets,
)
from logtable.sources.config import read_presets
from logtable.operators.rows import column_profile, with_line_no, with_row_id
from logtable.operators.sorting import ordering
from logtable.operators.view import LogView
from logtable.operators.windows import TimeWindow, filter_window, parse_input
from logtable.plans.ordered import in_order
from queries.tables import (
    EVENT_CELLS, EVENT_LOG, EVENT_TEXT, document_log, event_log, fnv_sql, marks, marks_sql, read,
    shared_log, write_document,
)

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def keep(function):
        QUERIES[name], SQL[name] = function, sql
        return function

    return keep


# --- identity and numbering -----------------------------------------------------

@query("row_id", f"""WITH {EVENT_LOG}
SELECT line_no, {fnv_sql('event', 'time', 'account', 'kind', 'value', 'props')} AS row_id FROM log""")
def row_id(spark, sf_dir):
    return with_row_id(event_log(spark, sf_dir), EVENT_CELLS).select("line_no", "row_id")


@query("row_text", f"WITH {EVENT_LOG} SELECT line_no, {EVENT_TEXT} AS text FROM log")
def text_of_rows(spark, sf_dir):
    from logtable.functions.text import row_text

    return event_log(spark, sf_dir).select("line_no", row_text(EVENT_CELLS).alias("text"))


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("line_numbers", f"""SELECT {", ".join(LINE_KEYS)},
  row_number() OVER (ORDER BY {", ".join(LINE_KEYS)}) AS line_no FROM lineitem""")
def line_numbers(spark, sf_dir):
    return with_line_no(read(spark, sf_dir, "lineitem").select(*LINE_KEYS), *LINE_KEYS)


@query("column_profile", """SELECT unnest(['event', 'account', 'kind', 'none', 'blank', 'message']) AS column,
  unnest([1, 2, 3, 4, 5, 6]) AS ordinal,
  unnest(['normal', 'normal', 'normal', 'normal', 'normal', 'primary']) AS role,
  unnest([max(trim(CAST(event_id AS VARCHAR)) <> ''), max(trim(CAST(user_id AS VARCHAR)) <> ''),
    max(trim(event_type) <> ''), false, false, max(event_type = 'none')]) AS has_data,
  unnest([max(trim(CAST(event_id AS VARCHAR)) <> ''), max(trim(CAST(user_id AS VARCHAR)) <> ''),
    max(trim(event_type) <> ''), false, false, true]) AS visible FROM events""")
def profile(spark, sf_dir):
    log = event_log(spark, sf_dir).select(
        "event", "account", "kind", F.lit(None).cast("string").alias("none"),
        F.when(F.col("kind") == "error", "\t ").otherwise("").alias("blank"),
        F.when(F.col("kind") == "none", "x").otherwise("").alias("message"),
    )
    return column_profile(log.withMetadata("message", {"role": "primary"}))


@query("column_select", """SELECT o_orderpriority, o_orderkey, o_custkey, o_totalprice, o_orderdate,
  o_orderkey + 1 AS line_no FROM orders""")
def column_select(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("line_no", F.col("o_orderkey") + 1)
    view, _, _ = reorder_columns(reset_view(orders), ["O_ORDERPRIORITY", "1", "nothing"])
    view, _, _ = toggle_columns(view, ["o_orderstatus"])
    return view.select(orders)


# --- filters ----------------------------------------------------------------------

PATTERN = r"(?i)\t(ERROR|view)\t[1-9]\d?\.\d+\t.*: [^1-5]\d?\}$"


@query("regex_filter", f"""WITH {EVENT_LOG}
SELECT line_no, kind, value FROM log WHERE regexp_matches({EVENT_TEXT}, '{PATTERN}')""")
def regex_filter(spark, sf_dir):
    return filter_regex(event_log(spark, sf_dir), PATTERN).select("line_no", "kind", "value")


DOCUMENT_PATTERN = r"(?i)\bof\b[^\n]{0,60}the.?\s[[:alpha:]]+\.$|[É&é]&{2}\s|(?m)^\pL{2,4}\.$"


@query("regex_documents", f"""SELECT doc_id + 1 AS line_no FROM documents
WHERE regexp_matches(text, '{DOCUMENT_PATTERN}')""")
def regex_documents(spark, sf_dir):
    return filter_regex(document_log(spark, sf_dir), DOCUMENT_PATTERN).select("line_no")


# Cells of about a megabyte: four hundred documents each, every other one with a closing quote.
CELL_DOCS = 400
QUOTED_PATTERN = r'"(?:[^"\\]|\\.)*"'
ENTIRE_PATTERN = r"(?s)^\"(?:[^ ]+|\s)*\"$"


@query("regex_quoted", f"""WITH cells AS (
  SELECT doc_id // {CELL_DOCS} + 1 AS line_no, '"' || string_agg(replace(text, '"', ''), ' ' ORDER BY doc_id)
    || CASE WHEN doc_id // {CELL_DOCS} % 2 = 0 THEN '"' ELSE '' END AS cell
  FROM documents WHERE text IS NOT NULL GROUP BY doc_id // {CELL_DOCS})
SELECT line_no, length(cell) AS chars, regexp_matches(cell, '{QUOTED_PATTERN}') AS quoted,
  regexp_matches(cell, '{ENTIRE_PATTERN}') AS entire
FROM cells""")
def regex_quoted(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("group", F.expr(f"doc_id div {CELL_DOCS}"))
    texts = F.array_sort(F.collect_list(F.struct("doc_id", F.replace("text", F.lit('"'), F.lit("")).alias("text"))))
    cells = docs.groupBy("group").agg(F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("texts")).select(
        (F.col("group") + 1).alias("line_no"),
        F.concat(F.lit('"'), "texts", F.when(F.col("group") % 2 == 0, '"').otherwise("")).alias("cell"))
    return cells.select(
        "line_no", F.char_length("cell").cast("long").alias("chars"), regex_match(F.col("cell"), QUOTED_PATTERN).alias("quoted"),
        regex_match(F.col("cell"), ENTIRE_PATTERN).alias("entire"))


PRESETS = (
    (r"(?i)token = \"[0-9a-f]+\"", "secret"),
    (r"[\w.]+@[\w-]+\.[a-z]+", "mail"),
    (r"\b\d{1,3}(\.\d{1,3}){3}\b", "address"),
    (r"(?i)licen[cs]e", "license"),
    (r"^\s*\S+\s*$", "one word"),
    (r"(?m)^\P{Lu}[^\n]*\| ", "table row"),
)


@query("preset_tags", "SELECT doc_id + 1 AS line_no, preset FROM documents CROSS JOIN (VALUES " + ", ".join(
    f"('{name}', '{pattern}')" for pattern, name in PRESETS
) + ") AS p(preset, pattern) WHERE regexp_matches(text, pattern)")
def preset_tags(spark, sf_dir):
    return preset_hits(document_log(spark, sf_dir), PRESETS).select("line_no", "preset")


@query("preset_filter", f"""SELECT doc_id + 1 AS line_no FROM documents
WHERE regexp_matches(text, '{PRESETS[2][0]}')""")
def preset_filter(spark, sf_dir):
    return filter_preset(document_log(spark, sf_dir), PRESETS, "address").select("line_no")


PAIRS = 5


@query("preset_many", f"""WITH words AS (SELECT item_id, string_split_regex(text, '[^A-Za-z]+') AS w FROM benchmark),
presets AS (SELECT item_id || ':' || k AS preset, '\\b' || w[2 * k + 1] || '[^A-Za-z]+' || w[2 * k + 2] || '\\b' AS pattern
  FROM words, range({PAIRS}) AS r(k) WHERE w[2 * k + 1] <> '' AND w[2 * k + 2] <> '')
SELECT doc_id + 1 AS line_no, preset FROM documents CROSS JOIN presets WHERE regexp_matches(text, pattern)""")
def preset_many(spark, sf_dir):
    """Five presets of each benchmark item: two neighbouring words, whatever stands between them."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.split("text", "[^A-Za-z]+").alias("w"))
    presets = [
        (rf"\b{row.w[2 * k]}[^A-Za-z]+{row.w[2 * k + 1]}\b", f"{row.item_id}:{k}")
        for row in words.collect() for k in range(PAIRS) if all(row.w[2 * k : 2 * k + 2]) and len(row.w) > 2 * k + 1
    ]
    return many_preset_hits(document_log(spark, sf_dir), presets).select("line_no", "preset")


FILE_PRESETS = ((r"(?i)licen[cs]e", "license"), (r"^[A-Z][a-z]+ [a-z]+ [a-z]+[.]", "three words"), ("[0-9]{3,}", ""))


@query("preset_file", "SELECT doc_id + 1 AS line_no, preset FROM documents CROSS JOIN (VALUES " + ", ".join(
    f"('{name}', '{pattern}')" for pattern, name in FILE_PRESETS
) + ") AS p(preset, pattern) WHERE regexp_matches(text, pattern)")
def preset_file(spark, sf_dir):
    """Presets written to a file, read back and applied; the last entry is plain text."""
    entries = [{"pattern": p, "description": d} for p, d in FILE_PRESETS[:-1]] + [FILE_PRESETS[-1][0], " "]
    presets = read_presets(spark, write_document(spark, {"presets": entries}))
    kept = [(r["pattern"], r["description"]) for r in presets.orderBy("ord").collect()]
    tagged = tag_presets(document_log(spark, sf_dir), kept)
    return tagged.select("line_no", F.explode("presets").alias("preset"))


@query("text_search", """SELECT doc_id + 1 AS line_no FROM documents
WHERE contains(lower(text), lower('CIÓNta'))""")
def text_search(spark, sf_dir):
    return search(document_log(spark, sf_dir), "  CIÓNta ").select("line_no")


@query("match_spans", """WITH pieces AS (
  SELECT doc_id, string_split(lower(text), 'the,') AS p FROM documents),
spans AS (SELECT doc_id, p, unnest(range(1, len(p))) AS hit FROM pieces WHERE len(p) > 1)
SELECT doc_id + 1 AS line_no, 'text' AS "column",
  CAST(list_sum(list_transform(p[1:hit], lambda x: length(x))) + (hit - 1) * 4 AS BIGINT) AS start
FROM spans""")
def spans(spark, sf_dir):
    hits = match_spans(document_log(spark, sf_dir), " the,")
    return hits.select("line_no", "column", F.explode("starts").alias("start"))


@query("time_window", """SELECT event_id + 1 AS line_no FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-19 18:30:00'""")
def time_window(spark, sf_dir):
    window = TimeWindow(parse_input("2024-01-05 06:00"), parse_input("2024-01-19 18:30:00"))
    return filter_window(event_log(spark, sf_dir), window).select("line_no")


MARKED = marks_sql("marked", "kind IN ('error', 'signup')")


@query("marked_rows", f"""WITH {EVENT_LOG}, {MARKED}
SELECT line_no FROM log SEMI JOIN (FROM marked WHERE mark IS NOT NULL) USING (account, kind)""")
def marked_rows(spark, sf_dir):
    log = shared_log(spark, sf_dir)
    wanted = marks(log, F.col("kind").isin("error", "signup"))
    return filter_marked(log, wanted).select("line_no")


# --- the combined view ---------------------------------------------------------------

VIEW_WINDOW = ("2024-01-03 00:00", "2024-01-28 12:00")
VIEW_PATTERN = r"(error|signup)\t\d+\.\d*[1-8]\t"


def combined_view(spark, sf_dir) -> LogView:
    log = shared_log(spark, sf_dir)
    wanted = marks(log, F.col("kind").isin("error", "signup"))
    window = TimeWindow(*[parse_input(text) for text in VIEW_WINDOW])
    view = LogView.of(log).only_marked(wanted).between(window).filter(VIEW_PATTERN)
    return view.sort("value", desc=True)


@query("view_pipeline", f"""WITH {EVENT_LOG}, {MARKED}
SELECT line_no, kind, value, row_number() OVER (ORDER BY CAST(value AS DOUBLE) DESC, line_no) AS pos
FROM log SEMI JOIN (FROM marked WHERE mark IS NOT NULL) USING (account, kind)
WHERE ts BETWEEN TIMESTAMP '{VIEW_WINDOW[0]}:00' AND TIMESTAMP '{VIEW_WINDOW[1]}:00'
  AND regexp_matches({EVENT_TEXT}, '{VIEW_PATTERN}')""")
def view_pipeline(spark, sf_dir):
    return combined_view(spark, sf_dir).positions().select("line_no", "kind", "value", "pos")


# --- typed sorts ----------------------------------------------------------------------

def sorted_column(df, column, desc=False):
    return in_order(df, ordering(df, column, desc)).select("line_no", "pos")


@query("sort_numbers", """SELECT o_orderkey + 1 AS line_no,
  row_number() OVER (ORDER BY CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE 1 END DESC,
    CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE round(o_totalprice) END DESC, o_orderkey) AS pos
FROM orders""")
def sort_numbers(spark, sf_dir):
    price = F.format_number(F.round("o_totalprice"), 0)  # with thousands commas
    orders = read(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 7 == 0, " ").otherwise(price).alias("price"),
        (F.col("o_orderkey") + 1).alias("line_no"),
    )
    return sorted_column(orders, "price", desc=True)


@query("sort_times", """SELECT o_orderkey + 1 AS line_no,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders""")
def sort_times(spark, sf_dir):
    date = F.col("o_orderdate")
    orders = read(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 3 == 0, F.unix_seconds(date.cast("timestamp")).cast("string"))
        .when(F.col("o_custkey") % 3 == 1, F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(date, "EEE MMM dd HH:mm:ss 'GMT' yyyy")).alias("date"),
        (F.col("o_orderkey") + 1).alias("line_no"),
    )
    return sorted_column(orders, "date")


@query("sort_texts", """SELECT p_partkey + 1 AS line_no,
  row_number() OVER (ORDER BY lower(t), t, p_partkey) AS pos
FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS t FROM part)""")
def sort_texts(spark, sf_dir):
    name = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    parts = read(spark, sf_dir, "part").select(name.alias("name"), (F.col("p_partkey") + 1).alias("line_no"))
    return sorted_column(parts, "name")


@query("sort_mixed", """SELECT p_partkey + 1 AS line_no, row_number() OVER (ORDER BY k,
    CASE k WHEN 1 THEN p_retailprice END, CASE k WHEN 2 THEN p_size END, CASE k WHEN 3 THEN p_name END,
    p_partkey) AS pos
FROM (SELECT *, p_size % 4 AS k FROM part)""")
def sort_mixed(spark, sf_dir):
    kind = F.col("p_size") % 4
    value = (
        F.when(kind == 1, F.col("p_retailprice").cast("string"))
        .when(kind == 2, F.concat(F.lit("2024-01-01 00:00:"), F.lpad(F.col("p_size").cast("string"), 2, "0")))
        .when(kind == 3, F.col("p_name")).otherwise("")
    )
    parts = read(spark, sf_dir, "part").select(value.alias("v"), (F.col("p_partkey") + 1).alias("line_no"))
    return sorted_column(parts, "v")


@query("sort_lines", """SELECT o_orderkey + 1 AS line_no,
  row_number() OVER (ORDER BY o_orderkey DESC) AS pos FROM orders""")
def sort_lines(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("line_no"))
    return sorted_column(orders, "#", desc=True)


# --- positions ---------------------------------------------------------------------------

def price_view(spark, sf_dir) -> LogView:
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("priority"),
        (F.col("o_orderkey") + 1).alias("line_no"),
    )
    return LogView.of(orders).filter("URGENT|HIGH").sort("price")


PRICE_VIEW = """placed AS (SELECT o_orderkey + 1 AS line_no, o_totalprice AS price,
  row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos, count(*) OVER () AS n
  FROM orders WHERE regexp_matches(o_orderpriority, 'URGENT|HIGH'))"""


@query("page", f"WITH {PRICE_VIEW} SELECT line_no, pos FROM placed WHERE pos BETWEEN 501 AND 550")
def page(spark, sf_dir):
    return price_view(spark, sf_dir).page(501, 50).select("line_no", "pos")


@query("deep_page", f"WITH {PRICE_VIEW} SELECT line_no, pos, price FROM placed WHERE pos BETWEEN n * 9 // 10 AND n * 9 // 10 + 39")
def deep_page(spark, sf_dir):
    view = price_view(spark, sf_dir)
    start = view.rows().count() * 9 // 10
    return view.page(start, 40).select("line_no", "pos", F.col("price").cast("double").alias("price"))


@query("last_page", f"WITH {PRICE_VIEW} SELECT line_no, pos FROM placed WHERE pos > n - 25")
def last_page(spark, sf_dir):
    return price_view(spark, sf_dir).last(25).select("line_no", "pos")


@query("row_at_line", """SELECT n AS line_no, CASE WHEN o_orderkey IS NULL THEN 'out of bounds'
    WHEN regexp_matches(o_orderpriority, 'URGENT|HIGH') THEN 'found' ELSE 'not in current filter' END AS status
FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 1000, 100000000]) AS n) LEFT JOIN orders ON o_orderkey + 1 = n""")
def row_at_line(spark, sf_dir):
    view = price_view(spark, sf_dir)
    wanted = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 1000, 100000000)], "line_no int")
    return places.rows_at_lines(view.df, view.rows(), wanted)


NEAR_MARKS = marks_sql("marked", "kind = 'error'")


@query("marked_neighbours", f"""WITH {EVENT_LOG}, {NEAR_MARKS}, placed AS (
  SELECT line_no, row_number() OVER (ORDER BY CAST(value AS DOUBLE), line_no) AS pos, m.mark IS NOT NULL AS hit
  FROM log LEFT JOIN marked m USING (account, kind))
SELECT line_no, pos,
  min(CASE WHEN hit THEN pos END) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_marked,
  max(CASE WHEN hit THEN pos END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_marked
FROM placed""")
def marked_neighbours(spark, sf_dir):
    log = shared_log(spark, sf_dir)
    found = places.with_marked_neighbours(
        LogView.of(log).sort("value").positions(), marks(log, F.col("kind") == "error")
    )
    return found.select("line_no", "pos", "next_marked", "prev_marked")


@query("hit_neighbours", f"""WITH {EVENT_LOG}, placed AS (
  SELECT line_no, row_number() OVER (ORDER BY CAST(value AS DOUBLE), line_no) AS pos,
    contains(lower({EVENT_TEXT}), 'error' || chr(9) || '1') AS hit FROM log)
SELECT line_no, pos,
  coalesce(min(CASE WHEN hit THEN pos END) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
    min(CASE WHEN hit THEN pos END) OVER ()) AS next_hit,
  coalesce(max(CASE WHEN hit THEN pos END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    max(CASE WHEN hit THEN pos END) OVER ()) AS prev_hit
FROM placed""")
def hit_neighbours(spark, sf_dir):
    placed = LogView.of(event_log(spark, sf_dir)).sort("value").positions()
    found = places.with_hit_neighbours(placed, "ERROR\t1", EVENT_CELLS)
    return found.select("line_no", "pos", "next_hit", "prev_hit")


@query("first_positions", f"""WITH {EVENT_LOG}, placed AS (
  SELECT "account", kind, row_number() OVER (ORDER BY CAST(value AS DOUBLE), line_no) AS pos FROM log)
SELECT {fnv_sql('account', 'kind')} AS row_id, pos FROM (
  SELECT "account", kind, min(pos) AS pos FROM placed GROUP BY ALL)""")
def first_positions(spark, sf_dir):
    return places.first_positions(LogView.of(shared_log(spark, sf_dir)).sort("value").positions())


# --- times in text ---------------------------------------------------------------------

def mixed_times(spark, sf_dir):
    """Event times written in nine ways, by event."""
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id") % 9
    us = F.unix_micros(ts)
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    zoned = F.date_format(ts, "EEE MMM dd HH:mm:ss 'BST' yyyy")
    text = (
        F.when(n == 0, F.unix_seconds(ts).cast("string"))
        .when(n == 1, F.unix_millis(ts).cast("string"))
        .when(n == 2, us.cast("string"))
        .when(n == 3, F.concat(us.cast("string"), F.lit("789")))
        .when(n == 4, F.concat(F.lit(" "), whole, F.lit("\t")))
        .when(n == 5, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")))
        .when(n == 6, zoned)
        .when(n == 7, F.concat(zoned, F.lit(":"), F.col("event_id").cast("string")))
        .otherwise(F.lit("no time"))
    )
    return read(spark, sf_dir, "events").select(
        text.alias("Time"), "event_type", (F.col("event_id") + 1).alias("line_no")
    )


MIXED_TIMES = """mixed AS (SELECT event_id + 1 AS line_no, CASE event_id % 9
    WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 1 THEN epoch_us(ts) // 1000 * 1000
    WHEN 2 THEN epoch_us(ts) WHEN 3 THEN epoch_us(ts)
    WHEN 4 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 5 THEN epoch_us(ts) - 7200000000
    WHEN 6 THEN epoch_us(ts) // 1000000 * 1000000 - 3600000000
    WHEN 7 THEN epoch_us(ts) // 1000000 * 1000000 - 3600000000 END AS us FROM events)"""


@query("time_formats", f"WITH {MIXED_TIMES} SELECT line_no, us FROM mixed")
def time_formats(spark, sf_dir):
    times = mixed_times(spark, sf_dir)
    return times.select("line_no", F.unix_micros(parse_log_ts("Time")).alias("us"))


# --- ordered lists ------------------------------------------------------------------------

def preset_tables(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_partkey").cast("int").alias("ord"),
        F.concat(F.lit(" "), "p_brand", F.lit("|"), "p_type", F.lit("\t")).alias("pattern"),
        F.concat_ws(" ", F.lit(""), "p_name", F.col("p_partkey").cast("string")).alias("description"),
        "p_size",
    )
    blank = F.when(F.col("p_size") == 1, " ").otherwise(F.col("pattern"))
    return rows.filter("p_size <= 30").withColumn("pattern", blank).drop("p_size"), rows.filter("p_size >= 20").drop("p_size")


@query("presets_merge", """WITH rows AS (
  SELECT p_partkey AS ord, p_brand || '|' || p_type AS pattern, trim(p_name || ' ' || p_partkey) AS description, p_size FROM part),
base AS (SELECT min(ord) AS ord, pattern, arg_min(description, ord) AS description FROM rows
  WHERE p_size <= 30 AND p_size <> 1 GROUP BY pattern),
overlay AS (SELECT min(ord) AS ord, pattern, arg_min(description, ord) AS description FROM rows
  WHERE p_size >= 20 GROUP BY pattern)
SELECT CASE WHEN b.pattern IS NULL THEN 1 ELSE 0 END AS layer, coalesce(b.ord, o.ord) AS ord,
  pattern, coalesce(o.description, b.description) AS description
FROM base b FULL JOIN overlay o USING (pattern)""")
def presets_merge(spark, sf_dir):
    return merge_presets(*preset_tables(spark, sf_dir))


@query("list_dedupe", """SELECT min(c_custkey) AS ord, c_mktsegment AS pattern FROM customer
WHERE c_nationkey <> 0 GROUP BY c_mktsegment""")
def list_dedupe(spark, sf_dir):
    entries = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.when(F.col("c_nationkey") == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("pattern"),
    )
    return dedupe_ordered(entries, "pattern")
