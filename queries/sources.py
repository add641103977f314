"""Log and dump text derived from the tables, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logtable.operators.devinfo import (
    GroupRules, apply_mappings, devinfo_query, entity_order, fold, fold_entities, list_categories,
    list_groups, with_group_table,
)
from logtable.plans.ordered import in_order
from logtable.plans.staging import stage
from logtable.sources.config import field_mappings, group_rules
from logtable.sources.devinfo_dump import RAW, parse_devinfo, read_devinfo_dump
from logtable.sources.lines import read_lines
from logtable.sources.plugin_log import COLUMNS as PLUGIN_COLUMNS, parse_plugin, read_plugin_log
from logtable.sources.stats_log import COLUMNS as STATS_COLUMNS, parse_stats, read_stats_log
from queries.tables import read, write_document, write_lines

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def keep(function):
        QUERIES[name], SQL[name] = function, sql
        return function

    return keep


# --- plugin logs --------------------------------------------------------------------------

def plugin_texts(spark, sf_dir) -> DataFrame:
    """Four lines per event: a head, a blank, a body and a blank, with levels in either place."""
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id")
    shard = F.concat(F.lit("sw-"), (n % 20 + 1).cast("string"))
    micros = F.unix_micros(ts).cast("string")
    place = F.concat(F.lit("mod"), (n % 7).cast("string"), F.lit("::fn_"), "event_type", F.lit(":"),
                     n.cast("string"), F.lit(": "))
    level = F.initcap("event_type")
    payload = (
        F.when(n % 4 == 0, F.concat(level, F.lit(": "), place, "props"))
        .when(n % 4 == 1, F.concat(place, level, F.lit(": "), "props"))
        .when(n % 4 == 2, F.concat(place, "props"))
        .otherwise(F.concat(level, F.lit(": no place "), "props"))
    )
    head = F.concat(
        F.when(n % 3 == 0, "sw").otherwise(shard), F.lit(":"), F.col("user_id").cast("string"), F.lit(":"),
        F.substring(micros, 1, 10), F.lit("."), F.substring(micros, 11, 6), F.lit(":"),
        F.date_format(ts, "EEE MMM dd HH:mm:ss yyyy"), F.lit(": "), payload,
    )
    body = F.concat(F.lit("value sw:"), F.col("value").cast("string"))
    return read(spark, sf_dir, "events").select(
        n.alias("line_no"), F.concat_ws("\n", head, F.lit(""), body, F.lit("")).alias("value")
    )


def plugin_lines(spark, sf_dir) -> DataFrame:
    lines = plugin_texts(spark, sf_dir).select("line_no", F.posexplode(F.split("value", "\n")))
    return lines.select((F.col("line_no") * 4 + F.col("pos")).alias("line_no"), F.col("col").alias("value"))


PLUGIN = """SELECT event_id + 1 AS line_no,
  CASE WHEN event_id % 3 = 0 THEN 'sw' ELSE 'sw-' || (event_id % 20 + 1) END AS process,
  CAST(user_id AS VARCHAR) AS pid, substr(CAST(epoch_us(ts) AS VARCHAR), 1, 10) || '.' || substr(CAST(epoch_us(ts) AS VARCHAR), 11, 6) AS epoch,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS time,
  CASE WHEN event_id % 4 = 2 THEN '' ELSE upper(event_type[1]) || event_type[2:] END AS level,
  CASE WHEN event_id % 4 = 3 THEN '' ELSE 'mod' || event_id % 7 END AS module,
  CASE WHEN event_id % 4 = 3 THEN '' ELSE 'fn_' || event_type END AS function,
  CASE WHEN event_id % 4 = 3 THEN '' ELSE CAST(event_id AS VARCHAR) END AS line,
  CASE WHEN event_id % 4 = 3 THEN 'no place ' ELSE '' END || props || chr(10) || chr(10) || 'value sw:' || CAST(value AS VARCHAR) AS message
FROM events"""


@query("plugin_parse", PLUGIN)
def plugin_parse(spark, sf_dir):
    return parse_plugin(plugin_lines(spark, sf_dir)).select("line_no", *PLUGIN_COLUMNS)


@query("plugin_file", PLUGIN)
def plugin_file(spark, sf_dir):
    path = write_lines(plugin_texts(spark, sf_dir))  # a record stays in one file
    return read_plugin_log(spark, path).select("line_no", *PLUGIN_COLUMNS)


# --- statistics logs --------------------------------------------------------------------------

def stats_lines(spark, sf_dir) -> DataFrame:
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id")
    line = F.when(n % 10 == 3, "too few fields").when(n % 10 == 4, F.lit(" \t ")).otherwise(F.concat_ws(
        "  ", F.lit("\tx"), F.unix_seconds(ts).cast("string"), F.concat(F.lit("proc"), (n % 5).cast("string")),
        F.concat(F.lit("+"), F.col("user_id").cast("string")), "event_type", F.col("value").cast("string"), F.lit("unit\t of"), "props",
    ))
    return read(spark, sf_dir, "events").select((n + 1).alias("line_no"), line.alias("value"))


STATS = """SELECT {line_no} AS line_no,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS timestamp,
  CAST(user_id AS VARCHAR) AS pid, 'proc' || event_id % 5 AS process, event_type AS key,
  CAST(value AS VARCHAR) || ' unit of ' || props AS value FROM events WHERE event_id % 10 NOT IN (3, 4)"""


@query("stats_parse", STATS.format(line_no="event_id + 1"))
def stats_parse(spark, sf_dir):
    return parse_stats(stats_lines(spark, sf_dir)).select("line_no", *STATS_COLUMNS)


@query("stats_file", STATS.format(line_no="row_number() OVER (ORDER BY event_id)"))
def stats_file(spark, sf_dir):
    return read_stats_log(spark, write_lines(stats_lines(spark, sf_dir))).select("line_no", *STATS_COLUMNS)


@query("lines_file", """SELECT doc_id * 1000000 + i AS line, row_number() OVER (ORDER BY doc_id, i) AS line_no, piece AS value
FROM (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS piece
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))""")
def lines_file(spark, sf_dir):
    """Document lines written as text, and numbered by the scan."""
    pieces = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")))
    line = F.col("doc_id") * 1000000 + F.col("pos")
    path = write_lines(pieces.select(
        line.alias("line_no"), F.concat(line.cast("string"), F.lit(" "), "col").alias("value")
    ))
    found = read_lines(spark, path, sep="\n")
    return found.select(
        F.substring_index("value", " ", 1).cast("bigint").alias("line"), "line_no",
        F.regexp_replace("value", r"^[0-9]+ ", "").alias("value"),
    )


# --- device information ------------------------------------------------------------------------

def attributes(spark, sf_dir) -> DataFrame:
    """Customers and suppliers as entity-attribute-value rows, some of them repeated."""
    customer, supplier = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")

    def rows(table, start, category, id, fields):
        cells = F.array(*[
            F.struct(F.lit(f).alias("field_name"), v.cast("string").alias("field_value"),
                     F.lit(a).alias("agentid"), F.lit(t).alias("time"), F.lit(x).alias("extra"))
            for f, v, a, t, x in fields
        ])
        # Rows grow several times over here, so a table of one split is dealt out before.
        return table.hint("rebalance", id).select(
            category.alias("category"), F.col(id).cast("string").alias("id"), F.col(id).alias("n"), F.posexplode(cells)
        ).select(
            (F.lit(start) + F.col("n") * len(fields) + F.col("pos") + 1).alias("line_no"),
            "category", "id", "col.time", "col.field_name", "col.field_value",
            F.lit("").alias("field_value_lc"), "col.agentid", "col.extra",
        )

    balance, nation = F.col("c_acctbal"), F.col("c_nationkey")
    segment = F.lower("c_mktsegment")
    customers = rows(customer, 0, F.concat(F.when(nation < 5, "sw_").otherwise("net_"), segment), "c_custkey", [
        ("name", F.col("c_name"), "", "", ""),
        ("balance", balance, "", "t1", ""),
        ("nation", nation, "a7", "t2", ""),
        ("name", F.lit("again"), "a8", "", "e1"),
        ("active", F.when(balance > 0, "Yes").otherwise("OFF"), "", "", ""),
        ("", F.lit("no field"), "", "", "e2"),
        ("note", F.concat(F.lit("it's; ("), segment, F.lit(")")), "", "", ""),
    ])
    suppliers = rows(supplier, 10**9, F.concat(F.lit("port"), (F.col("s_nationkey") % 3).cast("string")), "s_suppkey", [
        ("name", F.col("s_name"), "a1", "", "x"),
        ("active", F.when(F.col("s_acctbal") > 500, "1").otherwise("maybe"), "", "t9", ""),
        ("secret", F.col("s_acctbal"), "", "", ""),
    ])
    return customers.unionByName(suppliers)


ATTRIBUTES = """attributes AS (
  SELECT c_custkey * 7 + k AS line_no, CASE WHEN c_nationkey < 5 THEN 'sw_' ELSE 'net_' END || lower(c_mktsegment) AS category,
    CAST(c_custkey AS VARCHAR) AS id, ['', 't1', 't2', '', '', '', ''][k] AS time,
    ['name', 'balance', 'nation', 'name', 'active', '', 'note'][k] AS field_name,
    [c_name, CAST(c_acctbal AS VARCHAR), CAST(c_nationkey AS VARCHAR), 'again',
      CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'OFF' END, 'no field', 'it''s; (' || lower(c_mktsegment) || ')'][k] AS field_value,
    ['', '', 'a7', 'a8', '', '', ''][k] AS agentid, ['', '', '', 'e1', '', 'e2', ''][k] AS extra
  FROM customer, (SELECT unnest(range(1, 8)) AS k)
  UNION ALL
  SELECT 1000000000 + s_suppkey * 3 + k, 'port' || s_nationkey % 3, CAST(s_suppkey AS VARCHAR), ['', 't9', ''][k],
    ['name', 'active', 'secret'][k],
    [s_name, CASE WHEN s_acctbal > 500 THEN '1' ELSE 'maybe' END, CAST(s_acctbal AS VARCHAR)][k],
    ['a1', '', ''][k], ['x', '', ''][k]
  FROM supplier, (SELECT unnest(range(1, 4)) AS k))"""

COPY_HEAD = "COPY public.devinfo (category, id, time, field_name, field_value, field_value_lc, agentid, extra) FROM stdin;"


def _one_line(spark, line_no: int, value: str) -> DataFrame:
    return spark.createDataFrame([(line_no, value)], "line_no bigint, value string")


def copy_lines(spark, sf_dir) -> DataFrame:
    """All attributes in one COPY block, with other text around it."""
    rows = attributes(spark, sf_dir).select(
        F.col("line_no"), F.concat_ws("\t", *RAW).alias("value")
    )
    for line_no, value in ((-1, "SET client_encoding = 'UTF8';"), (0, COPY_HEAD), (10**12, "\\."), (10**12 + 1, "a\tb\tc\td\te\tf\tg\th")):
        rows = rows.unionByName(_one_line(spark, line_no, value))
    return rows


def insert_lines(spark, sf_dir) -> DataFrame:
    """Customers in one long INSERT statement, suppliers in a COPY block."""
    rows = attributes(spark, sf_dir)

    def text(column):
        return F.when(F.col(column) == "", "NULL").otherwise(
            F.concat(F.lit("'"), F.replace(F.col(column), F.lit("'"), F.lit("''")), F.lit("'")))

    inserted = rows.filter("line_no < 1000000000").select(
        "line_no", F.concat(F.lit("  ("), F.concat_ws(", ", *[text(c) for c in RAW]), F.lit("),")).alias("value")
    )
    copied = rows.filter("line_no >= 1000000000").select("line_no", F.concat_ws("\t", *RAW).alias("value"))
    lines = inserted.unionByName(copied)
    for line_no, value in (
        (-1, "INSERT INTO public.devinfo (category, id, time, field_name,"),
        (0, "  field_value, field_value_lc, agentid, extra) VALUES"),
        (10**9 - 3, "  ('last', '0', '', 'f', 'on two"), (10**9 - 2, "lines', NULL, '', '');"),
        (10**9 - 1, COPY_HEAD), (10**12, "\\."),
    ):
        lines = lines.unionByName(_one_line(spark, line_no, value))
    return lines


RAW_SQL = "category, id, time, field_name, field_value, lower(field_value) AS field_value_lc, agentid, extra"


@query("devinfo_copy", f"WITH {ATTRIBUTES} SELECT {RAW_SQL} FROM attributes")
def devinfo_copy(spark, sf_dir):
    return parse_devinfo(stage(copy_lines(spark, sf_dir))).select(*RAW)


@query("devinfo_copy_file", f"""WITH {ATTRIBUTES}
SELECT row_number() OVER (ORDER BY line_no) AS line_no, {RAW_SQL} FROM attributes""")
def devinfo_copy_file(spark, sf_dir):
    return read_devinfo_dump(spark, write_lines(copy_lines(spark, sf_dir))).select("line_no", *RAW)


@query("devinfo_escapes", """SELECT row_number() OVER (ORDER BY p_partkey) AS line_no, CAST(p_partkey AS VARCHAR) AS id,
  replace(p_name, ' ', chr(9)) || chr(10) || p_brand || chr(13) || chr(92) || chr(92) || p_type AS field_value,
  CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS extra FROM part""")
def devinfo_escapes(spark, sf_dir):
    """COPY rows with tabs, line ends and backslashes inside values, and nulls."""
    part = read(spark, sf_dir, "part")
    value = F.concat(
        F.replace("p_name", F.lit(" "), F.lit(r"\\t")), F.lit(r"\\n"), "p_brand", F.lit(r"\\r"), F.lit("\\" * 4), "p_type")
    extra = F.when(F.col("p_size") % 2 == 0, F.lit(r"\\N")).otherwise(F.col("p_type"))
    key = F.col("p_partkey").cast("string")
    lines = part.select(
        (F.col("p_partkey") + 1).cast("long").alias("line_no"),
        F.concat_ws("\t", F.lit("c"), key, F.lit(""), F.lit("f"), value, F.lit(""), F.lit(""), extra).alias("value"),
    ).unionByName(_one_line(spark, 0, COPY_HEAD)).unionByName(_one_line(spark, 10**12, "\\."))
    return parse_devinfo(stage(lines)).select("line_no", "id", "field_value", "extra")


INSERTED = f"""WITH {ATTRIBUTES}, both_parts AS (SELECT * FROM attributes UNION ALL
  SELECT 999999999, 'last', '0', '', 'f', 'on two' || chr(10) || 'lines', '', '')
SELECT row_number() OVER (ORDER BY line_no) AS line_no, {RAW_SQL} FROM both_parts"""


@query("devinfo_insert", INSERTED)
def devinfo_insert(spark, sf_dir):
    return parse_devinfo(stage(insert_lines(spark, sf_dir))).select("line_no", *RAW)


@query("devinfo_insert_file", INSERTED)
def devinfo_insert_file(spark, sf_dir):
    return read_devinfo_dump(spark, write_lines(insert_lines(spark, sf_dir))).select("line_no", *RAW)


@query("devinfo_fold", f"""WITH {ATTRIBUTES},
entities AS (SELECT category, id, min(line_no) AS seen,
    coalesce(arg_min(agentid, line_no) FILTER (agentid <> ''), '') AS agentid,
    coalesce(arg_min(time, line_no) FILTER (time <> ''), '') AS time,
    coalesce(arg_min(extra, line_no) FILTER (extra <> ''), '') AS extra
  FROM attributes GROUP BY category, id),
fields AS (SELECT category, id, field_name, arg_min(field_value, line_no) AS raw_value, min(line_no) AS field_seen
  FROM attributes WHERE field_name <> '' GROUP BY ALL)
SELECT category, id, field_name, raw_value, lower(raw_value) AS raw_value_lc, field_seen, seen, agentid, time, extra,
  CASE WHEN category LIKE 'sw\\_%' ESCAPE '\\' THEN 'sw' WHEN category LIKE 'net%' THEN 'net' ELSE category END AS group_category
FROM fields JOIN entities USING (category, id)""")
def devinfo_fold(spark, sf_dir):
    return fold(folded_raw(spark, sf_dir))


def folded_raw(spark, sf_dir):
    return attributes(spark, sf_dir).withColumn("field_value_lc", F.lower("field_value"))


@query("devinfo_entities", f"""WITH {ATTRIBUTES}
SELECT category, id, min(line_no) AS seen,
  coalesce(arg_min(agentid, line_no) FILTER (agentid <> ''), '') AS agentid,
  coalesce(arg_min(time, line_no) FILTER (time <> ''), '') AS time,
  coalesce(arg_min(extra, line_no) FILTER (extra <> ''), '') AS extra
FROM attributes GROUP BY category, id""")
def devinfo_entities(spark, sf_dir):
    return fold_entities(folded_raw(spark, sf_dir))


RULES = GroupRules(nosplit=("net_building",), exact={"port1": "uplink"}, prefix={"sw_": "sw", "sw_m": "core", "port": "ports"})
GROUP = """CASE WHEN category = 'net_building' THEN category WHEN category = 'port1' THEN 'uplink'
  WHEN starts_with(category, 'port') OR starts_with(category, 'sw_m') THEN
    CASE WHEN starts_with(category, 'port') THEN 'ports' ELSE 'core' END
  WHEN starts_with(category, 'sw_') THEN 'sw' ELSE split_part(category, '_', 1) END"""


@query("devinfo_groups", f"""WITH {ATTRIBUTES}
SELECT {GROUP} AS group_category, min(line_no) AS seen FROM attributes GROUP BY 1""")
def devinfo_groups(spark, sf_dir):
    return list_groups(attributes(spark, sf_dir), RULES)


@query("devinfo_groups_file", f"""WITH {ATTRIBUTES}
SELECT {GROUP} AS group_category, min(line_no) AS seen FROM attributes GROUP BY 1""")
def devinfo_groups_file(spark, sf_dir):
    """The same by rules from a file; the default prefix rule is added to it."""
    rules = {"nosplit": list(RULES.nosplit), "exact": RULES.exact, "prefix": {k: v for k, v in RULES.prefix.items() if k != "sw_"}}
    return list_groups(attributes(spark, sf_dir), group_rules(spark, write_document(spark, rules)))


@query("devinfo_groups_many", """WITH categories AS (
  SELECT DISTINCT 'p' || l_partkey || CASE l_returnflag WHEN 'A' THEN '' ELSE '_' || l_returnflag END AS category FROM lineitem),
rules AS (
  SELECT 'prefix' AS kind, 'p' || p_partkey AS key, p_brand AS target FROM part
  UNION ALL SELECT 'exact', 'p' || p_partkey || '_R', p_type FROM part WHERE p_size > 25
  UNION ALL SELECT 'nosplit', 'p' || p_partkey || '_N', NULL FROM part WHERE p_size <= 10),
longest AS (
  SELECT category, arg_max(target, length(key)) AS target
  FROM (SELECT category, unnest(list_transform(range(1, length(category) + 1), lambda n: category[:n])) AS start FROM categories)
  JOIN rules ON kind = 'prefix' AND start = key GROUP BY category)
SELECT c.category, CASE WHEN n.key IS NOT NULL THEN c.category
  ELSE coalesce(e.target, l.target, split_part(c.category, '_', 1)) END AS group_category
FROM categories c LEFT JOIN rules n ON n.kind = 'nosplit' AND n.key = c.category
LEFT JOIN rules e ON e.kind = 'exact' AND e.key = c.category LEFT JOIN longest l USING (category)""")
def devinfo_groups_many(spark, sf_dir):
    """The group of every category of line items, by several rules a part."""
    parts, flag = read(spark, sf_dir, "part"), F.col("l_returnflag")
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    rules = parts.select(F.lit("prefix").alias("kind"), key.alias("key"), F.col("p_brand").alias("target")).unionByName(
        parts.filter("p_size > 25").select(F.lit("exact").alias("kind"), F.concat(key, F.lit("_R")).alias("key"), F.col("p_type").alias("target"))
    ).unionByName(parts.filter("p_size <= 10").select(
        F.lit("nosplit").alias("kind"), F.concat(key, F.lit("_N")).alias("key"), F.lit(None).cast("string").alias("target")))
    named = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.when(flag == "A", "").otherwise(F.concat(F.lit("_"), flag)))
    items = read(spark, sf_dir, "lineitem").select(named.alias("category")).distinct()
    return with_group_table(items, rules).select("category", "group_category")


@query("devinfo_categories", f"WITH {ATTRIBUTES} SELECT category, min(line_no) AS seen FROM attributes GROUP BY 1")
def devinfo_categories(spark, sf_dir):
    return list_categories(attributes(spark, sf_dir))


MAPPINGS = {
    "sw": {"name": {"label": "Switch", "desc": "its name", "format": "<%s>"},
           "active": {"bool_normalize": True, "enum": {"off": "down"}, "unit": "state"}},
    "sw_machinery": {"name": {"label": "never used"}, "balance": {"unit": "EUR", "format": "%12s|"}},
    "port0": {"secret": {"hide": True}, "active": {"bool_normalize": True}},
    "net": {"nation": {"label": "Country", "enum": {str(i): f"country {i}" for i in range(20)}}},
}

MAPPED = f"""WITH {ATTRIBUTES},
entities AS (SELECT category, id, coalesce(arg_min(agentid, line_no) FILTER (agentid <> ''), '') AS agentid,
    coalesce(arg_min(time, line_no) FILTER (time <> ''), '') AS time,
    coalesce(arg_min(extra, line_no) FILTER (extra <> ''), '') AS extra
  FROM attributes GROUP BY category, id),
fields AS (SELECT category, id, field_name, arg_min(field_value, line_no) AS raw_value, min(line_no) AS field_seen
  FROM attributes WHERE field_name <> '' GROUP BY ALL),
grouped AS (SELECT *, CASE WHEN starts_with(category, 'sw_') THEN 'sw' ELSE split_part(category, '_', 1) END AS g
  FROM fields JOIN entities USING (category, id)),
decoded AS (SELECT g AS group_category, category, id, field_name,
  CASE WHEN g = 'sw' AND field_name = 'name' THEN 'Switch' WHEN g = 'net' AND field_name = 'nation' THEN 'Country'
    ELSE field_name END AS field_label,
  CASE WHEN g = 'sw' AND field_name = 'name' THEN '<' || raw_value || '>'
    WHEN g = 'sw' AND field_name = 'active' THEN CASE raw_value WHEN 'OFF' THEN 'down state' ELSE 'true state' END
    WHEN category = 'sw_machinery' AND field_name = 'balance' THEN lpad(raw_value || ' EUR', 12, ' ') || '|'
    WHEN category = 'port0' AND field_name = 'active' AND raw_value = '1' THEN 'true'
    WHEN g = 'net' AND field_name = 'nation' AND CAST(raw_value AS INT) < 20 THEN 'country ' || raw_value
    ELSE raw_value END AS value,
  raw_value, time, agentid, extra, CASE WHEN g = 'sw' AND field_name = 'name' THEN 'its name' ELSE '' END AS "desc",
  field_seen
  FROM grouped WHERE NOT (category = 'port0' AND field_name = 'secret'))"""


def decoded(spark, sf_dir, **wanted):
    fields = devinfo_query(fold(folded_raw(spark, sf_dir)), **wanted)
    return apply_mappings(fields, field_mappings(spark, MAPPINGS))


@query("devinfo_mapped", MAPPED.replace("CAST(raw_value AS INT)", "TRY_CAST(raw_value AS INT)") + " SELECT * EXCLUDE (field_seen) FROM decoded")
def devinfo_mapped(spark, sf_dir):
    return decoded(spark, sf_dir).drop("seen", "field_seen")


@query("devinfo_mapped_file", MAPPED.replace("CAST(raw_value AS INT)", "TRY_CAST(raw_value AS INT)") + """
SELECT group_category, category, id, field_name, field_label, value, "desc" FROM decoded WHERE category = 'net_building' AND id = '7'
UNION ALL SELECT group_category, category, id, field_name, field_label, value, "desc" FROM decoded WHERE category = 'sw_machinery'
UNION ALL SELECT group_category, category, id, field_name, field_label, value, "desc" FROM decoded WHERE id = '3'""")
def devinfo_mapped_file(spark, sf_dir):
    """Mappings from a file, on the fields of one category, of one id, and of both."""
    fields, mappings = fold(folded_raw(spark, sf_dir)), field_mappings(spark, write_document(spark, MAPPINGS))
    chosen = [devinfo_query(fields, category="net_building", id="7"), devinfo_query(fields, category="sw_machinery"), devinfo_query(fields, id="3")]
    found = chosen[0].unionByName(chosen[1]).unionByName(chosen[2])
    return apply_mappings(found, mappings).select("group_category", "category", "id", "field_name", "field_label", "value", "desc")


@query("devinfo_query", MAPPED.replace("CAST(raw_value AS INT)", "TRY_CAST(raw_value AS INT)") + """
SELECT group_category, category, id, field_name, value, row_number() OVER (ORDER BY id, field_seen) AS pos
FROM decoded WHERE group_category = 'net' AND category <> '' AND contains(lower(raw_value), 'in')""")
def devinfo_sorted(spark, sf_dir):
    found = in_order(decoded(spark, sf_dir, group="net", search=" IN "), entity_order())
    return found.select("group_category", "category", "id", "field_name", "value", "pos")
