"""One query for each operator, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtable.llm.ann import nearest
from logtable.llm.chat import format_chats, read_chats
from logtable.llm.clustering import clustered, with_inertia
from logtable.llm.common import read_table
from logtable.llm.exact_dedup import exact_groups
from logtable.llm.line_dedup import drop_frequent_lines
from logtable.llm.mixing import mix_sources
from logtable.llm.near_dedup import near_duplicates
from logtable.llm.packing import pack, token_pieces
from logtable.llm.repair import repair
from logtable.llm.substring_dedup import remove_repeats
from logtable.llm.token_files import fresh_folder, read_ids, write_ids
from logtable.llm.toxicity import learn, score_texts
from logtable.llm.url_filter import filter_urls

URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
CONTROL_TEXT = r"\### Assistant: </turn> ok"
BLOCK_WORDS = 64
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and offset of every piece of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(token_pieces(docs, tokenizer_path()))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score_texts(docs, learn(docs, labels))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near-duplicates that every document belongs to."""
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of every page's URL."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without passages that smaller documents have."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the lines found in ten documents or more."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs, min_docs=10).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of all sources takes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, block_words=BLOCK_WORDS).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    chats = read_chats(format_chats(turns.unionByName(control)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts that every document belongs to."""
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of all documents' token ids hold, read back from them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_folder(spark)
    write_ids(docs, path, tokenizer_path())
    return read_ids(spark, path, with_ids=False).drop("ids")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversation rows with one in twenty each dropped, emptied, cut short, repeated or set to user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    return (
        turns.withColumn("fate", fate).filter("fate != 0")
        .withColumns({
            "text": F.when(F.col("fate") == 1, "").when(
                F.col("fate") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text")),
            "role": F.when(F.col("fate") == 4, "user").otherwise(blank("role")),
            "copy": F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))})
        .select("conv_id", "turn", "role", "text"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = repair(damaged(turns))
    digests = repaired.turns.filter("digest IS NOT NULL").select(F.col("conv_id").alias("of_digest"), "digest")
    found = repaired.conversations.withColumnRenamed("conv_id", "of")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (
        turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
        .join(digests, F.col("conv_id").eqNullSafe(F.col("of_digest")), "left")
        .select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector, with the distances within its cluster and in all."""
    return with_inertia(*clustered(read_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_ann": op2_ann,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_chat_format": op9_chat_format,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_files": op11_token_files,
    "op12_repair": op12_repair,
    "op13_clustering": op13_clustering,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, a component a row."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, min(d * 64 + num) % 64 AS num, min(d * 64 + num) // 64 AS distance FROM (
    SELECT x.rid, c.num, CAST(sum((x.val - c.val) * (x.val - c.val)) AS BIGINT) AS d
    FROM parts x JOIN c{i} c USING (dim) GROUP BY ALL) GROUP BY rid)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.num, c.dim, coalesce(m.val, c.val) AS val FROM c{i} c LEFT JOIN (
    SELECT num, dim, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS val FROM (
      SELECT a.num, x.dim, CAST(sum(x.val) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN parts x USING (rid) GROUP BY ALL)
    ) m ON m.num = c.num AND m.dim = c.dim)""")
    return f"""
WITH ints AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64),
parts AS MATERIALIZED (SELECT rid, unnest(range(64)) AS dim, unnest(v) AS val FROM ints),
chosen AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS num FROM ints),
c0 AS MATERIALIZED (SELECT num, dim, val FROM chosen JOIN parts USING (rid) WHERE num < {k}),
{", ".join(steps)},
digests AS (SELECT num, sha256(string_agg(val, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY num)
SELECT vec_id, CAST(num AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY num) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN ints USING (rid) JOIN digests USING (num)"""


SQL = {
    "op4_near_dedup": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS uid, len(any_value(s)) AS n FROM shingled WHERE len(s) > 0 GROUP BY 1),
sets AS (SELECT uid, n, unnest(s) AS shingle FROM classes),
common AS (
  SELECT x.uid AS a, y.uid AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
  FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.uid != y.uid GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
reached(node, other) AS (
  SELECT uid, uid FROM classes UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
smallest AS (SELECT node, min(other) AS component FROM reached GROUP BY node)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id,
  d.doc_id = coalesce(m.component, d.doc_id) AS kept
FROM shingled d LEFT JOIN classes c ON len(d.s) > 0 AND list_sort(d.s) = c.s LEFT JOIN smallest m ON m.node = c.uid""",
    "op5_url_filter": f"""
WITH tails AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), {_AZ}) AS host,
    regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
  FROM tails),
rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
fits AS (
  SELECT p.page_id, arg_max(r.host || r.path, (length(r.host || r.path), length(r.host), r.verdict)) AS rule,
    arg_max(r.verdict, (length(r.host || r.path), length(r.host), r.verdict)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f USING (page_id)""",
    "op6_substring_dedup": """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50),
windows AS (SELECT doc_id, s, hash(w[s:s + 49]) AS h, md5(array_to_string(w[s:s + 49], ' ')) AS m FROM starts),
firsts AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h, m) AS first FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos FROM firsts WHERE first < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
kept AS (
  SELECT p.doc_id, count(g.pos) AS n_removed,
    sha256(coalesce(string_agg(p.word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
  coalesce(k.kept_sha256, sha256('')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)""",
    "op7_line_dedup": f"""
WITH pieces AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM pieces),
keyed AS (SELECT *, translate(trim(line, {_SPACES}), {_AZ}) AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op8_mixing": f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM sums),
ratios AS (SELECT *, 3 * source_size / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM ratios
  WINDOW earlier AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS common FROM levels),
targets AS (
  SELECT source, source_size,
    CASE WHEN common IS NULL OR ratio < common THEN source_size * 3.0::DOUBLE ELSE weight * common END AS target
  FROM common),
cut AS (
  SELECT *, CASE WHEN source_size = 0 THEN {BLOCK_WORDS} ELSE CAST(ceil(source_size / ceil(source_size / {BLOCK_WORDS})) AS BIGINT) END AS length
  FROM targets),
needed AS (
  SELECT *, (source_size + length - 1) // length AS blocks,
    least(CAST(floor(target * ((source_size + length - 1) // length) / greatest(source_size, 1) + 0.5) AS BIGINT),
      3 * ((source_size + length - 1) // length)) AS slots
  FROM cut),
streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized WHERE size > 0),
pieces AS (
  SELECT t.*, n.length, n.blocks, n.slots,
    unnest(range(CAST(t.start // n.length AS BIGINT), CAST((t.start + t.size - 1) // n.length AS BIGINT) + 1)) AS pos
  FROM streams t JOIN needed n ON t.source IS NOT DISTINCT FROM n.source),
taken AS (
  SELECT doc_id, source, start, size, CAST(sum((slots // blocks + CASE WHEN pos < slots % blocks THEN 1 ELSE 0 END)
    * (least(start + size, (pos + 1) * length) - greatest(start, pos * length))) AS BIGINT) AS taken
  FROM pieces GROUP BY ALL)
SELECT d.doc_id, d.size, t.source_size, t.target, d.taken
FROM (SELECT doc_id, source, size, taken FROM taken
  UNION ALL SELECT doc_id, source, size, 0 FROM sized WHERE size = 0) d
JOIN targets t ON d.source IS NOT DISTINCT FROM t.source""",
    "op9_chat_format": f"""
WITH every AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}')),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM every),
told AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS previous,
    4 + 2 + length(role) + length(regexp_replace(role, '[^\\\\#<:\\n]', '', 'g')) AS opening,
    length(text) + length(regexp_replace(text, '[^\\\\#<]', '', 'g')) AS body
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(8 + sum(body + CASE WHEN previous IS NULL THEN opening WHEN previous = role THEN 7 ELSE 8 + opening END) AS BIGINT)
    AS formatted_chars
FROM told GROUP BY conv_id""",
    "op10_exact_dedup": """
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
groups AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM texts t JOIN groups g USING (norm)""",
    "op12_repair": f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) AS v
    FROM range(256) r(i))),
fated AS (
  SELECT c.*, xor(list_reduce(
      list_prepend(4294967295, list_transform(
        string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM conversations c, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    trim(text, {_SPACES}) AS trimmed
  FROM damaged),
turns AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    i > 1 AND left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
follows(old, initial, new) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(old, new, n, said) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
    (0, 2, 1, 'user:' || chr(10)), (1, 2, 1, 'user:' || chr(10)), (3, 2, 1, 'user:' || chr(10)),
    (2, 3, 1, 'assistant:' || chr(10)), (2, 2, 2, 'assistant:' || chr(10) || 'user:' || chr(10)),
    (0, 3, 2, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 2, 'user:' || chr(10) || 'assistant:' || chr(10)),
    (3, 3, 2, 'user:' || chr(10) || 'assistant:' || chr(10))),
rows_as AS (
  SELECT conv_id, i, f.old, f.new, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS cost, 'K' AS edit, role || ':' || text || chr(10) AS said
  FROM turns JOIN follows f ON left(role, 1) = f.initial WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, i, f.old, f.new, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R',
    CASE f.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10)
  FROM turns JOIN follows f ON f.initial IN ('u', 'a') WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, s.old, s.old, 4, 'D', '' FROM turns, range(4) s(old)),
paths AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'said': ''}} AS best FROM turns
  UNION ALL
  SELECT p.conv_id, r.i, r.new, min({{'cost': CAST(p.best.cost + 3 * x.n + r.cost AS BIGINT),
    'audit': p.best.audit || repeat('I', x.n) || r.edit, 'said': p.best.said || x.said || r.said}})
  FROM paths p JOIN inserts x ON x.old = p.state
    JOIN rows_as r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 AND r.old = x.new
  GROUP BY p.conv_id, r.i, r.new),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM turns GROUP BY conv_id),
ended AS (
  SELECT c.conv_id, min({{'cost': CAST(p.best.cost + 3 * x.n AS BIGINT), 'audit': p.best.audit || repeat('I', x.n),
    'said': p.best.said || x.said}}) AS best
  FROM counted c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n
    JOIN inserts x ON x.old = p.state AND (x.new = 3 OR (x.new = 0 AND x.n = 0))
  GROUP BY c.conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost,
  coalesce(e.best.audit, '') AS audit, sha256(regexp_replace(coalesce(e.best.said, ''), '\\n\\z', '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op13_clustering": _clustering_sql(),
}
