"""The given tables as log tables, and the same in SQL.

``event_id`` is the source order of events, ``o_orderkey`` that of orders, and
so on; line numbers count from 1.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtable.plans.staging import staging_root
from logtable.session import configure

EVENT_CELLS = ["event", "time", "account", "kind", "value", "props"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of text cells, with line number and time."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"),
        F.col("user_id").cast("string").alias("account"),
        F.col("event_type").alias("kind"),
        F.col("value").cast("string").alias("value"),
        "props",
        (F.col("event_id") + 1).alias("line_no"),
        F.col("ts").alias("ts_parsed"),
    )


EVENT_LOG = """log AS (
  SELECT event_id + 1 AS line_no, CAST(event_id AS VARCHAR) AS event,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time, CAST(user_id AS VARCHAR) AS account,
    event_type AS kind, CAST(value AS VARCHAR) AS value, props, ts
  FROM events)"""

EVENT_TEXT = 'concat_ws(chr(9), event, time, "account", kind, value, props)'


def fnv_sql(*cells: str) -> str:
    """FNV-1a 64 of ASCII cells, as BIGINT."""
    parts = ", ".join(
        f"list_transform(string_split(lower(trim({c})), ''), lambda c: ascii(c)), [0]" for c in cells
    )
    return (
        "(SELECT CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT"
        " ELSE h END AS BIGINT) FROM (SELECT list_reduce(CAST(flatten([" + parts + "]) AS HUGEINT[]),"
        " lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616,"
        " 14695981039346656037::HUGEINT) AS h))"
    )


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("text", (F.col("doc_id") + 1).alias("line_no"))


def marks(log: DataFrame, where) -> DataFrame:
    """Annotations by rule: one per identity, red, amber or green by its user."""
    number = F.col("account").cast("int")
    return log.filter(where).groupBy("row_id").agg(F.min(number).alias("n")).select(
        "row_id",
        F.when(F.col("n") % 4 == 0, "red").when(F.col("n") % 4 == 1, "amber")
        .when(F.col("n") % 4 == 2, "green").alias("mark"),
        F.when(F.col("n") % 3 == 0, F.concat(F.lit("see user "), F.col("n").cast("string")))
        .alias("comment"),
    ).filter("mark IS NOT NULL OR comment IS NOT NULL")


# Identity over user and kind: many events share one.
def shared_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logtable.operators.rows import with_row_id

    return with_row_id(event_log(spark, sf_dir), ["account", "kind"])


def marks_sql(name: str, where: str) -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT "account", kind,
      CASE n % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'amber' WHEN 2 THEN 'green' END AS mark,
      CASE WHEN n % 3 = 0 THEN 'see user ' || CAST(n AS VARCHAR) END AS comment
    FROM (SELECT DISTINCT "account", kind, CAST(account AS INT) AS n FROM log WHERE {where}))
  WHERE mark IS NOT NULL OR comment IS NOT NULL)"""


def write_lines(lines: DataFrame) -> str:
    """Write ``(line_no, value)`` as text files in order; returns their folder."""
    path = f"{staging_root(lines.sparkSession)}/{uuid.uuid4().hex}"
    lines.orderBy("line_no").select("value").write.text(path)
    return path


def write_document(spark: SparkSession, content: dict) -> str:
    """Write a configuration as a JSON file; returns its path."""
    path = fresh_path(spark, ".json")
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(path)
    return path


def fresh_path(spark: SparkSession, suffix: str = "") -> str:
    return f"{staging_root(spark)}/{uuid.uuid4().hex}{suffix}"
