"""Plugin logs: records of one or more lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logtable.functions.text import gtrim
from logtable.operators.rows import LINE_NO, with_roles
from logtable.plans.ordered import running
from logtable.sources.lines import read_lines

COLUMNS = ("process", "pid", "epoch", "time", "level", "module", "function", "line", "message")

# The record format.
HEAD = r"^(sw(?:-(?:[1-9]|1[0-9]|20))?):([0-9]+):([0-9]+(?:\.[0-9]+)?):"
LOCAL_TIME = (
    r"^([A-Z][a-z]{2} [A-Z][a-z]{2}[\t\n\f\r ]+[0-9]{1,2} "
    r"[0-9]{2}:[0-9]{2}:[0-9]{2} [0-9]{4}):[\t\n\f\r ]*"
)
LEVEL = r"^([A-Za-z]+):[\t\n\f\r ]+"
PLACE = r"^([^:\n]+)::([^:\n]+):([0-9]+):[\t\n\f\r ]*"
CLOCK_TIME = (
    r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) +([A-Z][a-z]{2}) +([0-9]{1,2}) "
    r"((?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]) ([0-9]{4})\z"
)


def plugin_records(lines: DataFrame) -> DataFrame:
    """Join the lines of each record: ``(line_no, record)``, records numbered from 1.

    Lines before the first record of a file are dropped, before anything is put together. A
    record is one cell of the result, so its lines come together; no other group is collected.
    A line carries a 64-bit hash of its file's path, which is mostly longer than the line: only
    files with records one after the other are ever compared.
    """
    file = F.xxhash64("file") if "file" in lines.columns else F.lit(0)
    starts = F.col("value").rlike(HEAD)
    numbered = running(
        lines.select(LINE_NO, "value", file.alias("file"), starts.alias("_starts")), LINE_NO,
        {"_record": F.col("_starts").cast("int")}, {"_file": F.when(F.col("_starts"), F.col("file"))})
    grouped = numbered.filter(F.col("_file") == F.col("file")).groupBy("_record").agg(
        F.sort_array(F.collect_list(F.struct(LINE_NO, "value"))).alias("_lines"))
    text = F.array_join("_lines.value", "\n")
    return grouped.select(
        F.col("_record").cast("bigint").alias(LINE_NO), F.btrim(text, F.lit("\n")).alias("record")
    )


def table_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; a time that does not exist stays as it is."""
    part = [F.regexp_extract(text, CLOCK_TIME, i) for i in range(5)]
    day = F.when(
        text.rlike(CLOCK_TIME),
        F.try_to_date(F.concat_ws(" ", part[4], part[1], part[2]), "yyyy MMM d"),
    )
    found = F.when(day.isNotNull(), F.concat_ws(" ", day.cast("string"), part[3]))
    return F.coalesce(found, text)


MARK = "\x01"


def _taken(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern at the start of a text and the rest behind it, by one match:
    an array, empty but for the text if there is no match."""
    marked = F.regexp_replace(text, pattern, "".join(f"${i + 1}{MARK}" for i in range(groups)))
    none = F.array(*[F.lit("")] * groups, text)
    each = [F.regexp_extract(text, pattern, i + 1) for i in range(groups)]
    return (
        F.when(F.contains(text, F.lit(MARK)), F.array(*each, F.regexp_replace(text, pattern, "")))
        .when(marked == text, none).otherwise(F.split(marked, MARK, groups + 1))
    )


def parse_plugin(lines: DataFrame) -> DataFrame:
    """Numbered lines to the nine columns of a plugin log."""
    found, kept = F.col("found"), [LINE_NO, *COLUMNS[:3]]
    head = plugin_records(lines).select(LINE_NO, _taken(F.col("record"), HEAD, 3).alias("found"))
    head = head.select(LINE_NO, *[found[i].alias(c) for i, c in enumerate(COLUMNS[:3])], gtrim(found[3]).alias("rest"))
    timed = head.select(*kept, _taken(F.col("rest"), LOCAL_TIME, 1).alias("found"))
    timed = timed.select(*kept, table_time(found[0]).alias("time"), gtrim(found[1]).alias("rest"))
    levelled = timed.select(*kept, "time", _taken(F.col("rest"), LEVEL, 1).alias("found"))
    levelled = levelled.select(*kept, "time", found[0].alias("first_level"), gtrim(found[1]).alias("rest"))
    placed = levelled.select(*kept, "time", "first_level", _taken(F.col("rest"), PLACE, 3).alias("found"))
    # A place without a level before it may have one behind it.
    placed = placed.select(
        *kept, "time", "first_level", *[gtrim(found[i]).alias(c) for i, c in enumerate(COLUMNS[5:8])],
        gtrim(found[3]).alias("rest"), ((F.col("first_level") == "") & (found[2] != "")).alias("late"),
    )
    late, first = F.col("late"), F.array("first_level", "rest")
    told = placed.select(
        *kept, "time", *COLUMNS[5:8], F.when(late, _taken(F.col("rest"), LEVEL, 1)).otherwise(first).alias("found"), "late")
    parsed = told.select(
        *kept, "time", found[0].alias("level"), *COLUMNS[5:8],
        F.when(late, gtrim(found[1])).otherwise(found[1]).alias("message"))
    return with_roles(parsed, "plugin")


def read_plugin_log(spark: SparkSession, path: str, require_rows: bool = True) -> DataFrame:
    """Read plugin log files; CR LF and CR count as line ends."""
    lines = read_lines(spark, path)
    if require_rows and lines.filter(F.col("value").rlike(HEAD)).isEmpty():
        raise ValueError("no plugin log records found")
    return parse_plugin(lines)
