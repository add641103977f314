"""Host logs: CSV with a header row, quoted cells and line breaks inside cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from logtable.functions.text import BOM
from logtable.operators.rows import LINE_NO, with_roles
from logtable.plans.ordered import (
    BROADCAST_ROWS, number_placed, place_scan, running_last, running_sum,
)
from logtable.plans.staging import stage
from logtable.sources.lines import scan_lines

# One field behind its comma: quoted with doubled quotes inside, or plain.
FIELD = r',("(?:[^"]++|"")*+"|[^",]*+)'


def _odd_quotes(text: Column) -> Column:
    """1 if a line opens or closes a quoted cell that runs over its end, else 0."""
    quotes = F.char_length(text) - F.char_length(F.replace(text, F.lit('"'), F.lit("")))
    return F.pmod(quotes, F.lit(2))


def csv_records(lines: DataFrame) -> DataFrame:
    """Join the lines of each record: ``(line_no of its first line, file, record)``.

    A record starts where the number of quotes before it, in its file, is even. Blank
    lines between records are dropped. A file that ends inside a quoted cell is refused
    before any of its lines are joined.
    """
    flagged = lines.withColumn("_odd", _odd_quotes(F.col("value")))
    counted = running_sum(flagged, LINE_NO, F.col("_odd"), "_quotes")
    files = stage(counted.groupBy("file").agg(
        F.min(F.col("_quotes") - F.col("_odd")).alias("_before"), F.sum("_odd").alias("_all")))
    open_ended = files.filter("_all % 2 = 1").select(F.min("file")).first()[0]
    if open_ended is not None:
        raise ValueError(f"CSV file {open_ended} ends inside a quoted cell")
    counted = counted.join(files.select("file", "_before"), "file")
    opens = F.pmod(F.col("_quotes") - F.col("_odd") - F.col("_before"), F.lit(2)) == 0
    placed = running_last(counted, LINE_NO, F.when(opens, F.col(LINE_NO)), "_record")
    joined = placed.groupBy("_record", "file").agg(
        F.sort_array(F.collect_list(F.struct(LINE_NO, "value"))).alias("_lines")
    )
    return joined.select(
        F.col("_record").alias(LINE_NO), "file", F.array_join("_lines.value", "\n").alias("record")
    ).filter(F.col("record") != "")


def _fields(record: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r"\G" + FIELD), F.lit(1))


def _unquoted(field: Column) -> Column:
    inner = F.substring(field, F.lit(2), F.char_length(field) - 2)
    return F.when(field.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)


def parse_csv(records: DataFrame, columns: list[str]) -> DataFrame:
    """Split records into cells. A malformed record, or one with another number of
    fields than the header, fails the job whichever columns are read."""
    # The output of a generator is worked out once, not again for every column.
    split = records.withColumn("_fields", F.explode(F.array(_fields(F.col("record")))))
    taken = F.aggregate("_fields", F.lit(0), lambda total, f: total + F.char_length(f) + 1)
    whole = (taken == F.char_length("record") + 1) & (F.size("_fields") == len(columns))
    complaint = F.concat(F.lit("malformed CSV record at line "), F.col(LINE_NO).cast("string"), F.lit(" of the rows, in "), "file")
    checked = split.filter(
        F.when(whole, True).otherwise(F.raise_error(complaint).cast("boolean"))
    )
    cells = [_unquoted(F.get("_fields", F.lit(i))).alias(c) for i, c in enumerate(columns)]
    return checked.select(LINE_NO, *cells)


def _header(records: DataFrame, path: str) -> list[str]:
    """The column names, which the first records of all files must agree on."""
    heads = records.groupBy("file").agg(F.min_by("record", LINE_NO).alias("record")).select(
        _fields(F.regexp_replace("record", f"^{BOM}", "")).alias("f")).distinct().limit(2).collect()
    if not heads:
        raise ValueError(f"CSV {path!r} has no rows")
    if len(heads) > 1:
        raise ValueError(f"CSV {path!r}: files differ in their header: {heads[0]['f']} and {heads[1]['f']}")
    return [name[1:-1].replace('""', '"') if name.startswith('"') else name for name in heads[0]["f"]]


def read_host_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read CSV files as a log table of strings, large files in parallel.

    Column names come from the first record; the first record of every further
    file is its header too. Line numbers count the records after the headers.
    If no cell runs over the end of its line, which the first scan tells, lines
    are records and need no shuffle.
    """
    if not str(path).lower().rstrip("/*").endswith(".csv"):
        raise ValueError(f"unsupported file {path!r} (want .csv; sessions: read_session)")
    seen = Observation()
    value = F.regexp_replace("value", r"\r\z", "")
    placed = place_scan(scan_lines(spark, path, sep="\n").withColumn("value", value).observe(
        seen, F.count_if((F.col("value") == "") | (_odd_quotes(F.col("value")) == 1)).alias("joined")
    ))
    if seen.get["joined"] == 0:
        names = _header(number_placed(placed).withColumnRenamed("value", "record"), path)
        records = number_placed(placed, skip_first=True).withColumnRenamed("value", "record")
    else:
        every = stage(csv_records(number_placed(placed)))
        names = _header(every, path)
        headers = stage(every.groupBy("file").agg(F.min(LINE_NO).alias(LINE_NO)).select(LINE_NO))
        few = headers.count() <= BROADCAST_ROWS
        body = every.join(F.broadcast(headers) if few else headers, LINE_NO, "left_anti")
        counted = running_sum(body, LINE_NO, F.lit(1), "_ordinal")
        records = counted.select(F.col("_ordinal").alias(LINE_NO), "file", "record")
    return with_roles(parse_csv(records, names), "host")
