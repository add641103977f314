"""Daily statistics logs: one reading per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from logtable.functions.text import gtrim, parse_int
from logtable.functions.times import epoch_to_date
from logtable.operators.rows import LINE_NO, with_roles
from logtable.plans.ordered import number_placed, place_scan
from logtable.sources.lines import scan_lines

COLUMNS = ("date", "timestamp", "pid", "process", "key", "value")
MIN_FIELDS = 6


def _fields(value: Column) -> Column:
    return F.split(gtrim(value), r"(?U)\s+")


def parse_stats(lines: DataFrame, mode: str = "FAILFAST", zone: str = "UTC") -> DataFrame:
    """Numbered lines to the six columns of a statistics log.

    Lines with fewer than six fields are left out. A time or process id that is
    no number fails the job, or drops the line with ``mode='DROP'``.
    """
    # As the output of a generator the fields are split once per line; as a plain
    # expression they would be split again in the filters and for every column.
    once = F.explode(F.array(_fields(F.col("value"))))
    split = lines.select(LINE_NO, once.alias("f")).filter(F.size("f") >= MIN_FIELDS)
    typed = split.select(
        LINE_NO, "f", parse_int(F.col("f")[1]).alias("at"), parse_int(F.col("f")[3]).alias("id")
    )
    valid = F.col("at").isNotNull() & F.col("id").isNotNull()
    if mode == "FAILFAST":
        complaint = F.concat(F.lit("bad time or process id at line "), F.col(LINE_NO).cast("string"))
        valid = F.when(valid, True).otherwise(F.raise_error(complaint).cast("boolean"))
    rows = typed.filter(valid).select(
        LINE_NO,
        epoch_to_date(F.col("at"), zone).alias("date"),
        F.col("at").cast("string").alias("timestamp"),
        F.col("id").cast("string").alias("pid"),
        F.col("f")[2].alias("process"),
        F.col("f")[4].alias("key"),
        F.array_join(F.slice("f", MIN_FIELDS, F.size("f")), " ").alias("value"),
    )
    return with_roles(rows, "stats")


def read_stats_log(
    spark: SparkSession, path: str, mode: str = "FAILFAST", zone: str = "UTC",
    skipped: Observation | None = None,
) -> DataFrame:
    """Read statistics logs; rows are numbered without the lines that are skipped.

    ``skipped`` receives the number of short lines as ``skipped``.
    """
    lines = scan_lines(spark, path, sep="\n")
    fields = F.size(_fields(F.col("value")))
    if skipped is not None:
        short = (fields < MIN_FIELDS) & (gtrim("value") != "")
        lines = lines.observe(skipped, F.count_if(short).alias("skipped"))
    placed = place_scan(lines.filter(fields >= MIN_FIELDS))
    return parse_stats(number_placed(placed), mode, zone)
