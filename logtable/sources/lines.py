"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtable.plans.ordered import number_placed, place_scan


def scan_lines(spark: SparkSession, path: str | list[str], sep: str | None = None) -> DataFrame:
    """Lines as they are scanned: splittable, with what is needed to put them in order.

    Tasks may read splits of several files in any order, so a line is placed by
    the file and the split's start in it.
    """
    options = {} if sep is None else {"lineSep": sep}
    return spark.read.options(**options).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def read_lines(spark: SparkSession, path: str | list[str], sep: str | None = None) -> DataFrame:
    """``(file, value, line_no)``; lines count from 1 through all files in path order.

    The lines are written once as Parquet, so that every later pass sees the
    same numbers even if executors come and go between the passes.
    """
    return number_placed(place_scan(scan_lines(spark, path, sep)))
