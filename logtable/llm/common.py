"""What several operators share: white space, words, hashes, running totals."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logtable.session import configure

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def whole(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until it is none of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def total_before(blocks: DataFrame, group: list[str], order: str, size: str, out: str, fan: int = 4096) -> DataFrame:
    """The sum of ``size`` over earlier blocks of the same group.

    ``blocks`` has one row per (group, order), ``order`` counting from 0. Sums go over
    runs of ``fan`` blocks first, so that no window sees more than the blocks of one run
    or the runs of one group.
    """
    runs = blocks.withColumn("_run", F.expr(f"`{order}` div {fan}"))
    sums = runs.groupBy(*group, "_run").agg(F.sum(size).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_run").alias("_r"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"),
    )
    inside = Window.partitionBy(*group, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_run") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return (
        runs.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(sums, same)
        .withColumn(out, F.col("_base") + F.col("_inside"))
        .drop("_run", "_r", "_base", "_inside", *[f"_g{i}" for i in range(len(group))])
    )
