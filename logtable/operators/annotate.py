"""Review marks and comments, kept by row identity.

Annotations are a table ``(row_id BIGINT, mark STRING, comment STRING)`` with
one row per identity; NULL means no mark or no comment. Joins carry no size
hint: Catalyst broadcasts annotations that are small, and otherwise joins by
shuffle, where adaptive execution splits an identity shared by very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logtable.operators.rows import ROW_ID

SCHEMA = "row_id BIGINT, mark STRING, comment STRING"

# The mark colours.
COLOURS = ("red", "green", "amber")


def clean_mark(mark: Column) -> Column:
    """An unknown colour is no mark."""
    return F.when(mark.isin(*COLOURS), mark)


def clean_marks(annotations: DataFrame) -> DataFrame:
    """Drop unknown colours, empty comments and entries that hold neither."""
    return _kept(annotations.select(
        ROW_ID, clean_mark(F.col("mark")).alias("mark"),
        F.nullif(F.col("comment"), F.lit("")).alias("comment"),
    ))


def _kept(annotations: DataFrame) -> DataFrame:
    return annotations.filter(F.col("mark").isNotNull() | F.col("comment").isNotNull())


def annotate(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """Each row with its mark and comment, '' where there is none."""
    found = annotations.select(ROW_ID, "mark", "comment")
    joined = df.join(found, ROW_ID, "left")
    return joined.select(
        *df.columns,
        F.coalesce("mark", F.lit("")).alias("mark"),
        F.coalesce("comment", F.lit("")).alias("comment"),
    )


def merge_annotations(annotations: DataFrame, incoming: DataFrame, df: DataFrame) -> DataFrame:
    """Lay ``incoming`` over ``annotations``, field by field, for rows of ``df`` only.

    The rows are reduced to the identities that ``incoming`` asks for before
    anything else happens to them.
    """
    incoming = clean_marks(incoming)
    present = df.select(ROW_ID).join(incoming.select(ROW_ID), ROW_ID, "left_semi").distinct()
    new = incoming.join(present, ROW_ID, "left_semi").select(
        ROW_ID, F.col("mark").alias("new_mark"), F.col("comment").alias("new_comment")
    )
    return annotations.join(new, ROW_ID, "full").select(
        ROW_ID,
        F.coalesce("new_mark", "mark").alias("mark"),
        F.coalesce("new_comment", "comment").alias("comment"),
    )


def _set(annotations: DataFrame, rows: DataFrame, field: str, value: str | None) -> DataFrame:
    chosen = rows.select(ROW_ID).distinct().withColumn("_chosen", F.lit(True))
    new = F.when(F.col("_chosen"), F.lit(value).cast("string")).otherwise(F.col(field))
    return _kept(annotations.join(chosen, ROW_ID, "full").select(
        ROW_ID, *[(new if c == field else F.col(c)).alias(c) for c in ("mark", "comment")]
    ))


def set_mark(annotations: DataFrame, rows: DataFrame, colour: str | None) -> DataFrame:
    """Mark the identities of ``rows``; no colour clears them."""
    if colour and colour not in COLOURS:
        raise ValueError(f"unknown colour {colour!r}")
    return _set(annotations, rows, "mark", colour or None)


def set_comment(annotations: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Comment on the identities of ``rows``; '' removes the comment."""
    return _set(annotations, rows, "comment", text or None)
