"""Sorting a column by what its values turn out to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logtable.functions.text import cell, gfold, gtrim, parse_int, parse_number
from logtable.functions.times import parse_log_ts
from logtable.operators.rows import LINE_NO
from logtable.plans.ordered import Key, ordered


def column_kind(df: DataFrame, column: str) -> str:
    """``number``, ``time``, ``text`` or ``mixed``, from one pass over the column.

    Blanks do not count. A column is of one kind only if every value is.
    """
    value = gtrim(cell(column))
    filled = value != ""
    number = parse_number(column).isNotNull()
    time = F.when(number, parse_int(value).isNotNull()).otherwise(parse_log_ts(column).isNotNull())
    row = df.select(filled.alias("filled"), number.alias("number"), time.alias("time")).agg(
        F.count_if(F.expr("filled AND NOT number")).alias("not_number"),
        F.count_if(F.expr("filled AND NOT time")).alias("not_time"),
        F.count_if(F.expr("filled AND (number OR time)")).alias("typed"),
    ).first()
    if row["not_number"] == 0:
        return "number"
    if row["not_time"] == 0:
        return "time"
    return "mixed" if row["typed"] else "text"


def sort_keys(column: str, kind: str) -> list[Column]:
    """Ascending keys. Blanks come first; equal numbers and equal times tie."""
    value = gtrim(cell(column))
    number, time = parse_number(column), parse_log_ts(column)
    blank = F.when(value == "", 0)
    if kind == "number":
        return [blank.otherwise(1), number]
    if kind == "time":
        return [blank.otherwise(1), time]
    if kind == "text":
        return [gfold(value), value]
    rank = blank.when(number.isNotNull(), 1).when(time.isNotNull(), 2).otherwise(3)
    as_text = F.when(number.isNull() & time.isNull(), value)
    return [rank, number, F.when(number.isNull(), time), gfold(as_text), as_text]


def ordering(
    df: DataFrame,
    by: str | None,
    desc: bool = False,
    kind: str | None = None,
    backwards: bool = False,
) -> list[Key]:
    """Sort keys for a resolved column. Ties keep line order in both directions.

    ``backwards`` reverses the whole order, ties included.
    """
    line = F.col(LINE_NO)
    if by is None or by == "#":
        keys, desc, line_desc = [], False, by is not None and desc
    else:
        keys, line_desc = sort_keys(by, kind or column_kind(df, by)), False
    return [(k, desc != backwards) for k in keys] + [(line, line_desc != backwards)]


def sort_rows(
    df: DataFrame, by: str | None, desc: bool = False, kind: str | None = None
) -> DataFrame:
    """Stable typed sort; pass ``kind`` when it is known to save the look at the data."""
    return ordered(df, ordering(df, by, desc, kind))
