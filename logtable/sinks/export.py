"""CSV export of a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logtable.functions.text import cell
from logtable.operators.annotate import annotate
from logtable.operators.rows import LINE_NO, data_columns
from logtable.operators.view import LogView
from logtable.plans.ordered import ordered

# CSV as the reader of host logs expects it.
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def export_csv(
    view: LogView, annotations: DataFrame, path: str, fallback_all: bool = True
) -> None:
    """Write the rows of the view, in order, with all columns, mark and comment.

    An empty view writes every row in line order unless ``fallback_all`` is off.
    Part files follow each other in order, each with a header.
    """
    rows = view.rows()
    if fallback_all and rows.isEmpty():
        rows, keys = view.df, [(F.col(LINE_NO), False)]
    else:
        keys = view.keys(rows)
    columns = data_columns(view.df)
    ordered(annotate(rows, annotations), keys).select(
        *[cell(c).alias(c) for c in columns],
        F.col("mark").alias("Mark"), F.col("comment").alias("Comment"),
    ).write.options(**CSV_OPTIONS).csv(path)
