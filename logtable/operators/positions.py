"""Places in a view: pages, lines, and the next mark or hit.

Functions that take ``positions`` want a view numbered by
:func:`logtable.plans.ordered.in_order`; positions count from 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logtable.functions.text import row_text
from logtable.operators.filters import is_hit
from logtable.operators.rows import LINE_NO, ROW_ID, data_columns
from logtable.plans.ordered import Key, first_in_order, neighbours, ranked_between


# A page of so many rows, each two numbers, is broadcast to fetch its rows; a longer one is
# joined by a shuffle.
PAGE_ROWS = 100_000
# Up to so many first rows are selected without a sort of the others.
TOP_ROWS = 10_000


def fetched(df: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """The rows of ``df`` at ``places`` (``line_no``, ``pos``), of which there are ``size``."""
    few = F.broadcast(places) if size <= PAGE_ROWS else places
    return df.join(few, LINE_NO).select(*df.columns, "pos")


def page(df: DataFrame, keys: Sequence[Key], start: int, size: int) -> DataFrame:
    """The ``size`` rows from position ``start`` on.

    Only sort keys and line numbers are looked at: of a page that ends within the first
    ``TOP_ROWS`` rows those up to its end are selected, of a deeper one those in a bracket of
    its ranks. The page's rows, which are ``size`` of them, are then fetched by line number.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    narrow = df.select(LINE_NO, *[key.alias(name) for name, (key, _) in zip(names, keys)])
    order, end = [(F.col(name), down) for name, (_, down) in zip(names, keys)], start + size - 1
    placed = first_in_order(narrow, order, end) if 0 < end <= TOP_ROWS else ranked_between(narrow, order, start, end)
    wanted = placed.filter(F.col("pos").between(start, start + size - 1)).select(LINE_NO, "pos")
    return fetched(df, wanted, size)


def last(df: DataFrame, backwards: Sequence[Key], size: int) -> DataFrame:
    """The ``size`` last rows; ``backwards`` are the sort keys reversed."""
    total = df.count()
    return page(df, backwards, 1, size).withColumn("pos", F.lit(total) + 1 - F.col("pos"))


def row_at_line(rows: DataFrame, view: DataFrame, line_no: int) -> tuple[str, DataFrame]:
    """Look up a line: ``found``, ``not in current filter`` or ``out of bounds``."""
    at_line = F.col(LINE_NO) == line_no
    found = view.filter(at_line)
    if not found.isEmpty():
        return "found", found
    return "out of bounds" if rows.filter(at_line).isEmpty() else "not in current filter", found


def rows_at_lines(rows: DataFrame, view: DataFrame, wanted: DataFrame) -> DataFrame:
    """What :func:`row_at_line` says of each line of ``wanted``, by joins: ``line_no`` and ``status``."""
    line = wanted.select(LINE_NO).distinct()
    there = rows.join(line, LINE_NO, "left_semi").select(LINE_NO, F.lit(True).alias("_there"))
    shown = view.join(line, LINE_NO, "left_semi").select(LINE_NO, F.lit(True).alias("_shown"))
    status = F.when(F.col("_shown"), "found").when(F.col("_there"), "not in current filter").otherwise("out of bounds")
    return wanted.join(there, LINE_NO, "left").join(shown, LINE_NO, "left").select(LINE_NO, status.alias("status"))


def _flag_marked(positions: DataFrame, annotations: DataFrame) -> DataFrame:
    marked = annotations.filter(F.col("mark").isNotNull()).select(
        ROW_ID, F.lit(True).alias("_marked")
    )
    return positions.join(marked, ROW_ID, "left")


def _number(df: DataFrame, value: Column) -> int | None:
    return df.agg(value.alias("at")).first()["at"]


def next_marked(positions: DataFrame, annotations: DataFrame, pos: int) -> int | None:
    """The next marked position after ``pos``; it does not wrap."""
    after = positions.filter(F.col("pos") > pos)
    return _number(_flag_marked(after, annotations).filter("_marked"), F.min("pos"))


def prev_marked(positions: DataFrame, annotations: DataFrame, pos: int) -> int | None:
    """The last marked position before ``pos``; it does not wrap."""
    before = positions.filter(F.col("pos") < pos)
    return _number(_flag_marked(before, annotations).filter("_marked"), F.max("pos"))


def _flag_hits(positions: DataFrame, query: str, columns: Sequence[str] | None) -> DataFrame:
    text = row_text(columns or data_columns(positions))
    return positions.withColumn("_hit", F.when(is_hit(text, query), F.col("pos")))


def next_hit(
    positions: DataFrame, query: str, pos: int, columns: Sequence[str] | None = None
) -> int | None:
    """The next position whose row contains the query, going round past the end."""
    hits = _flag_hits(positions, query, columns)
    return _number(hits, F.coalesce(F.min(F.when(F.col("_hit") > pos, F.col("_hit"))), F.min("_hit")))


def prev_hit(
    positions: DataFrame, query: str, pos: int, columns: Sequence[str] | None = None
) -> int | None:
    """The previous position whose row contains the query, going round past the start."""
    hits = _flag_hits(positions, query, columns)
    return _number(hits, F.coalesce(F.max(F.when(F.col("_hit") < pos, F.col("_hit"))), F.max("_hit")))


def with_marked_neighbours(positions: DataFrame, annotations: DataFrame) -> DataFrame:
    """For every row the next and the previous marked position."""
    flagged = _flag_marked(positions, annotations)
    at = F.when(F.col("_marked"), F.col("pos"))
    return neighbours(flagged, "pos", at, "next_marked", "prev_marked").drop("_marked")


def with_hit_neighbours(
    positions: DataFrame, query: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """For every row the next and the previous hit, going round at the ends."""
    flagged = _flag_hits(positions, query, columns)
    ends = flagged.agg(F.min("_hit").alias("first"), F.max("_hit").alias("last")).first()
    both = neighbours(flagged, "pos", F.col("_hit"), "next_hit", "prev_hit")
    return both.withColumns({
        "next_hit": F.coalesce("next_hit", F.lit(ends["first"]).cast("bigint")),
        "prev_hit": F.coalesce("prev_hit", F.lit(ends["last"]).cast("bigint")),
    }).drop("_hit")


def position_of(positions: DataFrame, row_id: int) -> int | None:
    """Where a row identity stands first, else the first position."""
    at = F.min(F.when(F.col(ROW_ID) == row_id, F.col("pos")))
    return _number(positions, F.coalesce(at, F.min("pos")))


def first_positions(positions: DataFrame) -> DataFrame:
    """The first position of every row identity."""
    return positions.groupBy(ROW_ID).agg(F.min("pos").alias("pos"))


def view_counts(annotated: DataFrame) -> DataFrame:
    """One row: rows in the view, marked and commented rows, comment characters."""
    return annotated.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("mark") != "").alias("marked_rows"),
        F.count_if(F.col("comment") != "").alias("commented_rows"),
        F.coalesce(F.sum(F.char_length("comment")), F.lit(0)).alias("comment_chars"),
    )
