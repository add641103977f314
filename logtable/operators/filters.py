"""Row filters and text search."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType

from logtable.functions.patterns import InvalidPattern, needed_text, repeats_group, to_java, to_re2
from logtable.functions.text import WHITE_SPACE, cell, gfold, quoted, row_text
from logtable.operators.rows import LINE_NO, ROW_ID, TS, data_columns


def regex_match(text: Column, pattern: str) -> Column:
    """Whether an RE2 pattern matches anywhere in ``text``.

    Patterns that repeat no group run in the JVM, as Java patterns. The others could exhaust
    its stack on a long cell: they run in RE2, over whole Arrow batches, in linear time. Rows
    without a text that every match holds are not sent there.
    """
    java, needed = to_java(pattern), needed_text(pattern)
    may_match = F.contains(text, F.lit(needed)) if needed else F.lit(True)
    if repeats_group(pattern):
        return F.when(text.isNotNull(), F.coalesce(re2_match(pattern)(F.when(may_match, text)), F.lit(False)))
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except IllegalArgumentException as error:
        raise InvalidPattern(f"{pattern!r}: {error}") from None
    return may_match & text.rlike(java) if needed else text.rlike(java)


def re2_match(pattern: str):
    """A function of a text column: whether RE2 finds the pattern in it."""
    same = to_re2(pattern)
    try:
        pc.match_substring_regex(pa.array([""]), pattern=same)
    except pa.ArrowInvalid as error:
        raise InvalidPattern(f"{pattern!r}: {error}") from None

    @F.arrow_udf(BooleanType())
    def match(text: pa.Array) -> pa.Array:
        return pc.match_substring_regex(text, pattern=same)

    return match


def filter_regex(
    df: DataFrame, pattern: str, enabled: bool = True, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose text matches; an empty or switched-off pattern keeps all."""
    if not pattern:
        return df
    matches = regex_match(row_text(columns or data_columns(df)), pattern)
    return df.filter(matches) if enabled else df


def filter_marked(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rows that carry a mark. Catalyst picks the join by the size of the marks."""
    marked = annotations.filter(F.col("mark").isNotNull()).select(ROW_ID)
    return df.join(marked, ROW_ID, "left_semi").select(*df.columns)


def filter_time(df: DataFrame, start: datetime, end: datetime, ts: str = TS) -> DataFrame:
    """Rows in the closed interval; rows without a time are dropped."""
    return df.filter(F.col(ts).between(F.lit(start), F.lit(end)))


def search_term(query: str) -> str:
    """The folded term; '' matches nothing."""
    term = query.strip(WHITE_SPACE)
    return "".join({"İ": "i"}.get(ch, ch.lower()) for ch in term)


def is_hit(text: Column, query: str) -> Column:
    """Whether ``text`` contains the query, ignoring case."""
    term = search_term(query)
    return F.contains(gfold(text), F.lit(term)) if term else F.lit(False)


def search(df: DataFrame, query: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose text contains the query, ignoring case."""
    return df.filter(is_hit(row_text(columns or data_columns(df)), query))


def match_spans(
    df: DataFrame, query: str, key: str = LINE_NO, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per cell with a hit: the 0-based starts of the hits in it, left to
    right and without overlap. ``key`` tells rows apart.

    A cell is split at the term; each hit starts behind the pieces and terms before it.
    """
    columns = list(columns or data_columns(df))
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), gfold(cell(c)).alias("text")) for c in columns
    ]))
    term = search_term(query)
    hits = (
        df.select(quoted(key), cells.alias("c"))
        .select(quoted(key), "c.column", "c.text")
        .filter(F.contains("text", F.lit(term)) if term else F.lit(False))
    )
    pieces = hits.select(
        quoted(key), "column", F.posexplode(F.split("text", re.escape(term) or "$", -1)).alias("at", "piece"))
    order = Window.partitionBy(quoted(key), "column").orderBy("at")
    through = F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    starts = pieces.withColumns({
        "start": through + F.col("at") * len(term), "more": F.lead("at").over(order).isNotNull(),
    }).filter("more")
    return starts.groupBy(quoted(key), "column").agg(F.sort_array(F.collect_list("start")).alias("starts"))
