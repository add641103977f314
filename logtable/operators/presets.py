"""Named regex filters."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from logtable.functions.patterns import InvalidPattern, needed_text, to_re2
from logtable.functions.text import cell, gtrim, row_text
from logtable.operators.filters import filter_regex, regex_match
from logtable.operators.rows import data_columns

SCHEMA = "ord INT, pattern STRING, description STRING"

# The filters that come with host logs. Other logs have none.
HOST_PRESETS = (
    ("(?i)OS Classification Score - -1|Function Classification Score - -1",
     "Classification failures: score is -1 in Details"),
    (r"(?i)Failed to learn .* : No updated classification\.",
     "Failed-to-learn details where classification was not updated"),
    (r"(?i)Label Active Test.*DHTestLabel.*Executing action - Add Label\. Details:",
     "Long policy details: executing Add Label action"),
    ("(?i)Label Active Test.*Host evaluation changed from .*Duration: 5 minutes",
     "Long evaluation details with transition and duration"),
    ("(?i)Assigned Label - Assigned Label no longer includes DHTestLabel; "
     "Context: Removed by plugin Advanced Tools",
     "Property details for label removal context"),
    ("(?i)NIC Vendor Value - Property value cleared: NIC Vendor Value - .*; Context: Purger",
     "Property value cleared events from Purger context"),
)


def filter_preset(
    df: DataFrame, presets: Sequence[tuple[str, str]], name: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows that match the preset with this description (or pattern)."""
    for pattern, description in presets:
        if name in (description, pattern):
            return filter_regex(df, pattern, columns=columns)
    raise KeyError(f"no preset {name!r}")


def tag_presets(
    df: DataFrame, presets: Sequence[tuple[str, str]], columns: Sequence[str] | None = None
) -> DataFrame:
    """Add ``presets``: the descriptions of all presets a row matches, in one pass."""
    text = row_text(columns or data_columns(df))
    tags = [F.when(regex_match(text, pattern), F.lit(name)) for pattern, name in presets]
    return df.withColumn("presets", F.array_compact(F.array(*tags)))


def preset_hits(
    df: DataFrame, presets: Sequence[tuple[str, str]], columns: Sequence[str] | None = None
) -> DataFrame:
    """A row for each preset that a row matches, with its description as ``preset``.

    Answers are exploded before any is dropped, so each pattern is tried once a row.
    """
    text = row_text(columns or data_columns(df))
    answers = [F.struct(F.lit(name).alias("preset"), regex_match(text, pattern).alias("hit")) for pattern, name in presets]
    tried = df.withColumn("_answer", F.explode(F.array(*answers))).filter("_answer.hit")
    return tried.withColumn("preset", F.col("_answer.preset")).drop("_answer")


@functools.cache
def _automaton(texts: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds all of the texts in one walk over a cell; built once in a Python worker."""
    automaton = ahocorasick.Automaton()
    for number, text in enumerate(texts):
        automaton.add_word(text, number)
    automaton.make_automaton()
    return automaton


def _found_texts(texts: tuple[str, ...], cells: pa.Array) -> list[list[int]]:
    """For each text, the numbers of the cells that hold it."""
    found = [[] for _ in texts]
    if texts:
        automaton = _automaton(texts)
        for row, value in enumerate(cells):
            for number in {number for _, number in automaton.iter(value.as_py() or "")}:
                found[number].append(row)
    return found


def possible_presets(presets: Sequence[tuple[str, str]]):
    """A function of a text column: the numbers, from 0, of the presets that match it, ascending.

    All matches of most patterns hold some text. An automaton finds these texts in one walk
    over a cell, so a pattern is tried on those cells only that hold its text; patterns
    without such a text are tried on every cell. RE2 tries them, on whole batches.
    """
    patterns = [to_re2(pattern) for pattern, _ in presets]
    for (pattern, _), same in zip(presets, patterns):
        try:
            pc.match_substring_regex(pa.array([""]), pattern=same)
        except pa.ArrowInvalid as error:
            raise InvalidPattern(f"{pattern!r}: {error}") from None
    needed = [needed_text(pattern) for pattern, _ in presets]
    texts = tuple(sorted(set(needed) - {""}))
    number_of = {text: number for number, text in enumerate(texts)}

    @F.arrow_udf(ArrayType(IntegerType()))
    def match(cells: pa.Array) -> pa.Array:
        found = _found_texts(texts, cells)
        rows, numbers = [], []
        for number, (pattern, text) in enumerate(zip(patterns, needed)):
            tried = pa.array(found[number_of[text]] if text else range(len(cells)), pa.int64())
            hits = tried.filter(pc.match_substring_regex(cells.take(tried), pattern=pattern)).to_numpy()
            rows.append(hits)
            numbers.append(np.full(len(hits), number, np.int32))
        rows = np.concatenate([*rows, np.empty(0, np.int64)])
        numbers = np.concatenate([*numbers, np.empty(0, np.int32)])
        order = np.argsort(rows, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(cells)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers[order], pa.int32()))

    return match


def many_preset_hits(
    df: DataFrame, presets: Sequence[tuple[str, str]], columns: Sequence[str] | None = None
) -> DataFrame:
    """:func:`preset_hits` for hundreds of presets or more: a row costs one walk over its text,
    and a pattern for each preset that may match."""
    names = F.array(*[F.lit(name) for _, name in presets]).cast("array<string>")
    hits = df.withColumn("_number", F.explode(possible_presets(presets)(row_text(columns or data_columns(df)))))
    return hits.withColumn("preset", F.get(names, "_number")).drop("_number")


def dedupe_ordered(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Trim the key, drop blanks, keep the first row of each key."""
    rest = [c for c in df.columns if c not in (key, order)]
    trimmed = df.withColumn(key, gtrim(cell(key))).filter(F.col(key) != "")
    first = trimmed.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return first.select(f"_first.{order}", key, *[f"_first.{c}" for c in rest])


def _clean(presets: DataFrame) -> DataFrame:
    trimmed = gtrim(cell("description")).alias("description")
    return dedupe_ordered(presets, "pattern").select("ord", "pattern", trimmed)


def merge_presets(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base order; the same pattern is replaced in place, new ones follow."""
    both = _clean(base).withColumn("layer", F.lit(0)).unionByName(
        _clean(overlay).withColumn("layer", F.lit(1))
    )
    return both.groupBy("pattern").agg(
        F.min(F.struct("layer", "ord")).alias("place"),
        F.max_by("description", "layer").alias("description"),
    ).select(F.col("place.layer").alias("layer"), F.col("place.ord").alias("ord"),
             "pattern", "description")
