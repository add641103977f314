"""Text rules: trimming, case folding, row text and number syntax.

A missing cell and an empty cell are the same thing everywhere in this
library, so every helper reads NULL as ``''``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\u000b\f\r \u0085  "
    "           "
    "    　"
)

BOM = "﻿"

NUMBER = (
    r"^(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:[+-]?inf(?:inity)?|nan))\z"
)
WHOLE_NUMBER = r"^[+-]?[0-9]+\z"


def as_column(col: Column | str) -> Column:
    return F.col(quoted(col)) if isinstance(col, str) else col


def quoted(name: str) -> str:
    """A column name as one identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def cell(col: Column | str) -> Column:
    """The cell as text, '' when missing."""
    return F.coalesce(as_column(col).cast("string"), F.lit(""))


def gtrim(col: Column | str) -> Column:
    """Trim every Unicode white-space character, not only U+0020."""
    return F.btrim(as_column(col), F.lit(WHITE_SPACE))


def gfold(col: Column | str) -> Column:
    """Lower-case character by character, without context or expansion rules."""
    col = as_column(col)
    special = F.contains(col, F.lit("Σ")) | F.contains(col, F.lit("İ"))
    return F.lower(F.when(special, F.translate(col, "Σİ", "σi")).otherwise(col))


def row_text(columns: Sequence[str], sep: str = "\t") -> Column:
    """All cells of a row joined by ``sep``."""
    return F.concat_ws(sep, *[cell(c) for c in columns])


def parse_float(text: Column) -> Column:
    """DOUBLE for number syntax, NULL otherwise or when out of range."""
    number = text.try_cast("double")
    may_overflow = (
        (F.char_length(text) > 300) | F.contains(text, F.lit("e")) | F.contains(text, F.lit("E"))
    )
    out_of_range = may_overflow & (F.abs(number) == float("inf"))
    return F.when(text.rlike(NUMBER), F.when(~out_of_range, number))


def parse_number(col: Column | str) -> Column:
    """The number a cell sorts by: thousands commas are ignored."""
    return parse_float(gtrim(F.replace(cell(col), F.lit(","), F.lit(""))))


def parse_int(text: Column) -> Column:
    """BIGINT for an optionally signed run of digits that fits, else NULL."""
    return F.when(text.rlike(WHOLE_NUMBER), text.try_cast("bigint"))
