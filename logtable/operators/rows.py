"""Row identity, row position and column profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logtable.functions.hashing import row_hash
from logtable.functions.text import as_column, cell, gtrim, quoted
from logtable.plans.ordered import in_order

# Columns the library adds beside the cells of the source.
LINE_NO = "line_no"
ROW_ID = "row_id"
TS = "ts_parsed"
HELPERS = (LINE_NO, ROW_ID, TS, "pos", "file")

# The role of a column by its name, per kind of source.
ROLES = {
    "host": {"details": "primary", "id": "secondary", "time": "secondary"},
    "plugin": {
        "message": "primary", "time": "secondary", "process": "secondary",
        "module": "secondary", "function": "secondary",
    },
    "stats": {"value": "primary", "key": "secondary", "process": "secondary", "date": "secondary"},
    "devinfo": {
        "value": "primary", "raw_value": "primary", "group_category": "secondary",
        "category": "secondary", "id": "secondary", "field_label": "secondary",
        "field_name": "secondary",
    },
}


def data_columns(df: DataFrame) -> list[str]:
    """The columns that came from the source, in order."""
    return [c for c in df.columns if c not in HELPERS]


def with_roles(df: DataFrame, source: str) -> DataFrame:
    """Record each column's role as field metadata."""
    roles = ROLES[source]
    for name in data_columns(df):
        role = roles.get(name.strip().lower(), "normal")
        df = df.withMetadata(name, {"role": role})
    return df


def with_line_no(df: DataFrame, *order: Column | str) -> DataFrame:
    """Dense line numbers from 1 in the given order, which must be total."""
    return in_order(df, [(as_column(c), False) for c in order], out=LINE_NO)


def with_row_id(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add the content identity of each row; equal rows share it."""
    return df.withColumn(ROW_ID, row_hash(columns or data_columns(df)))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: its place, role and whether any cell is not blank."""
    columns = list(columns or data_columns(df))
    roles = {f.name: (f.metadata or {}).get("role", "normal") for f in df.schema.fields}
    filled = [
        F.coalesce(F.max(gtrim(cell(c)) != ""), F.lit(False)).alias(f"_{i}")
        for i, c in enumerate(columns)
    ]
    entries = [
        F.struct(
            F.lit(i + 1).alias("ordinal"),
            F.lit(c).alias("column"),
            F.lit(roles[c]).alias("role"),
            F.col(f"_{i}").alias("has_data"),
            (F.col(f"_{i}") | F.lit(roles[c] == "primary")).alias("visible"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*filled).select(F.inline(F.array(*entries)))


def default_columns(df: DataFrame) -> list[str]:
    """The columns shown at first: all but the blank ones without primary role."""
    profile = column_profile(df).filter("visible").collect()  # one row per column
    return [row["column"] for row in sorted(profile, key=lambda row: row["ordinal"])]


def select_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the given cells, in order, and the helper columns."""
    helpers = [c for c in df.columns if c in HELPERS]
    return df.select(*[F.col(quoted(c)) for c in columns], *helpers)
