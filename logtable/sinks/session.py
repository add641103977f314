"""Saved sessions: rows, marks, comments and the time window.

A session is a folder with the tables ``rows`` and ``annotations`` and a small
document ``meta``. Tables are Parquet, or JSON lines: one object a row, in part
files that are written and read in parallel, so either form takes any size. The third
form, ``document``, is one JSON object of the kind that other programs open: a folder of
text parts, which are that object when they are put one after the other by name.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logtable.functions.hashing import unsigned
from logtable.functions.text import cell
from logtable.operators.columns import ColumnView, reset_view
from logtable.operators.rows import LINE_NO, ROW_ID, data_columns
from logtable.operators.windows import TimeWindow

VERSION = 1

# How JSON sessions number the roles, and an unset time.
ROLE_NUMBERS = {"normal": 0, "primary": 1, "secondary": 2}
UNSET_TIME = "0001-01-01T00:00:00Z"


def _window_fields(window: TimeWindow | None) -> dict:
    if window is None:
        return {"enabled": False, "start": UNSET_TIME, "end": UNSET_TIME}
    start, end = (f"{at:%Y-%m-%dT%H:%M:%S.%f}".rstrip("0").rstrip(".") + "Z"
                  for at in (window.start, window.end))
    return {"enabled": window.enabled, "start": start, "end": end}


def _header(df: DataFrame, view: ColumnView) -> list[dict]:
    roles = {f.name: (f.metadata or {}).get("role", "normal") for f in df.schema.fields}
    source = data_columns(df)
    return [
        {"Name": c, "Index": source.index(c), "Role": ROLE_NUMBERS[roles[c]],
         "Visible": c not in view.hidden, "MinWidth": 8, "Weight": 1.0, "Width": 0}
        for c in view.order
    ]


def _row_object(columns: list[str]) -> list[Column]:
    """A row as it stands in JSON: its cells, identity and line."""
    return [
        F.array(*[cell(c) for c in columns]).alias("cols"),
        unsigned(F.col(ROW_ID)).cast("decimal(20,0)").alias("id"), F.col(LINE_NO).alias("originalIndex"),
    ]


def _json_annotations(annotations: DataFrame) -> DataFrame:
    return annotations.select(unsigned(F.col(ROW_ID)).cast("decimal(20,0)").alias("id"), "mark", "comment")


def _write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def _entries(df: DataFrame, section: int, order: str, text: Column) -> DataFrame:
    """One line an entry, each but the first after a comma."""
    first = df.agg(F.min(order).alias("first")).first()["first"]
    comma = F.when(F.col(order) == first, "").otherwise(",")
    return df.select(F.lit(section).alias("section"), F.col(order).alias("place"), F.concat(comma, text).alias("value"))


def _marked(annotations: DataFrame, section: int, column: str) -> DataFrame:
    """One member of an object for each identity that has a mark or a comment."""
    pair = F.to_json(F.create_map(unsigned(F.col(ROW_ID)), F.col(column)))
    return _entries(annotations.filter(F.col(column) != ""), section, ROW_ID, pair.substr(F.lit(2), F.char_length(pair) - 2))


def _write_document(spark: SparkSession, between: list[str], sections: list[DataFrame], path: str) -> None:
    """Texts and, between them, the entries of the sections, in order. The sort keeps entries in
    parts; no part ends with a comma, and nothing is put together."""
    texts = [(2 * i, 0, text) for i, text in enumerate(between)]
    lines = spark.createDataFrame(texts, "section int, place bigint, value string")
    for section in sections:
        lines = lines.unionByName(section)
    lines.orderBy("section", "place").select("value").write.text(path)


def write_session(
    df: DataFrame, annotations: DataFrame, path: str, window: TimeWindow | None = None,
    view: ColumnView | None = None, note: str = "", format: str = "parquet",
) -> None:
    """Save every row with marks, comments and the window; filter and sort are not saved.

    ``format`` is parquet, json or document. Line numbers are unique, and so are the
    identities of annotations.
    """
    meta = {
        "version": VERSION, "format": format, "header": _header(df, view or reset_view(df)),
        "timeWindow": _window_fields(window), "note": note,
    }
    columns = data_columns(df)
    if format == "document":
        del meta["format"]
        head, tail = ({k: meta[k] for k in keys} for keys in (("version", "header"), ("timeWindow", "note")))
        between = [
            f'{json.dumps(head)[:-1]}, "rows": [', '], "marked": {', '}, "comments": {', f"}}, {json.dumps(tail)[1:]}",
        ]
        rows = _entries(df, 1, LINE_NO, F.to_json(F.struct(*_row_object(columns))))
        _write_document(df.sparkSession, between, [rows, _marked(annotations, 3, "mark"), _marked(annotations, 5, "comment")], path)
        return
    if format == "parquet":
        df.select(*[cell(c).alias(c) for c in columns], ROW_ID, LINE_NO).write.parquet(f"{path}/rows")
        annotations.select(ROW_ID, "mark", "comment").write.parquet(f"{path}/annotations")
    else:
        df.select(*_row_object(columns)).write.json(f"{path}/rows")
        _json_annotations(annotations).write.json(f"{path}/annotations")
    _write_meta(df.sparkSession, meta, path)


def write_annotations(annotations: DataFrame, path: str, format: str = "parquet") -> None:
    """Save marks and comments alone, to lay over a fresh import later."""
    if format == "parquet":
        annotations.select(ROW_ID, "mark", "comment").write.parquet(path)
        return
    if format == "document":
        between = [f'{{"version": {VERSION}, "marked": {{', '}, "comments": {', "}}"]
        _write_document(annotations.sparkSession, between, [_marked(annotations, 1, "mark"), _marked(annotations, 3, "comment")], path)
        return
    _json_annotations(annotations).write.json(f"{path}/annotations")
    _write_meta(annotations.sparkSession, {"version": VERSION, "format": format}, path)
