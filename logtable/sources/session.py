"""Saved sessions and annotations: folders of Parquet or JSON lines, or one JSON document of any size."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logtable.functions.hashing import signed
from logtable.operators.annotate import clean_marks
from logtable.operators.columns import ColumnView
from logtable.operators.rows import LINE_NO, ROW_ID
from logtable.operators.windows import (
    NoTimestamps, TimeWindow, bounds, restored_window, time_column, with_ts,
)
from logtable.sinks.session import ROLE_NUMBERS, VERSION
from logtable.sources.json_document import Document, read_json_document

ROW_SCHEMA = "cols ARRAY<STRING>, id DECIMAL(20,0), originalIndex BIGINT"
ANNOTATION_SCHEMA = "id DECIMAL(20,0), mark STRING, comment STRING"


@dataclass(frozen=True)
class Session:
    """A restored session: rows with identity and line number, and what lay over them."""

    rows: DataFrame
    annotations: DataFrame
    columns: ColumnView
    window: TimeWindow | None
    note: str


def _check_version(version: int | None) -> None:
    if version != VERSION:
        raise ValueError(f"session version {version} not supported (want {VERSION})")


def _parse_time(text: str | None) -> datetime | None:
    """RFC 3339; '' and year 1 mean unset."""
    if not text:
        return None
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"invalid time in saved window: {text!r}") from None
    return at.astimezone(timezone.utc) if at.year > 1 else None


def _window(saved: dict | None) -> TimeWindow | None:
    if not saved:
        return None
    start, end = _parse_time(saved.get("start")), _parse_time(saved.get("end"))
    if start is None or end is None:
        return None
    return TimeWindow(start, end, bool(saved.get("enabled")))


def _key(text: Column) -> Column:
    bad = F.concat(F.lit("not a row identity: "), text)
    return F.coalesce(signed(text), F.raise_error(bad).cast("bigint"))


def _json_annotations(document: Document) -> DataFrame:
    fields = []
    for name, field in (("marked", "mark"), ("comments", "comment")):
        entry = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "MAP<STRING, STRING>", {"mode": "FAILFAST"})
        entries = document.member(name).select(F.explode(entry))
        fields.append(entries.select(_key(F.col("key")).alias(ROW_ID), F.col("value").alias(field)))
    return clean_marks(fields[0].join(fields[1], ROW_ID, "full"))


def _document_rows(document: Document) -> DataFrame:
    return document.member("rows").select(F.from_json("text", ROW_SCHEMA, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def _document_meta(document: Document) -> dict:
    """The small members; fields that a column lacks are unset."""
    meta = document.small("version", "header", "timeWindow", "note")
    unset = {"Name": "", "Index": 0, "Role": 0, "Visible": False}
    return {**meta, "header": [{**unset, **column} for column in meta.get("header") or []]}


def _saved_rows(saved: DataFrame, names: list[str]) -> DataFrame:
    """Rows out of their JSON objects."""
    return saved.select(
        *[F.coalesce(F.get("cols", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)],
        _key(F.col("id").cast("string")).alias(ROW_ID),
        F.col("originalIndex").alias(LINE_NO),
    )


def _meta(spark: SparkSession, path: str) -> dict | None:
    """What a session folder says of itself; none if ``path`` is a single document."""
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    _check_version(meta.get("version"))
    return meta


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Annotations saved as JSON lines."""
    saved = spark.read.schema(ANNOTATION_SCHEMA).json(f"{path}/annotations", mode="FAILFAST")
    return clean_marks(saved.select(_key(F.col("id").cast("string")).alias(ROW_ID), "mark", "comment"))


def read_session(spark: SparkSession, path: str) -> Session:
    """Restore a session from its folder, or from a single JSON document (a file, or a folder
    of its parts in the order of their names).

    A saved window is fitted to the rows' time bounds.
    """
    meta = _meta(spark, path)
    if meta is None:
        document = read_json_document(spark, path)
        meta = _document_meta(document)
        _check_version(meta.get("version"))
        annotations = _json_annotations(document)
        saved = _document_rows(document)
    elif meta.get("format") == "json":
        annotations = _json_lines(spark, path)
        saved = spark.read.schema(ROW_SCHEMA).json(f"{path}/rows", mode="FAILFAST")
    else:
        annotations, saved = spark.read.parquet(f"{path}/annotations"), None
    names = [h["Name"] for h in sorted(meta["header"] or [], key=lambda h: h["Index"])]
    rows = spark.read.parquet(f"{path}/rows") if saved is None else _saved_rows(saved, names)
    header = meta["header"] or []
    numbers = {number: role for role, number in ROLE_NUMBERS.items()}
    for column in header:
        rows = rows.withMetadata(column["Name"], {"role": numbers.get(column["Role"], "normal")})
    columns = ColumnView(
        tuple(h["Name"] for h in header), frozenset(h["Name"] for h in header if not h["Visible"])
    )
    window = _window(meta.get("timeWindow"))
    if window and window.enabled and time_column(columns.order):
        try:
            window = restored_window(window, bounds(with_ts(rows)))
        except NoTimestamps:
            pass
    return Session(rows, annotations, columns, window, meta.get("note") or "")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Saved marks and comments: Parquet, JSON lines, or a single JSON document."""
    if not path.rstrip("/").endswith(".json"):
        return spark.read.parquet(path)
    if _meta(spark, path) is not None:
        return _json_lines(spark, path)
    document = read_json_document(spark, path)
    _check_version(document.small("version").get("version"))
    return _json_annotations(document)
