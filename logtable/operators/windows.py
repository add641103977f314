"""Time bounds of a table and the closed time window laid over it."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType

from logtable.functions.text import BOM, WHITE_SPACE
from logtable.functions.times import DEFAULT_ZONES, parse_log_ts
from logtable.operators.rows import LINE_NO, TS, data_columns
from logtable.plans.ordered import running_sum

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MICROSECOND = timedelta(microseconds=1)

# Fixed value: the width an empty window counts as when it is moved.
EMPTY_WIDTH = timedelta(minutes=15)


class NoTimestamps(ValueError):
    """The table has no parsable time."""


@dataclass(frozen=True)
class TimeWindow:
    """A closed interval of UTC instants; a disabled window filters nothing."""

    start: datetime
    end: datetime
    enabled: bool = True


@dataclass(frozen=True)
class Bounds:
    low: datetime
    high: datetime

    def clamp(self, at: datetime) -> datetime:
        return min(max(at, self.low), self.high)


def instant(micros: int) -> datetime:
    return EPOCH + micros * MICROSECOND


def micros(at: datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (at - EPOCH) // MICROSECOND


def time_literal(df: DataFrame, ts: str, at: datetime) -> Column:
    """``at`` in the type of column ``ts``, so that a filter on it can be pushed down."""
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        return F.to_timestamp_ntz(F.lit(f"{instant(micros(at)):%Y-%m-%d %H:%M:%S.%f}"))
    return F.timestamp_micros(F.lit(micros(at)))


def _micros_of(df: DataFrame, ts: str) -> Column:
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        return F.unix_micros(F.convert_timezone(
            F.lit("UTC"), F.current_timezone(), F.col(ts)
        ).cast("timestamp"))
    return F.unix_micros(ts)


def time_column(columns: Sequence[str]) -> str | None:
    """The first column called time or timestamp, else the first date or ts."""
    names = [(c.strip(WHITE_SPACE).removeprefix(BOM).lower(), c) for c in columns]
    for wanted in (("time", "timestamp"), ("date", "ts")):
        for name, column in names:
            if name in wanted:
                return column
    return None


def with_ts(
    df: DataFrame, column: str | None = None, zones: Mapping[str, str] = DEFAULT_ZONES
) -> DataFrame:
    """Add the parsed time of each row, NULL where there is none."""
    column = column or time_column(data_columns(df))
    parsed = parse_log_ts(column, zones) if column else F.lit(None).cast("timestamp")
    return df.withColumn(TS, parsed)


def time_bounds(df: DataFrame, ts: str = TS) -> DataFrame:
    """One row: earliest and latest time, and whether there is any."""
    return df.agg(
        F.min(ts).alias("time_min"),
        F.max(ts).alias("time_max"),
        (F.count(ts) > 0).alias("has_time"),
    )


def bounds(df: DataFrame, ts: str = TS) -> Bounds:
    """The time bounds as values."""
    at = _micros_of(df, ts)
    row = df.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    if row["low"] is None:
        raise NoTimestamps("no timestamps available")
    return Bounds(instant(row["low"]), instant(row["high"]))


def in_window(df: DataFrame, window: TimeWindow | None, ts: str = TS) -> Column:
    """Whether a row is inside the window; an enabled one holds no row without a time."""
    if window is None or not window.enabled:
        return F.lit(True)
    first, last = time_literal(df, ts, window.start), time_literal(df, ts, window.end)
    return (F.col(ts) >= first) & (F.col(ts) <= last)


def filter_window(df: DataFrame, window: TimeWindow | None, ts: str = TS) -> DataFrame:
    """Rows inside the window; rows without a time drop out while it is enabled."""
    return df if window is None or not window.enabled else df.filter(in_window(df, window, ts))


# --- choosing a window -------------------------------------------------------

def with_edge(
    window: TimeWindow | None, at: datetime, limits: Bounds, edge: str
) -> TimeWindow:
    """Move one edge to ``at``, inside the bounds; a crossed edge moves along."""
    unset = window is None or not window.enabled
    start, end = (limits.low, limits.high) if unset else (window.start, window.end)
    start = limits.clamp(at if edge == "start" else start)
    end = limits.clamp(at if edge == "end" else end)
    if start > end:
        start = end = start if edge == "start" else end
    return TimeWindow(start, end)


def window_from_row(
    df: DataFrame, window: TimeWindow | None, line_no: int, edge: str, ts: str = TS
) -> TimeWindow:
    """Set ``edge`` (``'start'`` or ``'end'``) to the time of a row."""
    limits = bounds(df, ts)
    row = df.filter(F.col(LINE_NO) == line_no).select(_micros_of(df, ts).alias("at")).first()
    if row is None or row["at"] is None:
        raise NoTimestamps("no timestamp on this row")
    return with_edge(window, instant(row["at"]), limits, edge)


def parse_input(text: str) -> datetime | None:
    """``yyyy-MM-dd HH:mm`` with optional seconds."""
    text = text.strip(WHITE_SPACE)
    found = re.fullmatch(r"\d{4}-\d{2}-\d{2} +\d{1,2}:\d{2}(:\d{2})?", text, re.ASCII)
    if not found:
        return None
    layout = "%Y-%m-%d %H:%M:%S" if found[1] else "%Y-%m-%d %H:%M"
    try:
        return datetime.strptime(" ".join(text.split()), layout).replace(tzinfo=timezone.utc)
    except ValueError:
        return None


def window_from_text(limits: Bounds, start: str, end: str) -> TimeWindow:
    """A window from two typed times, clamped to the bounds."""
    first, last = parse_input(start), parse_input(end)
    if first is None:
        raise ValueError("invalid start time")
    if last is None:
        raise ValueError("invalid end time")
    if first > last:
        raise ValueError("start is after end")
    return TimeWindow(limits.clamp(first), limits.clamp(last))


def shift_window(window: TimeWindow, limits: Bounds, delta: timedelta) -> TimeWindow:
    """Slide the window, keeping its width, as far as the bounds allow.

    Where a bound stops it, an empty window opens to ``EMPTY_WIDTH``.
    """
    held = window.end - window.start
    room = held or EMPTY_WIDTH
    last_start = limits.high - room
    if last_start < limits.low:
        return TimeWindow(limits.low, limits.high)
    wanted = window.start + delta
    start = Bounds(limits.low, last_start).clamp(wanted)
    return TimeWindow(start, start + (held if start == wanted else room))


def expand_window(window: TimeWindow, limits: Bounds, delta: timedelta) -> TimeWindow:
    """Move the start left (negative) or the end right (positive), inside the bounds."""
    if not delta:
        return TimeWindow(window.start, window.end)
    moved = limits.clamp((window.start if delta < timedelta(0) else window.end) + delta)
    fixed = window.end if delta < timedelta(0) else window.start
    if delta < timedelta(0):
        return TimeWindow(moved, max(moved, fixed))
    return TimeWindow(min(moved, fixed), moved)


def reset_window(limits: Bounds, keep_enabled: bool) -> TimeWindow:
    """The whole range: enabled it still drops rows without a time."""
    return TimeWindow(limits.low, limits.high, enabled=keep_enabled)


def restored_window(window: TimeWindow, limits: Bounds) -> TimeWindow:
    """A saved window fitted to the table: clamped, or the whole range if inverted."""
    if not window.enabled:
        return window
    start, end = limits.clamp(window.start), limits.clamp(window.end)
    return TimeWindow(start, end) if start <= end else TimeWindow(limits.low, limits.high)


# --- all positions of a sliding window ---------------------------------------

def window_profile(
    df: DataFrame, width: timedelta, step: timedelta, ts: str = TS
) -> DataFrame:
    """How many rows the window holds at every position, as it slides from the
    earliest time by ``step`` until its end meets the latest time.

    Each row enters at one position and leaves after another. These entries and
    exits are summed per position before they are added up along the positions,
    so the cost depends neither on the overlap nor on how crowded a position is.
    """
    limits = bounds(df, ts)
    low, span = micros(limits.low), micros(limits.high) - micros(limits.low)
    size, hop = width // MICROSECOND, step // MICROSECOND
    if size <= 0 or hop <= 0:
        raise ValueError("width and step must be positive")
    size = min(size, span)
    last = -(-(span - size) // hop)  # the final position ends at the latest time
    spark = df.sparkSession
    at = (_micros_of(df, ts) - F.lit(low)).alias("at")
    offsets = df.filter(F.col(ts).isNotNull()).select(at)
    into = F.expr(f"if(at <= {size}L, 0L, (at - {size}L + {hop - 1}L) div {hop}L)")
    out_of = F.expr(f"least(at div {hop}L, {last - 1}L) + 1L")
    changes = offsets.select(F.inline(F.array(
        F.struct(into.alias("position"), F.when(into < out_of, 1).otherwise(0).alias("change")),
        F.struct(out_of.alias("position"), F.when(into < out_of, -1).otherwise(0).alias("change")),
        F.struct(
            F.lit(last).cast("bigint").alias("position"),
            (F.col("at") >= span - size).cast("int").alias("change"),
        ),
    )))
    per_position = changes.filter("change <> 0").groupBy("position").agg(
        F.sum("change").alias("change")
    )
    grid = spark.range(last + 1).withColumnRenamed("id", "position")
    filled = grid.join(per_position, "position", "left").fillna(0, ["change"])
    start = F.least(F.col("position") * hop, F.lit(span - size)) + F.lit(low)
    return running_sum(filled, "position", F.col("change"), "rows").select(
        "position", start.alias("start_us"), (start + size).alias("end_us"), "rows"
    )
