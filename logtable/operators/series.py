"""Per-key numeric readings as bucketed, gap-filled and scaled time series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logtable.functions.text import cell, gtrim, parse_float, parse_int
from logtable.operators.rows import LINE_NO
from logtable.plans.ordered import running_last_of
from logtable.plans.staging import stage

# How many series a chart shows and a function takes (limits that a caller
# may ask for; there is none by default), and what a blank key is called.
VIEW_KEYS = 8
FUNCTION_KEYS = 5
EMPTY_KEY = "(empty)"

# A series is filled in blocks of so many buckets.
FILL_BLOCK = 1024

LARGEST_LONG = 2**63 - 1


class NoSeries(ValueError):
    """No row has both a whole-number time and a numeric value."""


class TooManySeries(ValueError):
    """More distinct keys than the chart takes: filter down first."""


@dataclass(frozen=True)
class Extent:
    """The time range all series share, and the series in order of appearance."""

    low: int
    high: int
    series: tuple[str, ...]

    @property
    def span(self) -> int:
        return max(1, self.high - self.low)


def _mode(value: str | None, known: tuple[str, ...]) -> str:
    """A mode by name, ignoring case; anything unknown means the first one."""
    value = (value or "").strip().lower()
    return value if value in known else known[0]


def series_points(
    df: DataFrame, time: str, series: str, value: str, order: str = LINE_NO
) -> DataFrame:
    """Long form ``(series, ts, val, ord)``; rows without a number in both are left out."""
    key = gtrim(cell(series))
    return df.select(
        F.when(key == "", EMPTY_KEY).otherwise(key).alias("series"),
        parse_int(gtrim(cell(time))).alias("ts"),
        parse_float(gtrim(cell(value))).alias("val"),
        F.col(order).alias("ord"),
    ).filter(F.col("ts").isNotNull() & F.col("val").isNotNull())


def series_extent(points: DataFrame, max_keys: int | None = None) -> Extent:
    """One pass over the points: shared range and, if there is a limit, the series; more
    than ``max_keys`` of them are refused.

    Partial sums make one row per key in each task, and at most ``max_keys + 1``
    rows come back. Without a limit only the range comes back.
    """
    if max_keys is None:
        row = points.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
        if row["low"] is None:
            raise NoSeries("no numeric values")
        return Extent(row["low"], row["high"], ())
    per_key = points.groupBy("series").agg(
        F.min("ts").alias("low"), F.max("ts").alias("high"), F.min("ord").alias("seen")
    )
    keys = per_key.limit(max_keys + 1).collect()
    if not keys:
        raise NoSeries("no numeric values")
    if len(keys) > max_keys:
        raise TooManySeries(f"too much data, filter down to {max_keys}")
    return Extent(
        min(k["low"] for k in keys),
        max(k["high"] for k in keys),
        tuple(k["series"] for k in sorted(keys, key=lambda k: k["seen"])),
    )


def _bucket(extent: Extent, width: int) -> Column:
    """The first bucket whose end is not before ``ts``, in whole numbers."""
    steps = max(1, width - 1)
    wide = extent.span * (steps + 1) > LARGEST_LONG
    kind = "decimal(38,0)" if wide else "bigint"
    return F.expr(
        f"cast(((cast(ts as {kind}) - cast({extent.low} as {kind})) * cast({steps} as {kind})"
        f" + cast({extent.span - 1} as {kind})) div cast({extent.span} as {kind}) as bigint)"
    )


def _bucket_end(extent: Extent, width: int) -> Column:
    steps = max(1, width - 1)
    return F.expr(
        f"cast({extent.low} + cast({extent.span} as decimal(19,0)) * x div {steps} as bigint)"
    )


def _place() -> Column:
    """Time, then row order, as one fixed-width number: a hash aggregation can keep
    it in place, where a pair would have every row sorted first."""
    return F.expr("cast(ts as decimal(20,0)) * 9223372036854775808BD + ord")


def _aggregate(agg: str) -> Column:
    """The bucket value. A first reading that is not a number sticks for max and min."""
    if agg == "last":
        return F.max_by("val", "at")
    if agg == "avg":
        return F.avg("val")
    real = F.when(~F.isnan("val"), F.col("val"))
    best = F.max(real) if agg == "max" else F.min(real)
    first = F.min_by("val", "at")
    return F.when(F.isnan(first), first).otherwise(best)


def bucket_series(
    points: DataFrame,
    width: int,
    agg: str = "last",
    fill: str = "hold",
    max_keys: int | None = None,
    extent: Extent | None = None,
) -> DataFrame:
    """``(series, x, bucket_ts, value)`` for every series and ``x`` in ``0..width-1``.

    ``agg`` is last, avg, max or min. With ``fill='hold'`` an empty bucket takes
    the last reading before it (not the last bucket value); with ``'none'`` it
    stays NULL. Buckets before the first reading are NULL in either case.
    """
    agg = _mode(agg, ("last", "avg", "max", "min"))
    fill = _mode(fill, ("hold", "none"))
    extent = extent or series_extent(points, max_keys)
    placed = points.select("series", "val", _bucket(extent, width).alias("x"), _place().alias("at"))
    if width == 1:  # one bucket takes only the earliest time
        placed = placed.filter("x = 0")
    values = [_aggregate(agg).alias("value")]
    if fill == "hold":
        values.append(F.max_by("val", "at").alias("held"))
    buckets = placed.groupBy("series", "x").agg(*values)
    if fill == "hold":  # blocks and what is carried between them read the same buckets
        buckets = stage(buckets)
    if extent.series:
        names = points.sparkSession.createDataFrame([(s,) for s in extent.series], "series string")
    else:
        names = points.select("series").distinct()
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))
    grid = names.select("series", F.explode(places).alias("x"))
    filled = grid.join(buckets, ["series", "x"], "left")
    value = F.col("value")
    if fill == "hold":
        filled = running_last_of(filled, "series", "x", F.col("held"), "held", FILL_BLOCK)
        value = F.coalesce(value, F.col("held"))
    return filled.withColumn("value", value).select(
        "series", "x", _bucket_end(extent, width).alias("bucket_ts"),
        F.when(~F.isnan("value"), F.col("value")).alias("value"),
    )


def scaled(value: Column, mode: str = "linear") -> Column:
    """linear, log1p (negatives count as 0) or symlog."""
    mode = _mode(mode, ("linear", "log1p", "symlog"))
    if mode == "log1p":
        return F.log1p(F.greatest(value, F.lit(0.0)))
    if mode == "symlog":
        return F.signum(value) * F.log1p(F.abs(value))
    return value


def scale_series(buckets: DataFrame, mode: str = "linear") -> DataFrame:
    return buckets.withColumn("value", scaled(F.col("value"), mode))


def normalise_series(buckets: DataFrame, layout: str = "overlay") -> DataFrame:
    """Add ``y`` in [0, 1]: over all series (overlay) or each on its own (split).

    A range of zero gives 0.5. The overlay's range is one row, by an aggregate of partial
    ranges, which is broadcast.
    """
    layout = _mode(layout, ("overlay", "split"))
    ranges = buckets.groupBy("series").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    if layout == "overlay":
        one = F.lit(1).alias("_one")
        whole = buckets.agg(F.min("value").alias("low"), F.max("value").alias("high")).select("*", one)
        joined = buckets.select("*", one).join(F.broadcast(whole), "_one")
    else:
        joined = buckets.join(ranges, "series")
    span = F.col("high") - F.col("low")
    ratio = (F.col("value") - F.col("low")) / F.nullif(span, F.lit(0.0))
    y = F.when(F.col("value").isNull(), None).when(span == 0, 0.5).otherwise(ratio)
    return joined.select(
        *buckets.columns, F.when(y < 0, 0.0).when((y > 1) & ~F.isnan(y), 1.0).otherwise(y).alias("y")
    )


def bucket_of(ts: Column, extent: Extent, width: int) -> Column:
    """The bucket a row's time falls under; no whole-number time counts as 0."""
    if width <= 1:
        return F.lit(0).cast("bigint")
    low, high = F.lit(extent.low), F.lit(extent.low + extent.span)
    at = F.least(F.greatest(F.coalesce(ts, F.lit(0)).cast("bigint"), low), high) - low
    ratio = at.cast("double") / F.lit(float(extent.span)) * F.lit(float(width - 1))
    return F.least(F.ceil(ratio).cast("bigint"), F.lit(width - 1)).cast("bigint")
