"""Time windows and series."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from logtable.operators.series import (
    TooManySeries, bucket_of, bucket_series, normalise_series, scale_series, series_extent, series_points,
)
from logtable.operators.windows import (
    TimeWindow, bounds, expand_window, filter_window, in_window, parse_input, reset_window, shift_window,
    time_bounds, window_from_row, window_from_text, window_profile, with_ts,
)
from queries.table import MIXED_TIMES, mixed_times
from queries.tables import event_log, read

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def keep(function):
        QUERIES[name], SQL[name] = function, sql
        return function

    return keep


# --- windows ------------------------------------------------------------------------------

@query("time_bounds", f"""WITH {MIXED_TIMES}
SELECT min(us) AS low_us, max(us) AS high_us, count(us) > 0 AS has_time FROM mixed""")
def mixed_bounds(spark, sf_dir):
    found = time_bounds(with_ts(mixed_times(spark, sf_dir)))
    return found.select(
        F.unix_micros("time_min").alias("low_us"), F.unix_micros("time_max").alias("high_us"), "has_time"
    )


PROFILE = """WITH times AS (SELECT epoch_us(ts) AS us FROM events),
ends AS (SELECT min(us) AS low, max(us) AS high FROM times),
places AS (SELECT unnest(range(CAST(ceil((high - low - {width}) / CAST({step} AS DOUBLE)) AS BIGINT) + 1)) AS position,
  low, high FROM ends),
windows AS (SELECT position, least(low + position * {step}, high - {width}) AS start_us FROM places)
SELECT position, start_us, start_us + {width} AS end_us, count(us) AS rows
FROM windows LEFT JOIN times ON us BETWEEN start_us AND start_us + {width} GROUP BY ALL"""


@query("window_profile", PROFILE.format(width=21_600_000_000, step=1_800_000_000))
def profile_overlapping(spark, sf_dir):
    return window_profile(event_log(spark, sf_dir), timedelta(hours=6), timedelta(minutes=30))


@query("window_profile_gaps", PROFILE.format(width=3_600_000_000, step=10_000_000_000))
def profile_gaps(spark, sf_dir):
    return window_profile(event_log(spark, sf_dir), timedelta(hours=1), timedelta(seconds=10_000))


@query("window_edges", """WITH ends AS (SELECT min(ts) AS low, max(ts) AS high FROM events),
row_time AS (SELECT ts AS t FROM events WHERE event_id = 499), shown AS (
  SELECT 'row' AS name, t AS s, high AS e FROM ends, row_time
  UNION ALL SELECT 'text', TIMESTAMP '2024-01-05 06:00:00', TIMESTAMP '2024-01-06 07:30:15' FROM ends
  UNION ALL SELECT 'clamped', low, high FROM ends
  UNION ALL SELECT 'shifted', TIMESTAMP '2024-01-05 18:00:00', TIMESTAMP '2024-01-06 19:30:15' FROM ends
  UNION ALL SELECT 'shifted to end', high - INTERVAL '25 hours 30 minutes 15 seconds', high FROM ends
  UNION ALL SELECT 'wider right', TIMESTAMP '2024-01-05 06:00:00', TIMESTAMP '2024-01-08 07:30:15' FROM ends
  UNION ALL SELECT 'wider left', low, TIMESTAMP '2024-01-06 07:30:15' FROM ends
  UNION ALL SELECT 'reset', low, high FROM ends
  UNION ALL SELECT 'off', low, high FROM ends)
SELECT name, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM shown JOIN events ON ts BETWEEN s AND e GROUP BY name""")
def window_edges(spark, sf_dir):
    log = event_log(spark, sf_dir)
    limits = bounds(log)
    typed = window_from_text(limits, "2024-01-05 06:00", "2024-01-06 07:30:15")
    chosen = {
        "row": window_from_row(log, None, 500, "start"),
        "text": typed,
        "clamped": window_from_text(limits, "1999-01-01 00:00", "2030-01-01 00:00:00"),
        "shifted": shift_window(typed, limits, timedelta(hours=12)),
        "shifted to end": shift_window(typed, limits, timedelta(days=400)),
        "wider right": expand_window(typed, limits, timedelta(days=2)),
        "wider left": expand_window(typed, limits, -timedelta(days=60)),
        "reset": reset_window(limits, keep_enabled=True),
        "off": reset_window(limits, keep_enabled=False),
    }
    counts = []
    for name, window in chosen.items():
        shown = in_window(log, window)
        counts.append(F.struct(
            F.lit(name).alias("name"), F.count_if(shown).alias("rows"),
            F.sum(F.when(shown, F.col("line_no") - 1)).alias("ids")))
    return log.agg(F.array(*counts).alias("windows")).select(F.inline("windows"))


# --- series -----------------------------------------------------------------------------------

WIDTH = 240


def readings(spark, sf_dir):
    """Event values per type over whole seconds, as text cells; some are unusable."""
    events = read(spark, sf_dir, "events")
    n = F.col("event_id") % 50
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string")
    return events.select(
        F.when(n == 1, "soon").otherwise(second).alias("timestamp"),
        F.when(F.col("event_type") == "view", " ").otherwise(F.concat(F.lit(" "), "event_type")).alias("key"),
        F.when(n == 2, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        (F.col("event_id") + 1).alias("line_no"),
    )


POINTS = """points AS (SELECT CASE WHEN event_type = 'view' THEN '(empty)' ELSE event_type END AS series,
    epoch_us(ts) // 1000000 AS ts, value AS val, event_id AS ord FROM events WHERE event_id % 50 NOT IN (1, 2)),
ends AS (SELECT min(ts) AS low, max(ts) - min(ts) AS span FROM points),
placed AS (SELECT *, ((ts - low) * {steps} + span - 1) // span AS x FROM points, ends),
buckets AS (SELECT series, x, {agg} AS value, arg_max(val, ts * 1000000 + ord) AS held FROM placed GROUP BY series, x),
grid AS (SELECT series, x, low + span * x // {steps} AS bucket_ts
  FROM (SELECT DISTINCT series FROM points), (SELECT unnest(range({width})) AS x), ends),
filled AS (SELECT series, x, bucket_ts, value, held FROM grid LEFT JOIN buckets USING (series, x))"""

AGGREGATES = {
    "last": "arg_max(val, ts * 1000000 + ord)", "avg": "avg(val)", "max": "max(val)", "min": "min(val)",
}


def points_sql(agg: str, width: int = WIDTH) -> str:
    return POINTS.format(agg=AGGREGATES[agg], width=width, steps=width - 1)


def series_sql(agg: str) -> str:
    return f"WITH {points_sql(agg)} SELECT series, x, bucket_ts, round(value, 9) AS value FROM filled"


def bucketed(spark, sf_dir, agg, fill="none", width=WIDTH):
    return bucket_series(
        series_points(readings(spark, sf_dir), "timestamp", "key", "value"), width, agg, fill
    )


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


SERIES_LIMITS = (2, 50)


@query("series_limit", f"""WITH {points_sql('last')},
kinds AS (SELECT series, min(ord) AS seen FROM points GROUP BY series),
limits(most) AS (VALUES {", ".join(f"({n})" for n in SERIES_LIMITS)}),
told AS (SELECT most, (SELECT count(*) FROM kinds) > most AS refused FROM limits)
SELECT most, refused, CASE WHEN refused THEN NULL ELSE (SELECT string_agg(series, ',' ORDER BY seen) FROM kinds) END AS series,
  CASE WHEN refused THEN NULL ELSE (SELECT max(ts) - min(ts) FROM points) END AS span
FROM told""")
def series_limit(spark, sf_dir):
    """What a limit on the number of series says: refused, or the series in order and their range."""
    points, told = series_points(readings(spark, sf_dir), "timestamp", "key", "value"), []
    for most in SERIES_LIMITS:
        try:
            found = series_extent(points, max_keys=most)
            told.append((most, False, ",".join(found.series), found.high - found.low))
        except TooManySeries:
            told.append((most, True, None, None))
    return spark.createDataFrame(told, "most int, refused boolean, series string, span long")


@query("series_points", f"WITH {points_sql('last')} SELECT series, ts, val, ord + 1 AS ord FROM points")
def points(spark, sf_dir):
    return series_points(readings(spark, sf_dir), "timestamp", "key", "value")


for _agg in AGGREGATES:
    def _bucketed(spark, sf_dir, agg=_agg):
        return rounded(bucketed(spark, sf_dir, agg), "value")

    query(f"series_{_agg}", series_sql(_agg))(_bucketed)


@query("series_extent", f"""WITH {points_sql('last')}
SELECT series, min(ord) + 1 AS seen, any_value(low) AS low, any_value(low + span) AS high FROM points, ends GROUP BY series""")
def extent(spark, sf_dir):
    found = series_points(readings(spark, sf_dir), "timestamp", "key", "value")
    limits = series_extent(found)
    return found.groupBy("series").agg(F.min("ord").alias("seen")).withColumns(
        {"low": F.lit(limits.low), "high": F.lit(limits.high)}
    )


HOLD_WIDTH = 6000


@query("series_hold", f"""WITH {points_sql('avg', HOLD_WIDTH)}
SELECT series, x, bucket_ts, round(coalesce(value, last_value(held IGNORE NULLS) OVER (PARTITION BY series ORDER BY x
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS value FROM filled""")
def series_hold(spark, sf_dir):
    return rounded(bucketed(spark, sf_dir, "avg", "hold", HOLD_WIDTH), "value")


def normalised_sql(scale: str, over: str) -> str:
    return f"""WITH {points_sql('last')}, s AS (SELECT series, x, bucket_ts, {scale} AS value FROM filled),
r AS (SELECT *, min(value) OVER ({over}) AS low, max(value) OVER ({over}) AS high FROM s)
SELECT series, x, bucket_ts, round(value, 9) AS value, round(CASE WHEN value IS NULL THEN NULL
  WHEN high = low THEN 0.5 ELSE (value - low) / (high - low) END, 9) AS y FROM r"""


@query("series_overlay", normalised_sql("ln(1 + greatest(value, 0))", ""))
def series_overlay(spark, sf_dir):
    scaled = scale_series(bucketed(spark, sf_dir, "last"), "log1p")
    return rounded(normalise_series(scaled, "overlay"), "value", "y")


@query("series_split", normalised_sql("sign(value) * ln(1 + abs(value))", "PARTITION BY series"))
def series_split(spark, sf_dir):
    scaled = scale_series(bucketed(spark, sf_dir, "last"), "symlog")
    return rounded(normalise_series(scaled, "split"), "value", "y")


@query("bucket_of_row", f"""WITH {points_sql('last')}
SELECT event_id + 1 AS line_no, CASE WHEN event_id % 50 = 1 THEN 0 ELSE CAST(ceil(CAST(
  least(greatest(epoch_us(e.ts) // 1000000, low), low + span) - low AS DOUBLE)
  / CAST(span AS DOUBLE) * {WIDTH - 1}.0::DOUBLE) AS BIGINT) END AS x
FROM events e, ends""")
def bucket_of_row(spark, sf_dir):
    cells = readings(spark, sf_dir)
    limits = series_extent(series_points(cells, "timestamp", "key", "value"))
    ts = cells.select("line_no", F.col("timestamp").try_cast("bigint").alias("ts"))
    return ts.select("line_no", bucket_of(F.col("ts"), limits, WIDTH).alias("x"))
