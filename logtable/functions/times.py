"""Timestamps in log text.

All results are TIMESTAMP instants; the session time zone plays no part.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from logtable.functions.text import cell, gtrim, parse_int

# Zone abbreviations and their offsets. Unknown ones count as UTC.
DEFAULT_ZONES = {"UTC": "+00:00", "GMT": "+00:00", "BST": "+01:00"}

# The accepted layouts.
CLOCK = r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})((?:[.,][0-9]{1,9})?)[0-9]*"
LOG_LAYOUT = (
    r"^(?i:Mon|Tue|Wed|Thu|Fri|Sat|Sun) +(?i:(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)) +"
    r"([0-9]{2}) +" + CLOCK + r" +([A-Z]{3}|[A-Z]{3}T|WITA|[A-Z]{4}T) +([0-9]{4})\z"
)
DATE_TIME_LAYOUT = r"^([0-9]{4})-([0-9]{2})-([0-9]{2}) +" + CLOCK + r"\z"
RFC3339_LAYOUT = (
    r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T" + CLOCK + r"(Z|[+-][0-9]{2}:[0-9]{2})\z"
)


def parse_epoch(value: Column) -> Column:
    """A BIGINT epoch whose unit follows from its size: ns, µs, ms or s."""
    size = F.when(value < 0, -(value + 1)).otherwise(value)
    micros = F.floor((value - F.pmod(value, F.lit(1000))) / F.lit(1000).cast("decimal(20,0)"))
    return (
        F.when(size >= 10**17, F.timestamp_micros(micros.cast("bigint")))
        .when(size >= 10**14, F.timestamp_micros(value))
        .when(size >= 10**11, F.timestamp_millis(value))
        .otherwise(F.timestamp_seconds(value))
    )


def _canonical(text: Column, layout: str, form: str) -> Column:
    return F.replace(F.regexp_replace(text, layout, form), F.lit(","), F.lit("."))


def _log_layout(text: Column, zones: Mapping[str, str]) -> Column:
    zone = F.regexp_extract(text, LOG_LAYOUT, 7)
    offset = F.lit("+00:00")
    for name, value in zones.items():
        offset = F.when(zone == name, F.lit(value)).otherwise(offset)
    plain = F.initcap(_canonical(text, LOG_LAYOUT, "$8 $1 $2 $3:$4:$5$6"))
    return F.when(
        text.rlike(LOG_LAYOUT),
        F.try_to_timestamp(F.concat(plain, offset), F.lit("yyyy MMM dd H:mm:ss[.SSSSSSSSS]XXX")),
    )


def _date_time(text: Column) -> Column:
    plain = _canonical(text, DATE_TIME_LAYOUT, "$1-$2-$3 $4:$5:$6$7+00:00")
    return F.when(text.rlike(DATE_TIME_LAYOUT), plain.try_cast("timestamp"))


def _rfc3339(text: Column) -> Column:
    plain = _canonical(text, RFC3339_LAYOUT, "$1-$2-$3T$4:$5:$6$7$8")
    return F.when(text.rlike(RFC3339_LAYOUT), plain.try_cast("timestamp"))


def parse_log_ts(col: Column | str, zones: Mapping[str, str] = DEFAULT_ZONES) -> Column:
    """The instant a cell names, or NULL.

    Tried in order: epoch number; ``Mon Jan 02 15:04:05 MST 2006``;
    ``2006-01-02 15:04:05``; RFC 3339; then the two middle forms again without
    the text from the last colon on.
    """
    text = gtrim(cell(col))
    shorter = gtrim(F.regexp_replace(text, r":[^:]*\z", ""))
    epoch = parse_int(text)
    layouts = F.coalesce(
        _log_layout(text, zones),
        _date_time(text),
        _rfc3339(text),
        _log_layout(shorter, zones),
        _date_time(shorter),
    )
    return F.when(epoch.isNotNull(), parse_epoch(epoch)).when(F.contains(text, F.lit(":")), layouts)


def epoch_to_date(seconds: Column, zone: str = "UTC") -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of an epoch as clocks in ``zone`` show it."""
    utc = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=seconds)
    if zone == "UTC":
        return F.date_format(utc, "yyyy-MM-dd HH:mm:ss")
    return F.date_format(
        F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "yyyy-MM-dd HH:mm:ss"
    )
