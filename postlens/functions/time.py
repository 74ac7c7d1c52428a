"""Time column functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The capture format of post times, and the display formats.
POST_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
POST_TIME_SHAPE = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,6}Z$"
PLAIN_TIME = r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?)?$"
ZONED_TIME = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)? ?(Z|UTC|[+-]\d\d:\d\d)$"
SCRAPE_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
DAY_FORMAT = "yyyy-MM-dd"
SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Bin sizes offered by the dashboard, in minutes.
BIN_MINUTES = {
    "15min": 15,
    "1H": 60,
    "3H": 180,
    "6H": 360,
    "12H": 720,
    "1D": 1440,
    "3D": 4320,
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_post_time(c: Column | str) -> Column:
    """Strict parse of a capture time literal; bad text gives null.

    The fraction (1 to 6 digits) and the closing Z are required.  The text
    before the Z is read as a wall time, so no session zone is involved.
    """
    t = _c(c)
    wall = F.regexp_replace(t, "Z$", "")
    return F.when(t.rlike(POST_TIME_SHAPE), wall.try_cast("timestamp_ntz"))


def parse_any_time(c: Column | str) -> Column:
    """J3 as the label endpoint reads times: any ISO form, with or without time, fraction or zone; else null.

    A text with a zone gives the UTC wall time, one without its own wall time; the
    session's zone takes no part in either.
    """
    t = F.trim(_c(c))
    instant = F.unix_micros(t.try_cast("timestamp"))
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(instant / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))
    return F.when(t.rlike(ZONED_TIME), utc).otherwise(F.when(t.rlike(PLAIN_TIME), t.try_cast("timestamp_ntz")))


def parse_scrape_time(c: Column | str) -> Column:
    return F.try_to_timestamp(_c(c), F.lit(SCRAPE_TIME_FORMAT)).cast("timestamp_ntz")


def cut_to_seconds(c: Column | str) -> Column:
    """A capture time cut to seconds, as capture text."""
    t = F.date_trunc("second", _c(c)).cast("timestamp_ntz")
    return F.date_format(t, SCRAPE_TIME_FORMAT)


def stamp_capture(run_time: dt.datetime) -> Column:
    """C8 for one run: the run time (a parameter, never read from the clock here)."""
    return cut_to_seconds(F.lit(run_time).cast("timestamp_ntz"))


def format_day(c: Column | str) -> Column:
    return F.date_format(_c(c), DAY_FORMAT)


def format_second(c: Column | str) -> Column:
    return F.date_format(_c(c), SECOND_FORMAT)


def combine(date: dt.date, time: dt.time) -> dt.datetime:
    """Date + time of the dashboard form."""
    return dt.datetime.combine(date, time)


def ntz(value: dt.datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def bin_start(ts: Column | str, minutes: int, origin: Column) -> Column:
    """Start of the fixed-size bin holding ``ts``; bins are laid from ``origin``.

    Timezone-free arithmetic on timestamp_ntz (origin <= ts).
    """
    t = _c(ts)
    elapsed = F.timestamp_diff("MINUTE", origin, t)
    k = F.floor(elapsed / F.lit(minutes)) * F.lit(minutes)
    return F.timestamp_add("MINUTE", k, origin)
