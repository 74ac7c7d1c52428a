"""Dashboard slices and time trends."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.time import BIN_MINUTES, bin_start, format_second, ntz

EPOCH = dt.datetime(1970, 1, 1)


def _yyyymmdd(d: dt.date) -> int:
    return d.year * 10000 + d.month * 100 + d.day


def day_range_predicate(start: dt.datetime, end: dt.datetime):
    """A predicate on the partition columns only, so the scan prunes days.

    Integer arithmetic instead of make_date: invalid parts (month 13) must not
    raise under ANSI mode; they simply fall outside the range.
    """
    key = F.col("year") * 10000 + F.col("month") * 100 + F.col("day")
    return key.between(_yyyymmdd(start.date()), _yyyymmdd(end.date()))


def slice_posts(df: DataFrame, tags: Sequence[str] | None, start: dt.datetime | None,
                end: dt.datetime | None, prune_days: bool = False) -> DataFrame:
    """D1 + D2: tag membership and an inclusive time range.

    ``prune_days`` adds the partition-column predicate (R3); use it when ``df``
    is a scan of the partitioned store, where date parts agree with the time.
    """
    cond = F.lit(True)
    if tags is not None:
        cond = cond & F.col("tag").isin(list(tags))
    if start is not None:
        cond = cond & (F.col("postTimeRaw") >= ntz(start))
    if end is not None:
        cond = cond & (F.col("postTimeRaw") <= ntz(end))
    out = df.filter(cond)
    if prune_days and start is not None and end is not None:
        out = out.filter(day_range_predicate(start, end))
    return out


# D3: the same slice on the topics table.
slice_topics = slice_posts


def tag_trend(sliced: DataFrame, freq: str = "12H", origin: dt.datetime | None = None) -> DataFrame:
    """count per (time bin, tag); only occupied pairs appear.

    Bins start at midnight of the first day in the slice.  For sizes that
    divide a day this equals epoch alignment, so the origin subquery is only
    planned for multi-day sizes.
    """
    minutes = BIN_MINUTES[freq]
    if origin is not None:
        origin = ntz(origin)
    elif 1440 % minutes == 0:
        origin = ntz(EPOCH)
    else:
        origin = sliced.select(F.min(F.to_date("postTimeRaw")).cast("timestamp_ntz")).scalar()
    binned = sliced.select(bin_start("postTimeRaw", minutes, origin).alias("postTimeRaw"), "tag")
    return binned.groupBy("postTimeRaw", "tag").agg(F.count(F.lit(1)).alias("count"))


def trend_pivot(trend: DataFrame, tags: Sequence[str]) -> DataFrame:
    """one column per tag, zero where a bin has rows for other tags only."""
    tags = sorted(tags)
    pv = trend.groupBy("postTimeRaw").pivot("tag", tags).agg(F.sum("count"))
    return pv.na.fill(0, subset=tags)


def trend_series(pivot: DataFrame, tags: Sequence[str]) -> DataFrame:
    """per tag, the time axis as text and the aligned values, sorted by time.

    The zero-filled grid comes from unpivoting the pivot (no cross join).
    A series has one entry per occupied bin of the slice: its length is the
    chart's x axis, bounded by span / bin size, not by the row count.
    """
    tags = sorted(tags)
    long = pivot.unpivot("postTimeRaw", tags, "tag", "count")
    g = long.groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("postTimeRaw", "count"))).alias("pts"))
    return g.select(
        "tag",
        F.transform("pts", lambda p: format_second(p["postTimeRaw"])).alias("x"),
        F.transform("pts", lambda p: p["count"]).alias("data"),
    )


def date_bounds(df: DataFrame) -> DataFrame:
    """first and last day with posts."""
    return df.agg(F.min("postTimeRaw").cast("date").alias("min_date"),
                  F.max("postTimeRaw").cast("date").alias("max_date"))


def distinct_tags(df: DataFrame) -> DataFrame:
    """F8 / I2."""
    return df.select("tag").distinct()
