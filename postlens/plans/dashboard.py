"""Dashboard queries: slice -> trend -> pivot / series; top subtopics; terms; drill-down."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from postlens.functions.time import BIN_MINUTES, combine
from postlens.operators import trends
from postlens.plans.oracle import with_views
from postlens.plans.registry import query
from postlens.sources import fixtures

# Fixed parameters of the registered dashboard queries: four of the five tags,
# the whole month, and the form's default end time of 23:59 (so the last
# minute of the last day is outside the slice, as in the dashboard).
DASH_TAGS = ["#click", "#purchase", "#signup", "#view"]
DASH_START = combine(dt.date(2024, 1, 1), dt.time(0, 0))
DASH_END = combine(dt.date(2024, 1, 30), dt.time(23, 59))
DEFAULT_BIN = "6H"

_TAGS_SQL = ", ".join(f"'{t}'" for t in DASH_TAGS)
_SLICE_SQL = (f"tag IN ({_TAGS_SQL}) AND postTimeRaw BETWEEN TIMESTAMP '{DASH_START:%Y-%m-%d %H:%M:%S}' "
              f"AND TIMESTAMP '{DASH_END:%Y-%m-%d %H:%M:%S}'")


def sliced_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.slice_posts(fixtures.posts(spark, sf_dir), DASH_TAGS, DASH_START, DASH_END)


def tag_trend(spark: SparkSession, sf_dir: str, freq: str = DEFAULT_BIN) -> DataFrame:
    return trends.tag_trend(sliced_posts(spark, sf_dir), freq)


def _trend_ctes(freq: str) -> list[tuple[str, str]]:
    minutes = BIN_MINUTES[freq]
    if 1440 % minutes == 0:
        origin = "TIMESTAMP '1970-01-01 00:00:00'"
    else:
        origin = "(SELECT CAST(min(CAST(postTimeRaw AS DATE)) AS TIMESTAMP) FROM s)"
    return [
        ("s", f"SELECT * FROM posts WHERE {_SLICE_SQL}"),
        ("t", f"""SELECT time_bucket(INTERVAL '{minutes} minutes', postTimeRaw, {origin}) AS postTimeRaw,
       tag, count(*) AS count
FROM s GROUP BY 1, 2"""),
    ]


def _trend_sql(freq: str) -> str:
    return with_views("SELECT * FROM t", "posts", ctes=_trend_ctes(freq))


_FREQ_KEYS = {"15min": "15m", "1H": "1h", "3H": "3h", "6H": "6h", "12H": "12h", "1D": "1d", "3D": "3d"}


def _register_trends() -> None:
    for freq, suffix in _FREQ_KEYS.items():
        def fn(spark, sf_dir, _f=freq):
            return tag_trend(spark, sf_dir, _f)
        query(f"tag_trend_{suffix}", _trend_sql(freq))(fn)


_register_trends()

_PIVOT_COLS = ", ".join(f"CAST(sum(CASE WHEN tag = '{t}' THEN count ELSE 0 END) AS BIGINT) AS \"{t}\""
                        for t in sorted(DASH_TAGS))
_PIVOT_CTE = ("pv", f"SELECT postTimeRaw, {_PIVOT_COLS} FROM t GROUP BY postTimeRaw")


@query("trend_pivot", with_views("SELECT * FROM pv", "posts", ctes=_trend_ctes(DEFAULT_BIN) + [_PIVOT_CTE]))
def trend_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.trend_pivot(tag_trend(spark, sf_dir), DASH_TAGS)


_GRID_CTE = ("g", " UNION ALL ".join(
    f"SELECT postTimeRaw, '{t}' AS tag, \"{t}\" AS count FROM pv" for t in sorted(DASH_TAGS)))


@query("trend_series", with_views("""
SELECT tag,
       list(strftime(postTimeRaw, '%Y-%m-%d %H:%M:%S') ORDER BY postTimeRaw) AS x,
       list(count ORDER BY postTimeRaw) AS data
FROM g GROUP BY tag""", "posts", ctes=_trend_ctes(DEFAULT_BIN) + [_PIVOT_CTE, _GRID_CTE]))
def trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.trend_series(trend_pivot(spark, sf_dir), DASH_TAGS)


@query("date_bounds", with_views("""
SELECT CAST(min(postTimeRaw) AS DATE) AS min_date, CAST(max(postTimeRaw) AS DATE) AS max_date FROM posts""", "posts"))
def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.date_bounds(fixtures.posts(spark, sf_dir).select("postTimeRaw"))


@query("distinct_tags", with_views("SELECT DISTINCT tag FROM posts", "posts"))
def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.distinct_tags(fixtures.posts(spark, sf_dir))


@query("slice_posts", with_views(f"SELECT * FROM posts WHERE {_SLICE_SQL}", "posts"))
def slice_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced_posts(spark, sf_dir)
