"""Typing, cleaning and data-quality queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import text as tx
from postlens.functions import time as tm
from postlens.operators import clean, quality
from postlens.plans import dashboard
from postlens.plans.oracle import with_views
from postlens.plans.registry import query
from postlens.sources import fixtures

# Fixed parameter: "now" for the time-range rule, passed in for determinism.
AS_OF = dt.datetime(2025, 1, 1)
_AS_OF_SQL = f"TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'"
_POST_COLS = ["post_id", "category", "tag", "username", "tweetText", "postTimeRaw", "scrapeTime",
              "tweet_link", "year", "month", "day"]


@query("type_posts", with_views("""
SELECT category, tag, username, tweetText, postTimeRaw,
       date_trunc('second', scrapeTime) AS scrapeTime, tweet_link, post_id,
       CAST(year(postTimeRaw) AS INT) AS year, CAST(month(postTimeRaw) AS INT) AS month,
       CAST(day(postTimeRaw) AS INT) AS day
FROM posts""", "posts"))
def type_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.type_posts(fixtures.posts_raw(spark, sf_dir))


@query("clean_text", with_views("""
SELECT post_id, regexp_replace(regexp_replace(tweetText, '#\\S+', '', 'g'), '^\\s+|\\s+$', '', 'g') AS tweetText
FROM posts""", "posts"))
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.posts(spark, sf_dir)
    return p.select("post_id", tx.clean_text("tweetText").alias("tweetText"))


@query("clean_posts", with_views("SELECT * FROM posts_clean", "posts_clean"))
def clean_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_posts(fixtures.posts(spark, sf_dir))


@query("display_table", with_views(
    f"SELECT post_id, category, tag, username, tweetText, postTimeRaw, tweet_link FROM posts WHERE "
    f"{dashboard._SLICE_SQL}", "posts"))
def display_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.display_table(dashboard.sliced_posts(spark, sf_dir))


_VIOLATIONS_SQL = f"""
list_filter([
  CASE WHEN username IS NULL THEN 'username:required' END,
  CASE WHEN tweetText IS NULL THEN 'tweetText:required' END,
  CASE WHEN scrapeTime IS NULL THEN 'scrapeTime:required' END,
  CASE WHEN tag IS NULL THEN 'tag:required' END,
  CASE WHEN postTimeRaw IS NULL THEN 'postTimeRaw:required' END,
  CASE WHEN year IS NULL THEN 'year:required' END,
  CASE WHEN month IS NULL THEN 'month:required' END,
  CASE WHEN day IS NULL THEN 'day:required' END,
  CASE WHEN year(postTimeRaw) < 2020 OR postTimeRaw > {_AS_OF_SQL} THEN 'postTimeRaw:range' END,
  CASE WHEN NOT (month BETWEEN 1 AND 12) THEN 'month:range' END,
  CASE WHEN NOT (day BETWEEN 1 AND 31) THEN 'day:range' END
], lambda x: x IS NOT NULL)"""


@query("row_violations", with_views(f"""
SELECT post_id, violations FROM (SELECT post_id, {_VIOLATIONS_SQL} AS violations FROM posts_dirty)
WHERE len(violations) > 0""", "posts_dirty"))
def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_violations(fixtures.posts_dirty(spark, sf_dir), AS_OF)


_NULLS_SQL = ", ".join(f"CAST(count(*) - count({c}) AS BIGINT) AS nulls_{c}" for c in _POST_COLS)
_NULLS_TOTAL = " + ".join(f"(count(*) - count({c}))" for c in _POST_COLS)


@query("null_counts", with_views(
    f"SELECT {_NULLS_SQL}, CAST({_NULLS_TOTAL} AS BIGINT) AS nulls_total FROM posts_dirty", "posts_dirty"))
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_counts(fixtures.posts_dirty(spark, sf_dir))


def _dups_cte(view: str) -> tuple[str, str]:
    return ("d", f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM "
                 f"(SELECT {', '.join(_POST_COLS)}, count(*) AS n FROM {view} GROUP BY ALL)")


@query("duplicate_rows", with_views("SELECT duplicates FROM d", "posts_dirty", ctes=[_dups_cte("posts_dirty")]))
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rows(fixtures.posts_dirty(spark, sf_dir))


def _report_ctes(view: str, full: bool) -> list[tuple[str, str]]:
    a = ("a", f"""SELECT CAST(count(*) AS BIGINT) AS records,
  CAST(coalesce((epoch_us(max(postTimeRaw)) - epoch_us(min(postTimeRaw))) // 1000000, -1) AS BIGINT) AS span,
  CAST({_NULLS_TOTAL} AS BIGINT) AS missing FROM {view}""")
    parts = []
    if full:
        parts.append("SELECT 'record_count' AS \"check\", records AS value, records >= 1000 AS passed FROM a")
        parts.append("SELECT 'time_span_seconds' AS \"check\", span AS value, span >= 86400 AS passed FROM a")
    parts.append("SELECT 'missing_values' AS \"check\", missing AS value, missing = 0 AS passed FROM a")
    parts.append("SELECT 'untyped_columns' AS \"check\", CAST(0 AS BIGINT) AS value, true AS passed")
    parts.append("SELECT 'duplicate_rows' AS \"check\", duplicates AS value, duplicates = 0 AS passed FROM d")
    return [a, _dups_cte(view), ("r", "\nUNION ALL\n".join(parts))]


@query("quality_report", with_views("SELECT * FROM r", "posts_dirty", ctes=_report_ctes("posts_dirty", True)))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(fixtures.posts_dirty(spark, sf_dir), "full")


@query("quality_incremental", with_views("SELECT * FROM r", "posts_new", ctes=_report_ctes("posts_new", False)))
def quality_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(fixtures.posts_new(spark, sf_dir), "incremental")


@query("untyped_columns", with_views("""
SELECT 'untyped_columns' AS "check", CAST(2 AS BIGINT) AS value, false AS passed""", "posts"))
def untyped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 on a table that fails it: a binary and a void column beside the posts'."""
    p = fixtures.posts(spark, sf_dir).withColumns({"raw": F.col("tweetText").cast("binary"), "nothing": F.lit(None)})
    return quality.quality_report(p, "full").filter("check = 'untyped_columns'")


@query("quality_verdict", with_views(f"""
SELECT invalid_rows, failed_checks, (invalid_rows = 0 AND failed_checks = 0) AS valid FROM (
  SELECT CAST((SELECT count(*) FROM posts_dirty WHERE len({_VIOLATIONS_SQL}) > 0) AS BIGINT) AS invalid_rows,
         CAST((SELECT sum(CASE WHEN passed THEN 0 ELSE 1 END) FROM r) AS BIGINT) AS failed_checks)""",
    "posts_dirty", ctes=_report_ctes("posts_dirty", True)))
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdict(fixtures.posts_dirty(spark, sf_dir), AS_OF, "full")


_RAW_TIME_SQL = """strftime(postTimeRaw, '%Y-%m-%dT%H:%M:%S.') || substr('120456', 1, CAST(post_id % 7 AS INT)) || 'Z'"""


@query("parse_time", with_views(f"""
SELECT post_id, raw, CASE WHEN raw LIKE '%T%.%Z' AND raw NOT LIKE '%.Z' THEN CAST(rtrim(raw, 'Z') AS TIMESTAMP) END AS parsed FROM (
  SELECT post_id, CASE WHEN tag = '#error' THEN replace({_RAW_TIME_SQL}, 'T', ' ') ELSE {_RAW_TIME_SQL} END AS raw
  FROM posts)""", "posts"))
def parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions of 1 to 6 digits are read; none at all (post_id % 7 = 0) or a blank for the T is bad text."""
    p = fixtures.posts(spark, sf_dir)
    digits = F.substr(F.lit("120456"), F.lit(1), (F.col("post_id") % 7).cast("int"))
    text = F.concat(F.date_format("postTimeRaw", "yyyy-MM-dd'T'HH:mm:ss."), digits, F.lit("Z"))
    raw = F.when(F.col("tag") == "#error", F.replace(text, F.lit("T"), F.lit(" "))).otherwise(text)
    return p.select("post_id", raw.alias("raw")).withColumn("parsed", tm.parse_post_time("raw"))


@query("parse_time_lenient", with_views("""
SELECT post_id, CASE post_id % 6 WHEN 2 THEN date_trunc('day', postTimeRaw)::TIMESTAMP WHEN 3 THEN date_trunc('minute', postTimeRaw)::TIMESTAMP
                     WHEN 5 THEN NULL ELSE date_trunc('second', postTimeRaw)::TIMESTAMP END AS parsed
FROM posts""", "posts"))
def parse_time_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 as the endpoint reads times: ISO texts of five forms and one that is none."""
    t = F.col("postTimeRaw")
    form = lambda x, f: F.date_format(x, f)
    shifted = form(t + F.expr("INTERVAL 150 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("post_id") % 6
    raw = (F.when(k == 0, F.concat(form(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))).when(k == 1, F.concat(F.lit(" "), form(t, "yyyy-MM-dd HH:mm:ss")))
           .when(k == 2, form(t, "yyyy-MM-dd")).when(k == 3, form(t, "yyyy-MM-dd HH:mm")).when(k == 4, F.concat(shifted, F.lit("+02:30")))
           .otherwise(F.concat(F.lit("about "), form(t, "yyyy-MM-dd"))))
    return fixtures.posts(spark, sf_dir).select("post_id", tm.parse_any_time(raw).alias("parsed"))


@query("stamp_capture", with_views(
    "SELECT post_id, strftime(scrapeTime, '%Y-%m-%dT%H:%M:%S') AS scrapeTime FROM posts", "posts"))
def stamp_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.posts(spark, sf_dir)
    return p.select("post_id", tm.cut_to_seconds("scrapeTime").alias("scrapeTime"))


@query("format_day", with_views("SELECT post_id, strftime(postTimeRaw, '%Y-%m-%d') AS day_text FROM posts", "posts"))
def format_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.posts(spark, sf_dir)
    return p.select("post_id", tm.format_day("postTimeRaw").alias("day_text"))


@query("display_text", with_views("""
SELECT post_id, replace(replace(replace(replace(regexp_replace(tweetText, '^\\s+|\\s+$', '', 'g'),
       '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS display
FROM posts_clean""", "posts_clean"))
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clean.clean_posts(fixtures.posts(spark, sf_dir))
    return c.select("post_id", tx.display_text("tweetText").alias("display"))
