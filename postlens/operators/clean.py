"""Typing and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import clean_text
from postlens.functions.time import parse_scrape_time
from postlens.operators.firsts import first_rows, packed_order, text_digest

TEXT_COLUMNS = ["category", "tag", "username", "tweetText", "tweet_link"]


def type_posts(raw: DataFrame) -> DataFrame:
    """A11 + C1 + C2: captured records to typed posts.

    Text columns become strings, date parts come from the post time, the
    capture stamp (text) is parsed; a bad stamp gives null, never an error.
    """
    cols = []
    for c in raw.columns:
        if c in TEXT_COLUMNS:
            cols.append(F.col(c).cast("string").alias(c))
        elif c == "scrapeTime":
            cols.append(parse_scrape_time(F.col(c)).alias(c))
        elif c == "postTimeRaw":
            cols.append(F.col(c).cast("timestamp_ntz").alias(c))
        else:
            cols.append(F.col(c))
    t = raw.select(*cols)
    ts = F.col("postTimeRaw")
    return t.withColumns({
        "year": F.year(ts).cast("int"),
        "month": F.month(ts).cast("int"),
        "day": F.dayofmonth(ts).cast("int"),
    })


def clean_posts(posts: DataFrame, dedup: bool = True) -> DataFrame:
    """G1: clean the text, keep the earliest post per cleaned text, add ``index``.

    Order: time (nulls last, as a pandas sort), then post_id.  See ``first_rows``:
    no text is sorted or aggregated.
    """
    if dedup:  # only the texts of the rows that stay are cleaned for good
        posts = first_rows(posts, text_digest(clean_text("tweetText")), packed_order(F.col("postTimeRaw"), F.col("post_id")))
    return posts.withColumn("tweetText", clean_text("tweetText")).withColumn("index", F.col("post_id") + 1)


def with_index(posts: DataFrame) -> DataFrame:
    """The stored form: the original row label + 1 as ``index``."""
    return posts.withColumn("index", (F.col("post_id") + 1).cast("long"))


def display_table(posts: DataFrame) -> DataFrame:
    """The dashboard table drops bookkeeping and partition columns."""
    # The columns the dashboard hides.
    drop = [c for c in ("index", "year", "month", "day", "scrapeTime") if c in posts.columns]
    return posts.drop(*drop)


def export_form(posts: DataFrame) -> DataFrame:
    """Rename postTimeRaw to ``timestamp``, int32 date parts, UTC-aware time.

    The naive time is a UTC wall time.  A cast alone would read it in the
    session's zone; ``from_utc_timestamp`` with that zone turns it into the
    instant, whatever the session is set to.
    """
    out = posts.withColumnRenamed("postTimeRaw", "timestamp")
    return out.withColumns({
        "timestamp": F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), F.current_timezone()),
        "year": F.col("year").cast("int"),
        "month": F.col("month").cast("int"),
        "day": F.col("day").cast("int"),
    })
