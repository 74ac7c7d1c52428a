"""Term counts, top subtopics and drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.ingest import row_digest
from postlens.operators.topics import stop_words

TOP_K = 10


def explode_terms(topics: DataFrame, level: str = "subtopic") -> DataFrame:
    """One row per list entry (empty lists give no row; null terms dropped)."""
    return topics.select(F.explode(F.col(level)).alias("term")).filter(F.col("term").isNotNull())


def term_counts(topics: DataFrame, level: str = "subtopic", remove_stop: bool = True) -> DataFrame:
    """how often each term occurs, stop words (tag pieces) excluded.

    E5: the stop words are an anti-join; Spark broadcasts them or not by their
    size.  Counting aggregates map-side, so a term held by a third of all rows
    is pre-summed in every task.
    """
    terms = explode_terms(topics, level)
    if remove_stop:
        words = stop_words(topics)
        terms = terms.join(words.select(F.col("word").alias("term")), "term", "left_anti")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def top_terms(topics: DataFrame, level: str = "subtopic", k: int = TOP_K) -> DataFrame:
    """F6 + H2 + H3: the k most frequent terms (ties by term); stop words kept.

    orderBy + limit plans as TakeOrderedAndProject: each task keeps its own
    top k, only k rows per task move.
    """
    counts = term_counts(topics, level, remove_stop=False)
    return counts.orderBy(F.col("count").desc(), F.col("term").asc()).limit(k) \
        .withColumnRenamed("term", level)


def drill_down(topics: DataFrame, posts: DataFrame, term: str, join_on: str = "keys") -> DataFrame:
    """D4 + C7 + E4: posts whose subtopics hold ``term``, with their links.

    ``join_on='keys'`` matches the dashboard: a left join on
    (tweetText, tag, postTimeRaw), nulls equal, repeats multiply.
    ``join_on='post_id'`` joins on the carried id instead.
    """
    hit = topics.filter(F.array_contains(F.col("subtopic"), F.lit(term)))
    if join_on == "post_id":
        hit = hit.select("post_id", "tweetText", "tag", "postTimeRaw")
        links = posts.select("post_id", "tweet_link")
        return hit.join(links, "post_id", "left").select("tweetText", "tag", "postTimeRaw", "tweet_link")
    keys = ["tweetText", "tag", "postTimeRaw"]
    # The links' side moves a 16-byte digest of the keys, no texts.
    links = posts.select(F.unhex(row_digest(keys)).alias("_p"), "tweet_link")
    hit = hit.select(*keys, F.unhex(row_digest(keys)).alias("_h"))
    return hit.join(links, F.col("_h") == F.col("_p"), "left").select(*keys, "tweet_link")
