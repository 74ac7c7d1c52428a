"""Explicit schemas: tables are never read with inference."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
NTZ = T.TimestampNTZType()

# Raw captured post: one record per post, scrapeTime still text.
RAW = T.StructType([
    T.StructField("category", S),
    T.StructField("tag", S),
    T.StructField("username", S),
    T.StructField("tweetText", S),
    T.StructField("postTimeRaw", NTZ),
    T.StructField("scrapeTime", S),
    T.StructField("tweet_link", S),
])

# Typed posts; year/month/day are the store's partition columns.
POSTS = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("category", S),
    T.StructField("tag", S),
    T.StructField("username", S),
    T.StructField("tweetText", S),
    T.StructField("postTimeRaw", NTZ),
    T.StructField("scrapeTime", NTZ),
    T.StructField("tweet_link", S),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
])

# What the posts store holds: typed posts and their ``index``.
STORED_POSTS = T.StructType(POSTS.fields[:-3] + [T.StructField("index", T.LongType())] + POSTS.fields[-3:])

# The exported snapshot as published: names and types, in order.
EXPORT = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("category", S),
    T.StructField("tag", S),
    T.StructField("username", S),
    T.StructField("tweetText", S),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("scrapeTime", NTZ),
    T.StructField("tweet_link", S),
    T.StructField("index", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
])

STORED_COLUMNS = [f.name for f in STORED_POSTS.fields]
POST_COLUMNS = [f.name for f in POSTS.fields]
PARTITION_COLUMNS = ["year", "month", "day"]

STR_ARRAY = T.ArrayType(S)

# Topics (FAQ rows) after labelling.
TOPICS = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("tweetText", S),
    T.StructField("topic", STR_ARRAY),
    T.StructField("subtopic", STR_ARRAY),
    T.StructField("tag", S),
    T.StructField("username", S),
    T.StructField("postTimeRaw", NTZ),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
])

# One labelled item in a model response.
RESPONSE_ITEM = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("text", S),
    T.StructField("topic", STR_ARRAY),
    T.StructField("subtopic", STR_ARRAY),
])

RESPONSE = T.StructType([
    T.StructField("issue", T.ArrayType(RESPONSE_ITEM)),
    T.StructField("faq", T.ArrayType(RESPONSE_ITEM)),
])

# Fingerprint state: one row per ingested batch, appended, never rewritten.
FINGERPRINT = T.StructType([
    T.StructField("source", S),
    T.StructField("batch_id", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("x", T.LongType()),
    T.StructField("s", S),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", NTZ),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", S),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", S),
])

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", S),
    T.StructField("lang", S),
    T.StructField("source", S),
    T.StructField("n_chars", T.LongType()),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", S),
    T.StructField("html", S),
])

REGION = T.StructType([
    T.StructField("r_regionkey", T.IntegerType()),
    T.StructField("r_name", S),
])

NATION = T.StructType([
    T.StructField("n_nationkey", T.IntegerType()),
    T.StructField("n_name", S),
    T.StructField("n_regionkey", T.IntegerType()),
])

TABLE_SCHEMAS = {
    "events": EVENTS,
    "documents": DOCUMENTS,
    "pages": PAGES,
    "region": REGION,
    "nation": NATION,
}
