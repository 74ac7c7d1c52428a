"""Change detection and new-row selection.

Fingerprints are order-free: each row gets an MD5 of its key fields; a batch
is summarised by (count, XOR, SUM) of the first 15 hex digits.  All three are
plain aggregates with partial (map-side) steps, so they cost one pass and no
sort, and the value does not depend on partitioning or row order.  Count and
sum keep repeated rows from cancelling in the XOR.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.schemas import FINGERPRINT, STORED_POSTS
from postlens.sources import store
from postlens.sources.digests import DigestIndex
from postlens.sources.work import ROW_ID, with_row_ids, work_table

POST_KEYS = ("postTimeRaw", "username", "tweetText")
TOPIC_KEYS = ("postTimeRaw", "tweetText")
# Fixed value: the text form of times inside a fingerprint.
FP_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
# At most so many row ids, of 8 bytes, are sent to every task.
BROADCAST_IDS = 1_000_000


def row_digest(keys: Sequence[str] = POST_KEYS) -> Column:
    """MD5 hex of the key fields, each as its length, ':' and text ('-' for null).

    The lengths keep fields apart whatever they hold; a null is no text.
    """
    parts = []
    for k in keys:
        text = F.date_format(F.col(k), FP_TIME_FORMAT) if k == "postTimeRaw" else F.col(k).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat(*parts))


def fingerprint(df: DataFrame, group_cols: Sequence[str] = (), keys: Sequence[str] = POST_KEYS) -> DataFrame:
    """(n, x, s) per group (or for the whole frame)."""
    v = F.conv(F.substring(row_digest(keys), 1, 15), 16, 10).cast("long")
    d = df.select(*group_cols, v.alias("_v"))
    aggs = [
        F.count(F.lit(1)).cast("long").alias("n"),
        F.coalesce(F.bit_xor("_v"), F.lit(0)).cast("long").alias("x"),
        F.coalesce(F.sum(F.col("_v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
         .cast("string").alias("s"),
    ]
    if group_cols:
        return d.groupBy(*group_cols).agg(*aggs)
    return d.agg(*aggs)


def change_flags(fps: DataFrame, order_col: str = "batch_id", part_col: str = "source") -> DataFrame:
    """A batch changed unless its fingerprint equals the previous batch's.

    The window runs over the fingerprint table (one row per batch), never
    over the rows themselves.
    """
    w = Window.partitionBy(part_col).orderBy(order_col)
    cur = F.struct("n", "x", "s")
    prev = F.lag(cur).over(w)
    return fps.withColumn("changed", ~F.coalesce(cur.eqNullSafe(prev), F.lit(False)))


# --- A10: fingerprint state store (append-only table) -----------------------------------------

def latest_fingerprint(spark: SparkSession, state_path: str, source: str) -> DataFrame:
    """The last committed fingerprint of ``source`` (0 or 1 row)."""
    if not store.store_exists(spark, state_path):
        return spark.createDataFrame([], FINGERPRINT)
    st = spark.read.schema(FINGERPRINT).parquet(state_path).filter(F.col("source") == source)
    return st.agg(F.max_by(F.struct("batch_id", "n", "x", "s"), "batch_id").alias("l")).select("l.*") \
        .filter(F.col("batch_id").isNotNull())


def batch_changed(spark: SparkSession, batch: DataFrame, state_path: str, source: str) -> tuple[bool, dict]:
    """G4 against the state store: returns (changed, fingerprint row as dict).

    Only two one-row results reach the driver.
    """
    fp = fingerprint(batch).first().asDict()
    last = latest_fingerprint(spark, state_path, source).first()
    if last is None:
        return True, fp
    same = (last["n"], last["x"], last["s"]) == (fp["n"], fp["x"], fp["s"])
    return (not same), fp


def commit_fingerprint(spark: SparkSession, state_path: str, source: str, batch_id: int, fp: dict) -> None:
    """Append the batch's fingerprint; called last, after the data is stored."""
    row = [(source, int(batch_id), int(fp["n"]), int(fp["x"]), str(fp["s"]))]
    spark.createDataFrame(row, FINGERPRINT).coalesce(1).write.mode("append").parquet(state_path)


# --- E1 / E2: rows of a batch that the store does not hold -------------------------------------

def time_bounds(batch: DataFrame) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Min and max post time of a batch (one small row to the driver)."""
    r = batch.agg(F.min("postTimeRaw").alias("lo"), F.max("postTimeRaw").alias("hi")).first()
    return r["lo"], r["hi"]


def restrict_store(stored: DataFrame, lo, hi) -> DataFrame:
    """Only stored rows whose time lies in the batch's range can match;
    rows with a null time can match null-time batch rows, so they stay."""
    if lo is None:
        return stored.filter(F.col("postTimeRaw").isNull())
    t = F.col("postTimeRaw")
    return stored.filter(t.between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")) | t.isNull())


def new_rows(batch: DataFrame, stored: DataFrame, keys: Sequence[str] = POST_KEYS,
             restrict: bool = True) -> DataFrame:
    """Batch rows with no stored row equal on ``keys`` (nulls equal).

    Repeats inside the batch are kept (bag difference, as a left merge does).
    The join is on one 16-byte digest of the keys, and the store side is made
    distinct first (map-side): a key that fills a third of the store is one row.
    """
    if restrict:
        # Read twice (bounds, join), and a union is planned once this way.
        batch = work_table(batch, "batch")
        lo, hi = time_bounds(batch)
        stored = restrict_store(stored, lo, hi)
    known = stored.select(F.unhex(row_digest(keys)).alias("_known")).distinct()
    return (batch.withColumn("_digest", F.unhex(row_digest(keys)))
            .join(known, F.col("_digest") == F.col("_known"), "left_anti").drop("_digest"))


def digest_index(spark: SparkSession, store_path: str, keys: Sequence[str] = POST_KEYS, schema=None) -> DigestIndex:
    return DigestIndex(spark, store_path, schema or STORED_POSTS, keys, F.unhex(row_digest(keys)))


def new_rows_of(spark: SparkSession, batch: DataFrame, store_path: str, keys: Sequence[str] = POST_KEYS, schema=None) -> DataFrame:
    """E1/E2/I3 against a store: as ``new_rows``, but reading the store's digest index instead of its rows.

    The index is not shuffled (buckets of the digest), its days outside the batch's are skipped.
    """
    batch, known = _beside_index(spark, batch, store_path, keys, schema)
    return batch.join(known, F.col("_digest") == F.col("digest"), "left_anti").drop("_digest", ROW_ID)


def _beside_index(spark: SparkSession, batch: DataFrame, store_path: str, keys: Sequence[str], schema) -> tuple[DataFrame, DataFrame]:
    """The batch as a work table with digests and row ids, and the digests that the store's index has of its days."""
    index = digest_index(spark, store_path, keys, schema)
    index.catch_up()
    batch = with_row_ids(batch.withColumn("_digest", F.unhex(row_digest(keys))), "batch")  # read twice: bounds, then the anti-join
    lo, hi = time_bounds(batch)
    days = (None, None) if lo is None else [d.year * 10000 + d.month * 100 + d.day for d in (lo, hi)]
    return batch, index.known(*days)


def append_new(spark: SparkSession, batch: DataFrame, store_path: str, keys: Sequence[str] = POST_KEYS,
               schema=None) -> int:
    """Append only rows the store does not hold; returns rows appended.

    Of the store, only its digest index is read.  Re-running the same batch
    appends nothing, which makes the step safe to retry after a lost executor
    or a failed job: what a failed append left is indexed before the next look.
    """
    schema = schema or STORED_POSTS
    fresh = batch
    if store.store_exists(spark, store_path):  # which rows are new is told by digests and ids, no text is moved for it
        batch, known = _beside_index(spark, batch, store_path, keys, schema)
        ids = work_table(batch.select(ROW_ID, "_digest").join(known, F.col("_digest") == F.col("digest"), "left_anti").select(ROW_ID), "new-ids")
        n = ids.count()
        if not n:
            return 0
        fresh = batch.join(ids.hint("broadcast" if n <= BROADCAST_IDS else "shuffle_hash"), ROW_ID, "left_semi")
    added = store.write_audited(fresh.select(*[f.name for f in schema.fields]), store_path, "append", gather=True)
    if added:
        digest_index(spark, store_path, keys, schema).catch_up()
    return added
