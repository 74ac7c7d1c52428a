"""K4 live tag counts and K5 vocabulary as increments that are added up on read.

Every micro-batch is aggregated on its own and written to its own folder
(``_batch=<id>``), overwritten if the batch is replayed.  The current value of
a group is the sum (or the minimum) over its increments.  A post counts when it
arrives, however old it is: there is no watermark and no late row, and no state
is held between batches.  Increments are folded into a snapshot now and then, so a
reader's work does not grow with the number of batches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postlens.functions.text import clean_text
from postlens.operators import topics, trends
from postlens.schemas import NTZ, S
from postlens.session import path_exists

BATCH = "_batch"
SNAPSHOTS = "_snapshots"
TREND = T.StructType([T.StructField("postTimeRaw", NTZ), T.StructField("tag", S), T.StructField("count", T.LongType())])
VOCAB = T.StructType([T.StructField("kind", S), T.StructField("level", S), T.StructField("term", S),
                      T.StructField("first_seen", NTZ), T.StructField("n_posts", T.LongType())])


def trend_increments(posts: DataFrame, freq: str = "12H", origin: dt.datetime | None = None) -> DataFrame:
    """Counts per (bin, tag) of one batch.  Multi-day bins need the origin: a
    batch does not know the first day of all data."""
    return trends.tag_trend(posts, freq, origin or trends.EPOCH)


def vocab_increments(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per (kind, level, term) of one batch: the first time it was answered and how many posts had it."""
    lab = topics.label_posts(posts.withColumn("tweetText", clean_text("tweetText")), rules, keep=["post_id", "postTimeRaw"])
    parts = [lab.select("kind", F.lit(level).alias("level"), F.explode(level).alias("term"), "postTimeRaw") for level in ("topic", "subtopic")]
    return parts[0].unionByName(parts[1]).groupBy("kind", "level", "term").agg(
        F.min("postTimeRaw").alias("first_seen"), F.count(F.lit(1)).alias("n_posts"))


def start_increments(stream: DataFrame, of_batch: Callable[[DataFrame], DataFrame], table_path: str, checkpoint: str,
                     trigger: dict | None = None, compact_every: int | None = None, schema: T.StructType | None = None,
                     keys: Sequence[str] = ()) -> StreamingQuery:
    """Write ``of_batch`` of every micro-batch; a replayed batch replaces its own increments.

    ``compact_every`` (with the table's ``schema`` and ``keys``): every so many batches
    the earlier ones are folded into the snapshot, see ``compact``.
    """
    spark = stream.sparkSession

    def fn(df: DataFrame, epoch_id: int) -> None:
        if epoch_id <= snapshot(spark, table_path)[1]:
            return  # a replay of what the snapshot holds already
        of_batch(df).write.mode("overwrite").parquet(f"{table_path}/{BATCH}={epoch_id}")
        if compact_every and epoch_id % compact_every == 0:
            compact(spark, table_path, schema, keys, epoch_id - 1)  # this batch is not committed yet

    return (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "15 minutes"})).start())


def _added(df: DataFrame, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    values = [f for f in schema.fields if f.name not in keys]
    return df.groupBy(*keys).agg(*[(F.min if f.dataType == NTZ else F.sum)(f.name).alias(f.name) for f in values])


def snapshot(spark: SparkSession, table_path: str) -> tuple[str | None, int]:
    """(folder, last batch in it) of the newest snapshot that was written to its end; (None, -1) without one."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/{SNAPSHOTS}")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None, -1
    named = {int(st.getPath().getName().split("=")[1]): st.getPath().toString() for st in fs.listStatus(top)}
    whole = [n for n, path in named.items() if path_exists(spark, f"{path}/_SUCCESS")]
    return (named[max(whole)], max(whole)) if whole else (None, -1)


def _increments(spark: SparkSession, table_path: str, schema: T.StructType, after: int, upto: int | None = None) -> list[DataFrame]:
    """The increments of batches beyond ``after``, if there are any; folders of others are not listed."""
    top = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = [int(st.getPath().getName().split("=")[1]) for st in (fs.listStatus(top) if fs.exists(top) else []) if st.getPath().getName().startswith(f"{BATCH}=")]
    own = sorted(b for b in batches if b > after and (upto is None or b <= upto))
    return [spark.read.schema(schema).parquet(*[f"{table_path}/{BATCH}={b}" for b in own])] if own else []


def compact(spark: SparkSession, table_path: str, schema: T.StructType, keys: Sequence[str], upto: int) -> None:
    """Fold the increments of batches up to ``upto`` and the snapshot before into a new snapshot.

    The new one counts from the moment its ``_SUCCESS`` file is there: that is the swap.
    Until then readers use the old one and its increments.  After it, increments that it
    holds and the snapshots before the last one are removed; a reader that listed
    them before still has the last snapshot's predecessor.
    """
    before, last = snapshot(spark, table_path)
    if upto <= last:
        return
    parts = _increments(spark, table_path, schema, last, upto) + ([spark.read.schema(schema).parquet(before)] if before else [])
    if not parts:
        return
    both = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    # As few files as the groups need: one for a small table, more by size.
    _added(both, schema, keys).hint("rebalance").write.mode("overwrite").parquet(f"{table_path}/{SNAPSHOTS}/upto={upto}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(table_path).getFileSystem(spark._jsc.hadoopConfiguration())
    for st in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(table_path)):
        name = st.getPath().getName()
        if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) <= last:  # one snapshot behind: a reader may still be at them
            fs.delete(st.getPath(), True)
    for st in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/{SNAPSHOTS}")):
        if int(st.getPath().getName().split("=")[1]) < last:
            fs.delete(st.getPath(), True)


def totals(spark: SparkSession, table_path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The current value per group: counts summed, times at their minimum; the snapshot and the increments after it are read."""
    folder, last = snapshot(spark, table_path)
    parts = _increments(spark, table_path, schema, last) + ([spark.read.schema(schema).parquet(folder)] if folder else [])
    if not parts:
        return spark.createDataFrame([], schema)
    return _added(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0], schema, keys)
