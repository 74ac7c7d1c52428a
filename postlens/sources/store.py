"""The posts and topics stores: Hive-partitioned Parquet by year/month/day.

Appends only: a load adds files, never rewrites a partition.  A load is written where
its rows are: each task keeps a file open for every day it meets, so no text is
shuffled or sorted, and a day that holds most rows is written by all tasks.  Only
small appends are gathered by day first, so that they leave few files.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from postlens.schemas import PARTITION_COLUMNS, STORED_POSTS, TOPICS
from postlens.session import path_exists, settings
from postlens.operators.trends import day_range_predicate


# A load's task holds at most so many open files, each with a row group of so many bytes in memory; days
# beyond that many are sorted, as Spark does without the setting.
_OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "40"}
_ROW_GROUP_BYTES = 16 << 20


def write_partitioned(df: DataFrame, path: str, mode: str = "append", rows_per_file: int = 5_000_000, gather: bool = False) -> None:
    """A5: append rows under year=/month=/day= folders.

    Rows stay in the tasks they are in: a task writes a file for each of its days.
    ``gather``: rows are rebalanced by day first, one file for a small day, a large
    one split by size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``); it
    shuffles every text once.  ``rows_per_file`` bounds a file's rows, not a day's.
    """
    out = df.hint("rebalance", *[F.col(c) for c in PARTITION_COLUMNS]) if gather else df
    with settings(df.sparkSession, **({} if gather else _OPEN_FILES)):
        (out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", "zstd")
         .option("parquet.block.size", _ROW_GROUP_BYTES).partitionBy(*PARTITION_COLUMNS).parquet(path))


def write_audited(df: DataFrame, path: str, mode: str = "append", gather: bool = False) -> int:
    """A5 + A6: write and return the number of rows written (observed, no extra pass).

    D6: nothing to add writes nothing; an empty plan would report no metrics.
    """
    if df.isEmpty():
        return 0
    obs = Observation(f"written_{uuid.uuid4().hex[:12]}")
    write_partitioned(df.observe(obs, F.count(F.lit(1)).alias("rows")), path, mode, gather=gather)
    return int(obs.get["rows"])


def read_store(spark: SparkSession, path: str, schema: T.StructType = STORED_POSTS,
               columns: Sequence[str] | None = None) -> DataFrame:
    """A1/A2/A3: scan a store with its declared schema; ``columns`` prunes the scan."""
    df = spark.read.schema(schema).parquet(path)
    if columns:
        df = df.select(*columns)
    return df


def read_topics(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    return read_store(spark, path, TOPICS, columns)


def read_store_days(spark: SparkSession, path: str, start: dt.datetime, end: dt.datetime,
                    schema: T.StructType = STORED_POSTS, keep_null_days: bool = True) -> DataFrame:
    """Scan only the days in [start, end] (partition filter), plus the
    null-date partition when asked, since null keys may still match."""
    df = spark.read.schema(schema).parquet(path)
    cond = day_range_predicate(start, end)
    if keep_null_days:
        cond = cond | F.col("year").isNull()
    return df.filter(cond)


def store_exists(spark: SparkSession, path: str) -> bool:
    """True when the store has been written at least once."""
    if not path_exists(spark, path):  # asked first: a failed analysis is logged as an error
        return False
    try:
        spark.read.parquet(path).schema  # noqa: B018  (listing only, no scan)
        return True
    except AnalysisException as e:
        # A missing or empty folder only; any other trouble must not look like "no store".
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
