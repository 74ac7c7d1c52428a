"""Session and shared-folder helpers.

Jobs never assume a machine-local folder on a cluster: every scratch table,
store or checkpoint lives under ``spark.checkpoint.dir``, which the cluster
names.  Only when that setting is unset (local runs, tests) do we create one.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_scratch: ContextVar[str | None] = ContextVar("postlens_scratch", default=None)

# Settings of sessions that we create; a caller's own session is left as it is.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "postlens") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:  # else the cluster's own value holds
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("POSTLENS_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    else:
        # Local runs and tests only: the cluster always names a shared folder.
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="postlens-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's tables, inside the shared checkpoint folder
    (or inside the open ``scratch`` folder)."""
    root = _scratch.get() or f"{ensure_checkpoint_dir(spark).rstrip('/')}/postlens-work"
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, asked of the file system that the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def content_dir(spark: SparkSession, name: str, inputs: Sequence[str]) -> str:
    """A folder for tables derived from ``inputs`` (files or folders): the same one as long
    as their files, sizes and times are the same, another one as soon as they change."""
    marks = []
    for path in sorted(inputs):
        top = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        todo = list(fs.globStatus(top) or [])
        while todo:
            st = todo.pop()
            if st.isDirectory():
                todo += list(fs.listStatus(st.getPath()))
            else:
                marks.append(f"{st.getPath()} {st.getLen()} {st.getModificationTime()}")
    mark = hashlib.md5("\n".join(sorted(marks)).encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/postlens-work/{name}-{mark}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """Work tables made inside the block lie in one folder, removed at its end.

    For jobs whose results are written elsewhere by then, such as a micro-batch;
    a frame that still reads a work table must not leave the block.
    """
    root = work_dir(spark, name)
    token = _scratch.set(root)
    try:
        yield root
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for the block; a query keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
