from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from postlens.session import DEFAULT_CONF

    b = SparkSession.builder.master("local[*]").appName("postlens-tests")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", "8")
    # Tests only: the cluster names its own shared checkpoint folder.
    b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="postlens-test-ckpt-", dir="/tmp"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="postlens-test-", dir="/tmp")
