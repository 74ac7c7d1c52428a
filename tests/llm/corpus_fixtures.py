"""Shared fixture of the corpus operators' tests."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""
    def make(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        from pyspark.sql import functions as F

        return df.withColumns({k: F.lit(v) for k, v in extra.items()})

    return make

