"""Work tables: Parquet in the shared folder that cuts lineage and can be pruned.

Unlike a row checkpoint, a later read takes only the columns it needs, and
the files outlive the executors that wrote them.  ``session.scratch`` removes
those of a finished job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.session import work_dir

ROW_ID = "_rid"


def work_table(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a work table with a unique ``_rid`` per row.

    The ids are written once, so every later use of the table sees the same
    ones, also when tasks run again.
    """
    return work_table(df.withColumn(ROW_ID, F.monotonically_increasing_id()), name)
