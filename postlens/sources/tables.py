"""Read the driver's test tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlens.schemas import TABLE_SCHEMAS


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    schema = TABLE_SCHEMAS.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(table_path(sf_dir, name))
