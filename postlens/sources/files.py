"""File sources and sinks: CSV (A4, A8), JSON records (A11, A12), flat export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# CSV options that keep multi-line, quoted text intact in both directions.
_CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "timestampNTZFormat": _CSV_TIME,
    "mode": "FAILFAST",
    # Null is a mark of its own, the empty string is written as "", and outer blanks stay.
    "nullValue": "\\N",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# Compressed JSON cannot be split: so many rows are read by one task.
_JSON_FILE_ROWS = 50_000


def _strings(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; every string quoted so newlines survive.

    A text that begins with a backslash gets another one in front, so none looks
    like the mark of a null, whatever it holds.
    """
    marked = {c: F.when(F.col(c).startswith("\\"), F.concat(F.lit("\\"), F.col(c))).otherwise(F.col(c)) for c in _strings(df.schema)}
    df.withColumns(marked).write.mode(mode).options(**CSV_OPTIONS).option("quoteAll", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A4: CSV back under an explicit schema (never inferred); see ``write_csv``."""
    df = spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    plain = {c: F.when(F.col(c).startswith("\\\\"), F.substr(F.col(c), F.lit(2))).otherwise(F.col(c)) for c in _strings(schema)}
    return df.withColumns(plain)


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Captured records as JSON lines (one object per post), compressed; a file is read by one task, so its rows are bounded."""
    (df.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", _JSON_FILE_ROWS).json(path))


def read_json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under an explicit schema."""
    return (spark.read.schema(schema)
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            .option("mode", "PERMISSIVE").json(path))


def parse_json_column(df: DataFrame, col: str, schema: T.DataType | str, alias: str = "j") -> DataFrame:
    """A JSON text column to typed fields (bad text gives nulls)."""
    return df.withColumn(alias, F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"}))


def write_flat(df: DataFrame, path: str) -> None:
    """A flat Parquet snapshot (overwrite)."""
    df.write.mode("overwrite").parquet(path)


__all__ = ["write_csv", "read_csv", "write_json_records", "read_json_records", "parse_json_column",
           "write_flat"]
