"""Stage sinks and metadata round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a parquet table (no index column, as in the reference)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Reports and metadata as JSON lines, one file per partition."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.option("multiLine", multi_line).json(path)
