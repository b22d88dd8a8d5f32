"""Parquet scans of the driver tables and stage outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan ``{sf_dir}/{name}.parquet``; column names are trimmed.

    Selecting ``columns`` right at the scan keeps the ReadSchema narrow even
    before Catalyst prunes; filters applied later are pushed into the scan.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    trimmed = [c.strip() for c in df.columns]
    if trimmed != df.columns:
        df = df.toDF(*trimmed)
    return df.select(*columns) if columns else df
