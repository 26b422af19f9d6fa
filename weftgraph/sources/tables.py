"""Loading the Parquet tables of a graph folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables (a file or a folder of parts)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
