"""Reading the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
