"""Lazy access to a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; nothing is read before an action asks for it."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
