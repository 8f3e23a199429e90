"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``sf_dir``; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

