"""A columnar store: a folder of Parquet files that keeps types, logical types, nulls and row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabula.frame import columns


def save_table(df: DataFrame, path: str) -> str:
    """Write a table with at least one column; an empty one keeps its schema."""
    if not columns(df):
        raise ValueError("a table without columns cannot be stored")
    df.write.mode("overwrite").parquet(path)
    return path


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored table; a missing folder is an error."""
    return spark.read.parquet(path)
