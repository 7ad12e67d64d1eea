"""Parquet table access for the driver-generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; Catalyst prunes columns and pushes filters into it. NaN is read as NULL."""
    return nan_to_null(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value: NaN in float columns becomes NULL."""
    floats = {c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(floats) if floats else df
