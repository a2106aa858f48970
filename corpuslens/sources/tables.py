"""Readers for the input tables (one Parquet dataset per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INPUT_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                "events", "documents", "embeddings", "pages", "benchmark", "labels",
                "conversations")


def table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Lazily read ``{base_dir}/{name}.parquet``; Catalyst prunes columns and
    pushes filters into the scan."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, base_dir: str, names=INPUT_TABLES) -> None:
    """Expose the input tables to ``spark.sql`` under their own names."""
    for name in names:
        table(spark, base_dir, name).createOrReplaceTempView(name)
