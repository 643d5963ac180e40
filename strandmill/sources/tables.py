"""Parquet tables addressed by directory and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset directory; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, rows: int = 1 << 20) -> int:
    """How many tasks share ``df``, at ``rows`` each but no fewer than Spark would take; a table's rows are counted from its files' footers."""
    return max(-(-df.count() // rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
