"""Address lists: text or comma-separated, one row per address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_address_lists(lists: DataFrame, column: str = "value") -> DataFrame:
    """Cut at line ends and commas, trimmed; blanks and lines that start with ``#`` go. Other columns stay."""
    kept = [c for c in lists.columns if c != column]
    rows = lists.select(*kept, F.explode(F.split(F.col(column), "[\\n,]+")).alias("address"))
    return rows.withColumn("address", F.trim("address")).filter((F.col("address") != "") & ~F.col("address").startswith("#"))


def read_address_lists(spark: SparkSession, path: str) -> DataFrame:
    return split_address_lists(spark.read.text(path))
