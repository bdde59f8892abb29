"""Row numbers over tables too large to be sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_row_number(rows: DataFrame, bucket: Column, order: Sequence[Column | str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Numbers from 1 in the order of (bucket, order), within ``by``. Buckets must be of bounded size: they are sorted one by one, and
    only their counts are summed up in order."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(by or (F.lit(0),))).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    out = rows.withColumn("_at", inner).join(offsets, [*by, "_bucket"])
    return out.withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_bucket", "_at", "_before")
