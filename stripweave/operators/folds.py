"""Ordered work by key: running sums in pieces, and folds with constant memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.session import ship


def running_sums(rows: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """For each row the sums over the rows before it in the order of (bucket, order) within ``by``. A bucket's rows are sorted together, a
    key's buckets only as one sum each, so a frequent key is spread over as many tasks as it has buckets."""
    rows = rows.withColumn("_bucket", bucket)
    parts = rows.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "_bucket", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    inner = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()}).join(offsets, [*by, "_bucket"])
    return rows.withColumns({n: F.col(f"_o_{n}") + F.col(f"_i_{n}") for n in sums}).drop("_bucket", *(f"_{k}_{n}" for k in "oi" for n in sums))


def moving_average(rows: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column | str], value: Column, start: float, weight: float = 0.3) -> DataFrame:
    """The exponential moving average of each key after all its rows, as ``by, ema``. The average is linear in what came before, so each
    bucket gives its own part and how much of the rest it leaves; only these meet."""
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*(F.desc(o) if isinstance(o, str) else o.desc() for o in order)))
    rows = rows.withColumn("_bucket", bucket).withColumn("_v", value.cast("double")).withColumn("_r", rank)
    keep = 1 - weight
    parts = rows.groupBy(*by, "_bucket").agg(F.sum(F.col("_v") * weight * F.pow(F.lit(keep), F.col("_r") - 1)).alias("part"), F.pow(F.lit(keep), F.count("*")).alias("left"))
    steps = F.array_sort(F.collect_list(F.struct("_bucket", "part", "left")))
    return parts.groupBy(*by).agg(F.aggregate(steps, F.lit(float(start)), lambda s, p: s * p["left"] + p["part"]).alias("ema"))


def parts(rows: DataFrame) -> int:
    """How many parts rows are dealt into by number. Parts of a number that Spark may choose are put together, so that there are no more than cores and each is sorted whole in memory."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Fixed value: rows of a profile that one part is sorted with.
ROWS_EACH = 500_000


def parts_for(rows: DataFrame, each: int = ROWS_EACH) -> int:
    """How many parts ``rows`` need, so that a part's rows are bounded however long the table is; counts them, so they should be cheap to make."""
    return max(parts(rows), -(-rows.count() // each))


def dealt(rows: DataFrame, *keys: str, into: int | None = None) -> DataFrame:
    """Rows dealt so that all with equal keys lie in one task, for a fold over partitions.

    Spark leaves a repartition out where its child is dealt by these columns already, as a join or union is. A fold states no such need, so that
    at run time the child's partitions may still be split (a skewed join) or merged apart (a union), and a key's rows would part. A hash of
    the keys is an expression that no child is dealt by: the exchange stays."""
    return rows.repartition(into or parts(rows), F.xxhash64(*keys))


def ordered_fold(rows: DataFrame, key: str, order: Sequence[str], start: Callable[[Any], Any], step: Callable[[Any, Any], list[tuple] | None], finish: Callable[[Any, Any], list[tuple]], schema: str, into: int | None = None) -> DataFrame:
    """Folds each key's rows in order: ``start(key)`` gives a state, ``step(state, row)`` changes it and may give rows, ``finish(key, state)``
    gives the last ones. Rows come from a sorted partition batch by batch, so a key of any size needs no more memory than its state. ``into`` is how many
    parts they are dealt into."""
    ship(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, open_key = None, None, False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if not open_key or k != now:
                    if open_key:
                        out += finish(now, state)
                    now, state, open_key = k, start(k), True
                out += step(state, row) or []
            if out:
                yield pd.DataFrame(out, columns=names)
        if open_key and (last := finish(now, state)):
            yield pd.DataFrame(last, columns=names)

    return dealt(rows.filter(F.col(key).isNotNull()), key, into=into).sortWithinPartitions(key, *order).mapInPandas(run, schema)
