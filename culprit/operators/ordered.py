"""Ordered per-key computations that split a hot key by time.

A plain window over a key puts all its rows in one task. These helpers run the window
inside (key, time bucket) and carry a small per-bucket summary across buckets, so one
pipeline that holds a third of all runs is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET = "_bucket"


def time_bucket(ts: Column, unit: str = "hour") -> Column:
    return F.date_trunc(unit, ts)


def _summaries(df: DataFrame, keys: Sequence[str], aggregate: Column, name: str) -> DataFrame:
    return df.groupBy(*keys, BUCKET).agg(aggregate.alias(name))


def running_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str) -> DataFrame:
    """1-based position of each row within its key."""
    d = df.withColumn(BUCKET, bucket)
    sizes = _summaries(d, keys, F.count("*"), "_n")
    before = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = W.partitionBy(*keys, BUCKET).orderBy(*order)
    out = d.withColumn(name, F.row_number().over(within)).join(offsets, [*keys, BUCKET])
    return out.withColumn(name, F.col(name) + F.col("_offset")).drop("_offset", BUCKET)


def last_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Latest non-NULL ``value`` among the rows before each row of the same key."""
    d = df.withColumn(BUCKET, bucket).withColumn("_v", value)
    within = W.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    newest = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    summaries = _summaries(d, keys, newest, "_s")
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carried = summaries.withColumn("_carry", F.last("_s", ignorenulls=True).over(earlier)).drop("_s")
    out = d.withColumn(name, F.last("_v", ignorenulls=True).over(within)).join(carried, [*keys, BUCKET])
    return out.withColumn(name, F.coalesce(name, "_carry")).drop("_carry", "_v", BUCKET)
