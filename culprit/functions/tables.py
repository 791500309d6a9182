"""Small parameter tables as DataFrames whose size Spark knows.

A table built from Arrow data becomes a local relation, so the planner sees its real
size and decides on a broadcast itself (``spark.sql.autoBroadcastJoinThreshold``);
no join in this package forces a broadcast of data that may grow.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_TYPES = {
    "string": pa.string(),
    "double": pa.float64(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "boolean": pa.bool_(),
    "timestamp": pa.timestamp("us", tz="UTC"),
    "array<string>": pa.list_(pa.string()),
}


def small_table(spark: SparkSession, rows: Iterable[Mapping[str, Any]], columns: Mapping[str, str]) -> DataFrame:
    rows = list(rows)
    schema = pa.schema([pa.field(n, ARROW_TYPES[t]) for n, t in columns.items()])
    data = {n: pa.array([r.get(n) for r in rows], type=schema.field(n).type) for n in columns}
    return spark.createDataFrame(pa.table(data, schema=schema))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, as a scalar subquery."""
    names = one.columns
    held = df.withColumn("_row", one.select(F.struct(*names).alias("r")).scalar())
    return held.select(*df.columns, *[F.col(f"_row.{n}").alias(n) for n in names])
