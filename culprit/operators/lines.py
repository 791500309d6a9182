"""Logs to numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culprit.functions import text as tx


def numbered_lines(logs: DataFrame, log_id: str = "log_id", text: str = "text") -> DataFrame:
    """One row per cleaned, non-blank line, numbered from 1 after blanks are dropped."""
    canonical = logs.select(log_id, tx.canonicalize_log(F.col(text)).alias("c")).filter("c <> ''")
    return canonical.select(log_id, F.posexplode(F.split("c", "\n")).alias("pos", "line")).select(
        log_id, (F.col("pos") + 1).alias("line_no"), "line", F.lower("line").alias("norm")
    )
