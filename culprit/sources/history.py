"""Append diagnosed runs to the history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.functions.signature import signature_hash

TABLES = ["runs", "findings", "matches", "hooks"]


def history_rows(
    diagnosed: DataFrame, completed_at: Column, input_hash: Column | None = None, run_id: str = "log_id", hooks: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Rows of the history tables from :func:`culprit.operators.match.diagnose` output.

    ``hooks(<run_id>, rule_id, hook_id, category, kind, status, passed, confidence_delta, reason)``: results of
    checks that ran for a finding; they get its signature and time, and those of no live finding are left out."""
    live = diagnosed.filter("live")
    sig = signature_hash(F.col("rule_id"), F.lit("log"), F.col("evidence"), F.col("title"))
    findings = live.select(
        F.col(run_id).alias("run_id"), "rank", F.col("rule_id").alias("failure_id"), "title", "category", F.lit("log").alias("detector"),
        "score", "confidence", sig.alias("signature_hash"), completed_at.alias("seen_at"),
    )
    matches = live.select(F.col(run_id).alias("run_id"), "rank", "rule_id", F.lit("log").alias("detector"), "score", "confidence", completed_at.alias("matched_at"))
    stable = F.sha2(F.to_json(F.struct("rule_id", "score", "confidence", "evidence")), 256)
    runs = diagnosed.filter("rank = 1").select(
        F.col(run_id).alias("run_id"), F.col("live").alias("matched"), F.when(F.col("live"), F.col("rule_id")).alias("failure_id"),
        (input_hash if input_hash is not None else F.lit(None).cast("string")).alias("input_hash"),
        F.when(F.col("live"), stable).alias("output_hash"), completed_at.alias("completed_at"),
    )
    out = {"runs": runs, "findings": findings, "matches": matches}
    if hooks is not None:
        found = live.select(run_id, "rule_id", sig.alias("signature_hash"), completed_at.alias("executed_at"))
        out["hooks"] = hooks.join(found, [run_id, "rule_id"]).select(
            F.col(run_id).alias("run_id"), "rule_id", "signature_hash", "hook_id", "category", "kind", "status", "passed", "confidence_delta", "reason", "executed_at"
        )
    return out


def append_history(rows: dict[str, DataFrame], root: str, time_columns: dict[str, str] | None = None) -> None:
    """Append each table below ``root``, partitioned by day."""
    times = time_columns or {"runs": "completed_at", "findings": "seen_at", "matches": "matched_at", "hooks": "executed_at"}
    for name, df in rows.items():
        df.withColumn("day", F.to_date(times[name])).write.mode("append").partitionBy("day").parquet(f"{root}/{name}")


def read_history(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")
