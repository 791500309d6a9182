"""Queries on the matching kernel (lines, hits, scores, ranks, trace)."""

from __future__ import annotations

from pyspark.sql import functions as F

from culprit.operators import match as mt
from culprit.plans import demo
from culprit.plans import sql


def ev(c):
    return F.array_join(c, "\n").alias("evidence")


def match_ranked(spark, sf):
    r = mt.match_rules(demo.logs(spark, sf), demo.rules(spark))
    return r.select("log_id", "rule_id", "stage", "base_signal", "compound_bonus", "stage_bonus", "score", "confidence",
                    F.col("rank").cast("bigint").alias("rank"), ev("evidence"))


def evaluate(spark, sf):
    r = mt.evaluate_logs(demo.logs(spark, sf), demo.rules(spark), source="source")
    return r.select("log_id", "source", "matched", "failure_id", "confidence", ev("evidence"), "error", "first_line_tag",
                    "first_line_snippet", "stage")


QUERIES = {"match_ranked": match_ranked, "evaluate_logs": evaluate}
ORACLES = {
    "match_ranked": sql.ranked() + """SELECT log_id, rule_id, stage, round(base_signal * 100) / 100 AS base_signal,
  compound_bonus::DOUBLE AS compound_bonus, stage_bonus::DOUBLE AS stage_bonus, score, confidence, rank,
  array_to_string(evidence, chr(10)) AS evidence FROM ranked""",
    "evaluate_logs": sql.results() + """SELECT log_id, source, matched, failure_id, confidence,
  coalesce(array_to_string(evidence, chr(10)), '') AS evidence, error, first_line_tag, first_line_snippet, stage FROM results""",
}
