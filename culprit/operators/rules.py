"""Rule tables: shape, checks, pattern weights, overlap report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.functions import text as tx
from culprit.functions.storage import stored
from culprit.functions.tables import small_table
from culprit.operators.pattern_index import PatternIndex

RULE_COLUMNS = {
    "rule_id": "string",
    "title": "string",
    "category": "string",
    "severity": "string",
    "detector": "string",
    "base_score": "double",
    "tags": "array<string>",
    "stage_hints": "array<string>",
    "likely_files": "array<string>",
    "fix": "string",
    "pack": "string",
    "domain": "string",
    "class": "string",
    "mode": "string",
}
PATTERN_COLUMNS = {
    "rule_id": "string",
    "section": "string",
    "group_idx": "int",
    "group_min": "int",
    "idx": "int",
    "pattern": "string",
}
WEIGHTED_COLUMNS = {**PATTERN_COLUMNS, "norm": "string", "weight": "double"}


@dataclass(frozen=True)
class RuleSet:
    """``rules``: one row per rule. ``patterns``: one row per listed pattern."""

    rules: DataFrame
    patterns: DataFrame
    _settled: dict = field(default_factory=dict, compare=False, repr=False)

    @staticmethod
    def from_records(spark: SparkSession, records: Iterable[Mapping[str, Any]]) -> RuleSet:
        """Rules given as dicts with ``any`` / ``all`` / ``none`` lists and ``partial`` groups."""
        rules, patterns = [], []
        for r in records:
            rules.append({"detector": "log", "base_score": 0.0, **{k: r[k] for k in RULE_COLUMNS if k in r}})
            for section in ("any", "all", "none"):
                for i, p in enumerate(r.get(section, [])):
                    patterns.append(
                        {"rule_id": r["rule_id"], "section": section, "group_idx": 0, "group_min": 0, "idx": i, "pattern": p}
                    )
            for g, group in enumerate(r.get("partial", [])):
                for i, p in enumerate(group["patterns"]):
                    patterns.append(
                        {
                            "rule_id": r["rule_id"],
                            "section": "partial",
                            "group_idx": g,
                            "group_min": group["minimum"],
                            "idx": i,
                            "pattern": p,
                        }
                    )
        return RuleSet(small_table(spark, rules, RULE_COLUMNS), small_table(spark, patterns, PATTERN_COLUMNS))

    def normalized_patterns(self) -> DataFrame:
        """Patterns with ``norm`` (what the matcher tests) and ``weight``; empty ones dropped.

        ``weight`` is 1 / number of rules that list the pattern under ``any``; other
        sections have flat weights.
        """
        return self._settle("patterns", _weighted_patterns(self.patterns), WEIGHTED_COLUMNS)

    def pattern_index(self) -> PatternIndex:
        """The index of the normalised patterns, built once."""
        if "index" not in self._settled:
            self._settled["index"] = PatternIndex.build(self.normalized_patterns())
        return self._settled["index"]

    def totals(self) -> DataFrame:
        """Per rule: non-empty ``all`` patterns."""
        p = self.patterns.withColumn("norm", tx.normalize_pattern(F.col("pattern")))
        n_all = F.sum(F.expr("CAST(section = 'all' AND norm <> '' AS BIGINT)"))
        return self._settle("totals", p.groupBy("rule_id").agg(n_all.alias("n_all")), {"rule_id": "string", "n_all": "bigint"})

    def _settle(self, name: str, df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        """A derived rule table is written once and read back: its size is then known to the planner, and no rows
        go through the driver."""
        if name not in self._settled:
            self._settled[name] = stored(df.select(*columns))
        return self._settled[name]

    def filter_rules(self, condition) -> RuleSet:
        """Keep the rules that satisfy a condition on the rule table (detector kind, category, id)."""
        kept = self.rules.filter(condition)
        return RuleSet(kept, self.patterns.join(kept.select("rule_id"), "rule_id", "left_semi"))

    def by_detector(self, kind: str) -> RuleSet:
        return self.filter_rules(F.coalesce(F.col("detector"), F.lit("log")) == kind)

    def explain(self, rule_id: str) -> DataFrame:
        """The rule with this id; no row when it is unknown."""
        return self.rules.filter(F.col("rule_id") == rule_id)


def _weighted_patterns(patterns: DataFrame) -> DataFrame:
    p = patterns.withColumn("norm", tx.normalize_pattern(F.col("pattern"))).filter("norm <> ''")
    idf = (
        p.filter("section = 'any'")
        .groupBy("norm")
        .agg((F.lit(1.0) / F.countDistinct("rule_id")).alias("any_weight"))
    )
    return (
        p.join(idf, "norm", "left")
        .withColumn("weight", F.when(F.col("section") == "any", F.col("any_weight")).otherwise(F.lit(0.0)))
        .drop("any_weight")
    )


def idf_weights(patterns: DataFrame) -> DataFrame:
    """Per normalised ``any`` pattern: rules that list it and the resulting weight."""
    p = patterns.filter("section = 'any'").withColumn("norm", tx.normalize_pattern(F.col("pattern")))
    return (
        p.filter("norm <> ''")
        .groupBy("norm")
        .agg(F.countDistinct("rule_id").alias("n_rules"))
        .withColumn("weight", F.lit(1.0) / F.col("n_rules"))
    )


def duplicate_rule_ids(rules: DataFrame) -> DataFrame:
    return rules.groupBy("rule_id").agg(F.count("*").alias("n")).filter("n > 1")


def load_rules(rules: DataFrame, patterns: DataFrame) -> RuleSet:
    """Rule set from stored tables; fails on a repeated id."""
    repeated = duplicate_rule_ids(rules).limit(5).collect()
    if repeated:
        raise ValueError(f"duplicate rule ids: {sorted(r['rule_id'] for r in repeated)}")
    return RuleSet(rules, patterns)


def check_rules(rule_set: RuleSet) -> DataFrame:
    """Violations of the rule-table contract as rows ``(rule_id, problem, detail)``."""
    rules, raw = rule_set.rules, rule_set.patterns
    p = raw.withColumn("norm", tx.normalize_pattern(F.col("pattern")))

    def rows(df: DataFrame, problem: str, detail) -> DataFrame:
        return df.select("rule_id", F.lit(problem).alias("problem"), detail.alias("detail"))

    required = F.explode(
        F.array_compact(
            F.array(
                *[
                    F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c))
                    for c in ("rule_id", "title", "fix")
                ]
            )
        )
    )
    missing = rows(rules.withColumn("f", required), "missing field", F.col("f"))
    unknown = rows(
        rules.filter(~F.coalesce(F.col("detector"), F.lit("log")).isin("log", "source")),
        "unknown detector",
        F.col("detector"),
    )
    log_rules = rules.filter(F.coalesce(F.col("detector"), F.lit("log")) == "log")
    no_matcher = rows(
        log_rules.join(raw.filter("section <> 'none'").select("rule_id"), "rule_id", "left_anti"),
        "no matcher",
        F.lit("any, all or partial"),
    )
    where = F.when(F.col("section") == "partial", F.concat(F.lit("partial["), F.col("group_idx"), F.lit("]"))).otherwise(
        F.col("section")
    )
    at = F.concat(where, F.lit("["), F.col("idx"), F.lit("]"))
    empty = rows(p.filter("norm = ''"), "empty pattern", at)
    groups = p.filter("section = 'partial'").groupBy("rule_id", "group_idx").agg(
        F.max("group_min").alias("m"), F.count("*").alias("n")
    )
    bounds = rows(
        groups.filter("m <= 0 OR m > n"), "k of n out of bounds", F.format_string("%d of %d", F.col("m"), F.col("n"))
    )
    flat = p.filter("section IN ('any', 'all', 'none') AND norm <> ''").groupBy("rule_id", "norm").agg(
        F.max((F.col("section") == "any").cast("int")).alias("in_any"),
        F.max((F.col("section") == "all").cast("int")).alias("in_all"),
        F.sum((F.col("section") == "all").cast("int")).alias("n_all"),
        F.max((F.col("section") == "none").cast("int")).alias("in_none"),
    )
    twice = rows(flat.filter("(in_any = 1 AND in_all = 1) OR n_all > 1"), "pattern listed twice", F.col("norm"))
    excluded = rows(
        flat.filter("in_none = 1 AND (in_any = 1 OR in_all = 1)"), "pattern both positive and excluded", F.col("norm")
    )
    differs = rows(
        p.filter("norm <> ''").filter(tx.normalize_line(F.col("pattern")) != F.col("norm")),
        "pattern is masked by the line normaliser",
        F.col("norm"),
    )
    out = missing
    for part in (unknown, no_matcher, empty, bounds, twice, excluded, differs):
        out = out.unionByName(part)
    return out


def pattern_conflicts(patterns: DataFrame) -> DataFrame:
    """Patterns shared by several rules, or positive in one place and excluded in another."""
    p = (
        patterns.withColumn("norm", tx.normalize_pattern(F.col("pattern")))
        .filter("norm <> ''")
        .withColumn(
            "place",
            F.when(
                F.col("section") == "partial", F.concat(F.lit("partial["), F.col("group_idx"), F.lit("]"))
            ).otherwise(F.col("section")),
        )
        .groupBy("norm", "rule_id", "place")
        .agg(F.max((F.col("section") != "none").cast("int")).alias("positive"))
        .withColumn("ref", F.concat_ws(":", "rule_id", "place"))
    )
    return (
        p.groupBy("norm")
        .agg(
            F.countDistinct(F.when(F.col("positive") == 1, F.col("rule_id"))).alias("positive_rules"),
            F.sum(1 - F.col("positive")).alias("negative_refs"),
            F.array_sort(F.collect_list(F.when(F.col("positive") == 1, F.col("ref")))).alias("positive_at"),
            F.array_sort(F.collect_list(F.when(F.col("positive") == 0, F.col("ref")))).alias("negative_at"),
        )
        .filter("positive_rules > 1 OR (positive_rules > 0 AND negative_refs > 0)")
    )


def pack_counts(rules: DataFrame) -> DataFrame:
    """Rules per pack."""
    return rules.groupBy(F.coalesce(F.nullif(F.trim("pack"), F.lit("")), F.lit("custom")).alias("pack")).agg(
        F.count("*").alias("rule_count")
    )
