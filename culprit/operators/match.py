"""The matching kernel: logs x rules -> scored, ranked candidates.

Plan of a run: one projection per log finds the pieces of patterns it contains (see
``pattern_index``), a join with the pattern table verifies them, and the first line of each
pattern goes on to the scoring group-by and the ranking windows. Log texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from culprit.functions import text as tx
from culprit.functions.stage import log_stage
from culprit.functions.storage import stored
from culprit.operators.pattern_index import PatternIndex
from culprit.operators.rules import RuleSet


def prepare_logs(logs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``canonical`` (cleaned lines joined by line feeds) and ``norm`` (its lower case)."""
    return logs.withColumn("canonical", tx.canonicalize_log(F.col(text))).withColumn("norm", F.lower("canonical"))


def find_hits(logs: DataFrame, norms: DataFrame | PatternIndex, keep: Sequence[str] = (), outer: bool = False) -> DataFrame:
    """Which patterns occur in which log, each with the first line that holds it.

    ``logs`` needs ``canonical`` and ``norm`` (see :func:`prepare_logs`); ``norms`` has one column ``norm``
    or is their index. Result: ``keep`` columns, ``norm``, ``line_no``, ``line``; rows that agree in all ``keep``
    columns count as one log. With ``outer`` every log without a hit keeps one row with NULLs; a log with
    hits may have such a row besides.
    """
    index = norms if isinstance(norms, PatternIndex) else PatternIndex.build(norms)
    return index.find(logs, keep, outer)


def first_pattern_lines(logs: DataFrame, norms: DataFrame, log_id: str = "log_id", text: str = "text") -> DataFrame:
    """(log, pattern) hits of a raw log table: the theta join of the kernel on its own."""
    return find_hits(prepare_logs(logs, text), norms, [log_id])


def _hits(logs: DataFrame, norms: DataFrame | PatternIndex, log_id: str, text: str, carry: Mapping[str, Column]) -> DataFrame:
    """Hits of raw logs with the stage and the ``carry`` columns; logs without hits keep a row with NULLs."""
    prepared = prepare_logs(logs, text).select(
        log_id, "canonical", "norm", log_stage(F.col("norm")).alias("stage"), *[e.alias(n) for n, e in carry.items()]
    )
    return find_hits(prepared, norms, [log_id, "stage", *carry], outer=True)


def _candidates(
    logs: DataFrame, rule_set: RuleSet, log_id: str, text: str, carry: Mapping[str, Column]
) -> DataFrame:
    """One row per (log, rule) with any hit, plus one row with a NULL rule for each log without.

    ``hit`` tells whether a positive pattern matched, ``live`` whether the rule also survives
    its exclusions with a non-zero score. ``carry`` adds per-log columns; they may read
    ``canonical`` and ``norm``.
    """
    return _scored(_hits(logs, rule_set.pattern_index(), log_id, text, carry), rule_set, log_id, list(carry))


def _scored(hits: DataFrame, rule_set: RuleSet, log_id: str, carry: Sequence[str]) -> DataFrame:
    """The candidates of hits; those of patterns that the rules do not have count as no hit."""
    patterns = rule_set.normalized_patterns()
    order = F.when(F.col("section") == "any", 0).when(F.col("section") == "all", 1).otherwise(2)
    rows = hits.join(
        patterns.select("norm", "rule_id", "section", "group_idx", "group_min", "idx", "weight"), "norm", "left"
    ).withColumn("section_order", order)
    item = F.struct("section_order", "group_idx", "idx", "section", "group_min", "weight", "norm", "line")
    grouped = (
        rows.groupBy(log_id, "rule_id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("rule_id").isNotNull(), item))).alias("items"),
            *[F.any_value(c).alias(c) for c in ["stage", *carry]],
        )
    )
    rules = rule_set.rules.select("rule_id", "base_score", "stage_hints", "title", "category", "severity").join(
        rule_set.totals(), "rule_id", "left"
    )
    g = grouped.join(rules, "rule_id", "left")

    def of(section: str) -> Column:
        return F.filter("items", lambda x: x["section"] == section)

    any_score = F.aggregate(of("any"), F.lit(0.0), lambda a, x: a + x["weight"])
    all_hits = F.size(of("all"))
    complete = (F.col("n_all") > 0) & (all_hits == F.col("n_all"))
    partial = of("partial")
    reached = F.filter(
        F.array_distinct(F.transform(partial, lambda x: F.struct(x["group_idx"], x["group_min"]))),
        lambda g_: F.size(F.filter(partial, lambda x: x["group_idx"] == g_["group_idx"])) >= g_["group_min"],
    )
    partial_score = F.size(partial) * 0.75 + F.size(reached) * 1.0
    stage_hit = (F.col("stage") != "") & F.coalesce(
        F.exists("stage_hints", lambda h: F.lower(h) == F.col("stage")), F.lit(False)
    )
    g = g.select(
        log_id, *carry, "stage", "rule_id", "title", "category", "severity",
        F.exists("items", lambda x: x["section"] == "none").alias("blocked"),
        (any_score + all_hits + F.size(partial) > 0).alias("hit"),
        (F.col("base_score") + any_score + all_hits * 1.5 + partial_score).alias("base_signal"),
        F.when(complete, 2.0).otherwise(0.0).alias("compound_bonus"),
        F.when(stage_hit, 0.75).otherwise(0.0).alias("stage_bonus"),
        F.array_distinct(
            F.transform(F.filter("items", lambda x: x["section"] != "none"), lambda x: x["line"])
        ).alias("evidence"),
        F.size(
            F.array_distinct(F.transform(F.filter("items", lambda x: x["section"].isin("any", "all")), lambda x: x["norm"]))
        ).alias("n_matched"),
    )
    score = tx.round2(F.col("base_signal") + F.col("compound_bonus") + F.col("stage_bonus"))
    return (
        g.withColumn("score", score)
        .withColumn("base_signal", tx.round2(F.col("base_signal")))
        .withColumn(
            "live",
            F.coalesce(F.col("hit") & ~F.col("blocked") & (F.col("score") != 0), F.lit(False)),
        )
    )


def confidence(score: Column, competitor: Column) -> Column:
    coverage = score / (score + 1)
    separation = F.when(competitor < score, 1 - competitor / score).otherwise(0.0)
    return F.when(score <= 0, 0.0).otherwise(tx.round2((coverage + separation) / 2))


def rank_candidates(candidates: DataFrame, log_id: str = "log_id", extra_partition: Sequence[str] = ()) -> DataFrame:
    """Add ``confidence`` and ``rank``. Only a sole leader is compared with the next score."""
    w = W.partitionBy(log_id, *extra_partition)
    ranked = (
        candidates.withColumn("_top", F.max("score").over(w))
        .withColumn("_n_top", F.sum((F.col("score") == F.col("_top")).cast("int")).over(w))
        .withColumn("_second", F.coalesce(F.max(F.when(F.col("score") < F.col("_top"), F.col("score"))).over(w), F.lit(0.0)))
    )
    competitor = F.when((F.col("score") == F.col("_top")) & (F.col("_n_top") == 1), F.col("_second")).otherwise(F.col("_top"))
    ranked = ranked.withColumn("confidence", confidence(F.col("score"), competitor))
    order = W.partitionBy(log_id, *extra_partition).orderBy(
        F.desc("score"), F.desc("confidence"), F.desc(F.size("evidence")), F.asc("rule_id")
    )
    return ranked.withColumn("rank", F.row_number().over(order)).drop("_top", "_n_top", "_second")


def match_rules(
    logs: DataFrame,
    rule_set: RuleSet,
    log_id: str = "log_id",
    text: str = "text",
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Ranked candidates: one row per (log, rule) that matches."""
    live = _candidates(logs, rule_set, log_id, text, carry or {}).filter("live").drop("live", "blocked", "hit")
    return rank_candidates(live, log_id)


def excluded_pairs(logs: DataFrame, rule_set: RuleSet, log_id: str = "log_id", text: str = "text") -> DataFrame:
    """(log, rule) pairs with a positive hit that an exclusion pattern removed."""
    return _candidates(logs, rule_set, log_id, text, {}).filter("hit AND blocked").select(log_id, "rule_id")


def diagnose(
    logs: DataFrame, rule_set: RuleSet, log_id: str = "log_id", text: str = "text", source: str | None = None
) -> DataFrame:
    """Ranked candidates of every log; a log without a match keeps one row with ``live`` false."""
    carry = _about(text, source)
    return _diagnosed(_candidates(logs, rule_set, log_id, text, carry), log_id)


def diagnose_each(
    logs: DataFrame, rule_sets: Sequence[RuleSet], log_id: str = "log_id", text: str = "text", source: str | None = None
) -> list[DataFrame]:
    """:func:`diagnose` with each of several rule sets. The texts are cleaned and scanned once, for the patterns of all."""
    carry = _about(text, source)
    norms = reduce(DataFrame.union, [r.normalized_patterns().select("norm") for r in rule_sets]).distinct()
    hits = stored(_hits(logs, norms, log_id, text, carry))
    return [_diagnosed(_scored(hits, r, log_id, list(carry)), log_id) for r in rule_sets]


def _about(text: str, source: str | None) -> dict[str, Column]:
    return {
        "source": F.col(source) if source else F.lit(""),
        "first_line_snippet": tx.first_line(F.col(text)),
        "is_empty": F.col("canonical") == "",
    }


def _diagnosed(cand: DataFrame, log_id: str) -> DataFrame:
    for c in ("rule_id", "title", "category", "severity", "score", "evidence"):
        cand = cand.withColumn(c, F.when(F.col("live"), F.col(c)))
    ranked = rank_candidates(cand, log_id)
    return ranked.filter("live OR rank = 1").drop("hit", "blocked")


def top_results(diagnosed: DataFrame, log_id: str = "log_id") -> DataFrame:
    """One result row per log from :func:`diagnose`."""
    return diagnosed.filter("rank = 1").select(
        log_id,
        "source",
        F.col("live").alias("matched"),
        F.coalesce("rule_id", F.lit("")).alias("failure_id"),
        F.when(F.col("live"), F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        F.when(F.col("is_empty"), F.lit("empty fixture")).otherwise(F.lit("")).alias("error"),
        F.when(F.col("first_line_snippet") == "", F.lit(""))
        .otherwise(F.substring(F.sha2("first_line_snippet", 256), 1, 8))
        .alias("first_line_tag"),
        "first_line_snippet",
        "stage",
        "severity",
        "category",
        "title",
        "score",
    )


def evaluate_logs(
    logs: DataFrame, rule_set: RuleSet, log_id: str = "log_id", text: str = "text", source: str | None = None
) -> DataFrame:
    """One result row per log: the top diagnosis, or unmatched, or an error for an empty log."""
    return top_results(diagnose(logs, rule_set, log_id, text, source), log_id)


def evaluate_each(
    logs: DataFrame, rule_sets: Sequence[RuleSet], log_id: str = "log_id", text: str = "text", source: str | None = None
) -> list[DataFrame]:
    """:func:`evaluate_logs` with each of several rule sets, in one scan of the texts."""
    return [top_results(d, log_id) for d in diagnose_each(logs, rule_sets, log_id, text, source)]


def guard(ranked: DataFrame, log_id: str = "log_id", min_confidence: float = 0.75, min_score: float = 3.5, top: int = 0) -> DataFrame:
    """Keep sure findings only, then the first ``top`` of each log (0 = all)."""
    kept = ranked.filter((F.col("confidence") >= min_confidence) & (F.col("score") >= min_score))
    if top <= 0:
        return kept
    w = W.partitionBy(log_id).orderBy("rank")
    return kept.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top).drop("_n")


def select_rank(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.filter(F.col("rank") == n)


def unmatched(results: DataFrame) -> DataFrame:
    """Logs that no rule explains and that are not errors."""
    return results.filter("NOT matched AND error = ''")


def match_fingerprint(rule_id: Column, evidence: Column) -> Column:
    return tx.fnv1a32(F.concat(rule_id, F.array_join(F.slice(evidence, 1, 3), "")))


def unknown_fingerprint(stage: Column, command: Column, step: Column, signals: Column) -> Column:
    firsts = F.transform(F.slice(signals, 1, 3), lambda s: tx.trim_space(s))
    return tx.fnv1a32(F.concat(F.lit("unknown"), stage, command, step, F.array_join(firsts, "")))
