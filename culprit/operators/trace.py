"""Why a rule did or did not match: every pattern of the rule with its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.functions import text as tx
from culprit.functions.tables import with_row
from culprit.operators.match import find_hits, prepare_logs
from culprit.operators.rules import RuleSet


def trace_rules(logs: DataFrame, rule_set: RuleSet, log_id: str = "log_id", text: str = "text") -> DataFrame:
    """One row per (log, rule, listed pattern); a k-of-n group is one row.

    The trace masks patterns with the full line normaliser (the matcher only lower-cases and
    collapses), so a pattern that names a masked thing can show as matched here. Rows are
    logs x listed patterns by definition; restrict ``rule_set`` to the rules of interest.
    """
    p = rule_set.patterns.withColumn("norm", tx.normalize_line(F.col("pattern")))
    hits = find_hits(prepare_logs(logs, text), p.filter("norm <> ''"), [log_id])
    per_log = hits.groupBy(log_id).agg(
        F.map_from_entries(F.collect_list(F.struct("norm", F.struct("line_no", "line").alias("at")))).alias("hits")
    )
    plan = p.groupBy("rule_id").agg(
        F.array_sort(
            F.collect_list(F.struct("section", "group_idx", "idx", "group_min", "pattern", "norm"))
        ).alias("ps")
    )
    plans = plan.agg(F.collect_list(F.struct("rule_id", "ps")).alias("rules"))
    every = logs.select(log_id).join(per_log, log_id, "left")
    rows = with_row(every, plans).select(log_id, "hits", F.explode("rules").alias("r"))
    rows = rows.select(log_id, "hits", F.col("r.rule_id").alias("rule_id"), F.explode("r.ps").alias("p")).select(
        log_id, "hits", "rule_id", "p.*"
    )
    at = F.try_element_at("hits", F.col("norm"))
    single = rows.filter("section <> 'partial'").select(
        log_id, "rule_id", "section", F.col("idx").alias("position"), "pattern", at.alias("at")
    )
    hit = F.col("at").isNotNull()
    status = (
        F.when((F.col("section") == "none") & hit, "blocked")
        .when(F.col("section") == "none", "clear")
        .when(hit, "matched")
        .otherwise("missing")
    )
    single = single.select(
        log_id, "rule_id", "section", "position", "pattern", status.alias("status"),
        F.when(hit, F.array(F.col("at.line_no"))).otherwise(F.array().cast("array<int>")).alias("line_nos"),
        F.when(hit, F.array(F.col("at.line"))).otherwise(F.array().cast("array<string>")).alias("lines"),
    )
    groups = (
        rows.filter("section = 'partial'")
        .withColumn("at", at)
        .groupBy(log_id, "rule_id", F.col("group_idx").alias("position"))
        .agg(
            F.max("group_min").alias("k"),
            F.count("*").alias("n"),
            F.count("at").alias("h"),
            F.array_sort(F.collect_list(F.struct("idx", "pattern", "at"))).alias("items"),
        )
    )
    found = F.array_distinct(F.transform(F.filter("items", lambda x: x["at"].isNotNull()), lambda x: x["at"]))
    groups = groups.select(
        log_id, "rule_id", F.lit("partial").alias("section"), "position",
        F.format_string(
            "%d-of-%d: %s", F.col("k"), F.col("n"), F.array_join(F.transform("items", lambda x: x["pattern"]), " | ")
        ).alias("pattern"),
        F.when(F.col("h") >= F.col("k"), "matched").otherwise("missing").alias("status"),
        F.transform(found, lambda a: a["line_no"]).alias("line_nos"),
        F.transform(found, lambda a: a["line"]).alias("lines"),
    )
    return single.unionByName(groups)


def rule_reasons(
    logs: DataFrame, rule_set: RuleSet, ranked_pairs: DataFrame, log_id: str = "log_id", text: str = "text"
) -> DataFrame:
    """Why-text per (log, rule) from counts: only hits are rows, what is missing or clear is a rule's total less its hits.

    Same result as :func:`trace_reasons` of a trace of all logs and rules, without a row for each listed pattern.
    """
    p = rule_set.patterns.withColumn("norm", tx.normalize_line(F.col("pattern"))).select("rule_id", "section", "group_idx", "group_min", "norm")
    found = find_hits(prepare_logs(logs, text), p.filter("norm <> ''"), [log_id]).select(log_id, "norm").join(p, "norm")

    def n(section: str) -> Column:
        return F.sum((F.col("section") == section).cast("bigint"))

    # a k-of-n group counts once: reached or not
    groups = found.filter("section = 'partial'").groupBy(log_id, "rule_id", "group_idx").agg((F.count("*") >= F.max("group_min")).cast("bigint").alias("reached"))
    reached = groups.groupBy(log_id, "rule_id").agg(F.sum("reached").alias("partial_matched"))
    hits = found.groupBy(log_id, "rule_id").agg(n("any").alias("any_matched"), n("all").alias("all_matched"), n("none").alias("none_blocked"))
    totals = p.groupBy("rule_id").agg(n("all").alias("n_all"), n("none").alias("n_none"), F.count_distinct(F.when(F.col("section") == "partial", F.col("group_idx"))).alias("n_partial"))
    every = with_row(logs.select(log_id), totals.agg(F.collect_list(F.struct(*totals.columns)).alias("_rules"))).select(log_id, F.explode("_rules").alias("r")).select(log_id, "r.*")
    counted = every.join(hits, [log_id, "rule_id"], "left").join(reached, [log_id, "rule_id"], "left").fillna(0, ["any_matched", "all_matched", "none_blocked", "partial_matched"])
    counted = counted.withColumns({
        "all_missing": F.col("n_all") - F.col("all_matched"), "none_clear": F.col("n_none") - F.col("none_blocked"), "partial_missing": F.col("n_partial") - F.col("partial_matched"),
    })
    return _worded(counted, ranked_pairs, log_id)


def trace_reasons(trace: DataFrame, ranked_pairs: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Why-text per (log, rule): counts per section, worded for matches and for misses.

    ``ranked_pairs`` holds the (log, rule) pairs with a ranked match.
    """
    def n(section: str, status: str) -> Column:
        return F.sum(((F.col("section") == section) & (F.col("status") == status)).cast("bigint"))

    counts = trace.groupBy(log_id, "rule_id").agg(
        n("any", "matched").alias("any_matched"), n("all", "matched").alias("all_matched"),
        n("all", "missing").alias("all_missing"), n("partial", "matched").alias("partial_matched"),
        n("partial", "missing").alias("partial_missing"), n("none", "clear").alias("none_clear"),
        n("none", "blocked").alias("none_blocked"),
    )
    return _worded(counts, ranked_pairs, log_id)


def _worded(counts: DataFrame, ranked_pairs: DataFrame, log_id: str) -> DataFrame:
    flagged = counts.join(ranked_pairs.select(log_id, "rule_id").withColumn("ranked", F.lit(True)), [log_id, "rule_id"], "left")

    def line(name: str, words: str) -> Column:
        return F.when(F.col(name) > 0, F.format_string("%d " + words, F.col(name)))

    yes = F.array_compact(
        F.array(
            line("any_matched", "trigger rule(s) matched explicit log evidence"),
            line("all_matched", "required rule(s) matched"),
            line("partial_matched", "partial group(s) reached their threshold"),
            line("none_clear", "exclusion rule(s) stayed clear"),
            line("none_blocked", "exclusion rule(s) were triggered"),
            F.lit("matched evidence was pulled directly from the input log"),
        )
    )
    no = F.array_compact(
        F.array(
            F.when(F.col("any_matched") == 0, F.lit("no trigger rule matched the input log")),
            line("all_missing", "required rule(s) were missing"),
            line("partial_missing", "partial group(s) did not reach their threshold"),
            line("none_blocked", "exclusion rule(s) blocked the playbook"),
        )
    )
    no = F.when(F.size(no) == 0, F.array(F.lit("the playbook did not reach a ranked match"))).otherwise(no)
    return flagged.select(
        log_id, "rule_id", F.coalesce("ranked", F.lit(False)).alias("ranked"),
        F.when(F.col("ranked"), yes).otherwise(no).alias("why"),
    )
