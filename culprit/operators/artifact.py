"""Comparison of two analyses of a log and assembly of the failure artifact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from culprit.functions.classify import fix_steps, missing_executable
from culprit.functions.regex import glob_regex
from culprit.functions.text import base_name, round2

# --- fixed values: confidence steps, limits -----------------------------------------------------------
RELATED_COMMITS_STEP, DELTA_STEP, UNKNOWN_CONFIDENCE = 0.04, 0.03, 0.2
MAX_LIKELY_FILES = 5
MAX_HOOK_DELTA = 0.30
# --- end of fixed values --------------------------------------------------------------------------------

COMPARED_LISTS = ["evidence", "fix_steps", "dominant_signals", "repo_files", "delta_files", "delta_tests", "delta_errors"]


def _difference(left: Column, right: Column) -> Column:
    def only(a: Column, b: Column) -> Column:
        return F.array_sort(F.array_except(F.filter(a, lambda x: x != ""), b))

    return F.struct(only(right, left).alias("added"), only(left, right).alias("removed"))


def compare_analyses(left: DataFrame, right: DataFrame, log_id: str = "log_id") -> DataFrame:
    """One row per log: changed diagnosis and status, added and removed list items, summary lines.

    Lists that an analysis table does not have count as empty.
    """
    none = F.array().cast("array<string>")

    def side(df: DataFrame, p: str) -> DataFrame:
        lists = [(F.col(c) if c in df.columns else none).alias(c) for c in COMPARED_LISTS]
        return df.select(log_id, F.struct("matched", "failure_id", *lists).alias(p))

    j = side(left, "l").join(side(right, "r"), log_id, "full_outer")
    had, has = F.coalesce("l.matched", F.lit(False)), F.coalesce("r.matched", F.lit(False))
    before, after = F.col("l.failure_id"), F.col("r.failure_id")
    changed = F.when(~had & ~has, False).when(had != has, True).otherwise(before != after)
    diffs = {c: _difference(F.coalesce(f"l.{c}", none), F.coalesce(f"r.{c}", none)).alias(c) for c in COMPARED_LISTS}
    d = j.select(log_id, had.alias("had"), has.alias("has"), before.alias("before"), after.alias("after"), changed.alias("diagnosis_changed"),
                 (had != has).alias("status_changed"), *diffs.values())

    def n(c: str) -> Column:
        return F.size(c)

    moved = F.lit(False)
    for c in COMPARED_LISTS:
        moved = moved | (n(f"{c}.added") > 0) | (n(f"{c}.removed") > 0)
    headline = (
        F.when(~F.col("had") & ~F.col("has"), F.lit("neither artifact contains a matched diagnosis"))
        .when(~F.col("had"), F.concat(F.lit("a diagnosis appeared: "), "after"))
        .when(~F.col("has"), F.concat(F.lit("the previous diagnosis disappeared: "), "before"))
        .when(F.col("diagnosis_changed"), F.concat(F.lit("top diagnosis changed from "), "before", F.lit(" to "), "after"))
        .otherwise(F.concat(F.lit("top diagnosis stayed the same: "), "after"))
    )
    details = F.array_compact(
        F.array(
            F.when(F.col("status_changed"), "artifact status changed between matched and unknown"),
            F.when(n("evidence.added") > 0, F.format_string("%d new top-diagnosis evidence line(s) appeared", n("evidence.added"))),
            F.when(n("evidence.removed") > 0, F.format_string("%d prior top-diagnosis evidence line(s) disappeared", n("evidence.removed"))),
            F.when((n("dominant_signals.added") > 0) | (n("dominant_signals.removed") > 0), "dominant unmatched signals changed"),
            F.when(
                (n("delta_files.added") > 0) | (n("delta_tests.added") > 0) | (n("delta_errors.added") > 0),
                "current delta context contains new changed files, failing tests, or added errors",
            ),
        )
    )
    summary = F.when(
        (F.size(details) == 0) & ~moved, F.array(headline, F.lit("no material differences were found in the compared artifacts"))
    ).otherwise(F.concat(F.array(headline), details))
    return d.withColumn("summary", summary).withColumn("changed", F.col("diagnosis_changed") | F.col("status_changed") | moved).drop(
        "had", "has", "before", "after"
    )


def likely_files(rule_files: Column, recent: Column, limit: int = MAX_LIKELY_FILES) -> Column:
    none = F.array().cast("array<string>")
    both = F.transform(F.concat(F.coalesce(rule_files, none), F.coalesce(recent, none)), F.trim)
    return F.slice(F.array_distinct(F.filter(both, lambda f: f != "")), 1, limit)


def refined_confidence(confidence: Column, has_commits: Column, has_delta: Column, hook_confidence: Column | None = None) -> Column:
    c = confidence + F.when(has_commits, RELATED_COMMITS_STEP).otherwise(0.0) + F.when(has_delta, DELTA_STEP).otherwise(0.0)
    if hook_confidence is not None:
        c = F.coalesce(hook_confidence, c)
    return F.least(F.lit(1.0), c)


def facts(rule_id: Column, command: Column, evidence: Column) -> Column:
    """Map of known facts: the command hint, and for a missing executable its name and path."""
    found = F.filter(F.transform(evidence, missing_executable), lambda m: F.map_contains_key(m, "missing_executable"))
    extra = F.when((rule_id == "missing-executable") & (F.size(found) > 0), F.get(found, 0)).otherwise(F.create_map().cast("map<string,string>"))
    hint = F.nullif(F.trim(F.coalesce(command, F.lit(""))), F.lit(""))
    return F.map_concat(F.map_filter(F.create_map(F.lit("command_hint"), hint), lambda _, v: v.isNotNull()), extra)


def artifacts(results: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Artifact row per log from its result and whatever context columns it carries.

    Optional columns: ``likely_files``, ``fix``, ``recent_files``, ``has_related_commits``,
    ``has_delta``, ``hook_confidence``, ``command``, ``seen_before``, ``occurrence_count``,
    ``first_seen_at``, ``last_seen_at``, ``dominant_signals``, ``cluster_confidence``.
    """
    none = F.array().cast("array<string>")

    def get(name: str, default: Column) -> Column:
        return F.col(name) if name in results.columns else default

    m = F.col("matched")
    dominant = F.coalesce(get("dominant_signals", none), none)
    confidence = refined_confidence(
        F.col("confidence"), get("has_related_commits", F.lit(False)), get("has_delta", F.lit(False)),
        get("hook_confidence", F.lit(None).cast("double")),
    )
    history = F.struct(
        F.coalesce(get("seen_before", F.lit(False)), F.lit(False)).alias("seen_before"),
        F.coalesce(get("occurrence_count", F.lit(0).cast("bigint")), F.lit(0)).alias("occurrence_count"),
        get("first_seen_at", F.lit(None).cast("timestamp")).alias("first_seen_at"),
        get("last_seen_at", F.lit(None).cast("timestamp")).alias("last_seen_at"),
    )
    return results.select(
        log_id,
        F.when(m, "matched").otherwise("unknown").alias("status"),
        F.when(m, F.struct(F.col("failure_id").alias("id"), "title", "category", "severity")).alias("matched_rule"),
        F.when(m, F.col("evidence")).otherwise(dominant).alias("evidence"),
        F.when(m, confidence).otherwise(F.coalesce(get("cluster_confidence", F.lit(None).cast("double")), F.lit(UNKNOWN_CONFIDENCE))).alias("confidence"),
        F.when(m, facts(F.col("failure_id"), get("command", F.lit("")), F.col("evidence"))).alias("facts"),
        F.when(m, history).alias("history"),
        F.when(m, fix_steps(get("fix", F.lit("")))).otherwise(none).alias("fix_steps"),
        F.when(m, likely_files(get("likely_files", none), get("recent_files", none))).otherwise(none).alias("likely_files"),
    )


def hook_confidence(hooks: DataFrame, keys: Sequence[str], base: Column) -> DataFrame:
    """Confidence after recorded verify hooks: plus for a pass, minus for a failure, limited."""
    counted = (F.col("category") == "verify") & (F.col("status") == "executed") & F.col("passed").isNotNull()
    step = F.when(counted, F.when(F.col("passed"), F.col("confidence_delta")).otherwise(-F.col("confidence_delta"))).otherwise(0.0)
    total = hooks.groupBy(*keys).agg(F.sum(step).alias("_t"))
    limited = F.greatest(F.lit(-MAX_HOOK_DELTA), F.least(F.lit(MAX_HOOK_DELTA), F.col("_t")))
    final = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + limited))
    return total.select(*keys, round2(limited).alias("confidence_delta"), round2(final).alias("final_confidence"))


def resolve_files(listing: DataFrame, patterns: Sequence[str], recent: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """Files of each repo that fit a rule's file patterns, in pattern order, then recent files.

    A pattern is a glob on the path, on the base name when it has no slash, or part of the path.
    Only the first ``limit`` files per repo travel to the final list.
    """
    place = F.lit(None).cast("int")
    for i, raw in reversed(list(enumerate(patterns))):
        p = raw.strip().replace("**/", "").replace("**", "*")
        if not p:
            continue
        hit = F.rlike("path", F.lit(glob_regex(p))) | F.contains("path", F.lit(p))
        if "/" not in p:
            hit = hit | F.rlike(base_name(F.col("path")), F.lit(glob_regex(p)))
        place = F.when(hit, F.lit(i)).otherwise(place)
    rows = listing.select("repo", "path", place.alias("o")).filter("o IS NOT NULL").withColumn("o2", F.col("path"))
    if recent is not None:
        later = recent.select("repo", F.col("file").alias("path"), F.lit(len(patterns)).alias("o"), F.format_string("%09d", F.col("rank")).alias("o2"))
        rows = rows.unionByName(later)
        rows = rows.groupBy("repo", "path").agg(F.min(F.struct("o", "o2")).alias("f")).select("repo", "path", "f.o", "f.o2")
    w = W.partitionBy("repo").orderBy("o", "o2")
    top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return top.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("f")).select(
        "repo", F.transform("f", lambda x: x["path"]).alias("files")
    )
