"""Run-history analytics: recurrence, rule and hook quality, stability metrics, policy.

Tables: ``runs(run_id, pipeline, matched, failure_id, completed_at, input_hash, output_hash)``,
``findings(run_id, rank, failure_id, title, category, confidence, signature_hash, seen_at)``,
``matches(run_id, rank, rule_id)``, ``hooks(run_id, rule_id, signature_hash, hook_id, category,
status, passed, confidence_delta, executed_at)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from culprit.functions.text import round2
from culprit.operators.ordered import running_number, time_bucket

# --- fixed values: sizes and thresholds of the metrics and of the policy -----------------------
HISTORY_SIZE = 500
MIN_TSS, MIN_FPC, MIN_PHI = 2, 3, 5
WARN_TSS, WARN_FPC, WARN_PHI = 0.5, 0.7, 0.5
BLOCK_TSS, QUARANTINE_TSS, OBSERVE_TSS = 0.8, 0.5, 0.3
QUARANTINE_FPC, QUARANTINE_PHI, OBSERVE_PHI = 0.5, 0.4, 0.6
# --- end of fixed values --------------------------------------------------------------------------


def recurrence(findings: DataFrame) -> DataFrame:
    """First seen, last seen and occurrences per signature (leading findings only).

    Grouped with the failure id as a key first: all values are then of fixed width, so the
    large step is a hash aggregate with map-side combine.
    """
    per_failure = findings.filter("rank = 1").groupBy("signature_hash", "failure_id").agg(
        F.min("seen_at").alias("first"), F.max("seen_at").alias("last"), F.count("*").alias("n")
    )
    return per_failure.groupBy("signature_hash").agg(
        F.min_by("failure_id", F.struct("first", "failure_id")).alias("failure_id"),
        F.min("first").alias("first_seen_at"),
        F.max("last").alias("last_seen_at"),
        F.sum("n").alias("occurrence_count"),
    )


def lookup_signatures(candidates: DataFrame, signatures: DataFrame) -> DataFrame:
    """Attach what is known about each candidate's signature."""
    known = signatures.select("signature_hash", "first_seen_at", "last_seen_at", "occurrence_count")
    out = candidates.join(known, "signature_hash", "left")
    return out.withColumn("occurrence_count", F.coalesce("occurrence_count", F.lit(0))).withColumn(
        "seen_before", F.col("occurrence_count") > 0
    )


def recurring_signatures(findings: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent signatures with the title and category of their latest finding."""
    latest = (
        findings.filter("rank = 1")
        .groupBy("signature_hash")
        .agg(F.max_by(F.struct("title", "category"), F.struct("seen_at", "run_id")).alias("l"))
    )
    return (
        recurrence(findings)
        .join(latest, "signature_hash")
        .select(
            "signature_hash", "failure_id", F.coalesce("l.title", F.lit("")).alias("title"),
            F.coalesce("l.category", F.lit("")).alias("category"), "occurrence_count", "first_seen_at", "last_seen_at",
        )
        .orderBy(F.desc("occurrence_count"), F.desc("last_seen_at"), "signature_hash")
        .limit(limit)
    )


def recent_findings(findings: DataFrame, signature_hash: str, limit: int = 10) -> DataFrame:
    return (
        findings.filter((F.col("rank") == 1) & (F.col("signature_hash") == signature_hash.strip()))
        .select("run_id", "failure_id", "title", "category", "signature_hash", "seen_at")
        .orderBy(F.desc("seen_at"), F.desc("run_id"))
        .limit(limit)
    )


def rule_quality(findings: DataFrame, matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Per rule: times selected and matched, average rank and confidence, recurrence."""
    leading = findings.filter("rank = 1")
    # texts are keys here and values only in the small second step: the large one is a hash
    # aggregate, and a hot rule reaches the second step already reduced
    per_title = leading.groupBy("failure_id", "signature_hash", "title", "category").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("conf"), F.max("seen_at").alias("seen_at")
    )
    per_signature = per_title.groupBy("failure_id", "signature_hash").agg(
        F.sum("n").alias("n"), F.sum("conf").alias("conf"), F.max("title").alias("title"),
        F.max("category").alias("category"), F.max("seen_at").alias("seen_at"),
    )
    totals = per_signature.groupBy("signature_hash").agg(F.sum("n").alias("occurrences"))
    recurring = F.col("occurrences") > 1
    selected = (
        per_signature.join(totals, "signature_hash")
        .groupBy("failure_id")
        .agg(
            F.coalesce(F.max("title"), F.lit("")).alias("title"),
            F.coalesce(F.max("category"), F.lit("")).alias("category"),
            F.sum("n").alias("selected_count"),
            F.sum(F.when(recurring, F.col("n")).otherwise(0)).alias("recurring_run_count"),
            F.sum(recurring.cast("bigint")).alias("recurring_signatures"),
            (F.sum("conf") / F.sum("n")).alias("avg_confidence"),
            F.max("seen_at").alias("last_seen_at"),
        )
    )
    matched = matches.groupBy(F.col("rule_id").alias("failure_id")).agg(
        F.count("*").alias("match_count"), F.avg(F.col("rank").cast("double")).alias("match_rank")
    )
    out = selected.join(matched, "failure_id", "left").select(
        "failure_id", "title", "category", "selected_count",
        F.coalesce("match_count", "selected_count").alias("matched_count"),
        F.greatest(F.coalesce("match_count", "selected_count") - F.col("selected_count"), F.lit(0)).alias("non_selected_count"),
        F.coalesce("match_rank", F.lit(1.0)).alias("avg_rank"),
        "recurring_run_count", "recurring_signatures", "avg_confidence", "last_seen_at",
    )
    if limit is None:
        return out
    return out.orderBy(F.desc("selected_count"), F.desc("last_seen_at"), "failure_id").limit(limit)


def _status(name: str) -> Column:
    return F.col("status") == name


def _hook_counts() -> list[Column]:
    done = _status("executed")
    return [
        F.count("*").alias("total_count"),
        F.sum(done.cast("bigint")).alias("executed_count"),
        F.sum((_status("failed") | (done & (F.col("passed") == F.lit(False)))).cast("bigint")).alias("failed_count"),
        F.sum(_status("blocked").cast("bigint")).alias("blocked_count"),
        F.sum(_status("skipped").cast("bigint")).alias("skipped_count"),
    ]


def hook_history(hooks: DataFrame) -> DataFrame:
    """Outcome counts per (signature, rule)."""
    passed = F.sum((_status("executed") & (F.col("passed") == F.lit(True))).cast("bigint"))
    out = hooks.groupBy("signature_hash", "rule_id").agg(
        *_hook_counts(), passed.alias("passed_count"), F.max("executed_at").alias("last_seen_at")
    )
    return out.fillna(0)


def hook_quality(hooks: DataFrame, limit: int | None = None) -> DataFrame:
    """Outcome counts per (rule, hook, category)."""
    out = hooks.groupBy("rule_id", "hook_id", "category").agg(
        *_hook_counts(),
        F.sum((F.col("passed") == F.lit(True)).cast("bigint")).alias("passed_count"),
        F.avg("confidence_delta").alias("avg_confidence_delta"),
        F.max("executed_at").alias("last_seen_at"),
    ).fillna(0, ["executed_count", "failed_count", "blocked_count", "skipped_count", "passed_count"])
    if limit is None:
        return out
    return out.orderBy(F.desc("total_count"), F.desc("last_seen_at"), "rule_id", "hook_id", "category").limit(limit)


def determinism(runs: DataFrame) -> DataFrame:
    """Per input hash: runs, distinct outputs, and whether the answer is stable."""
    kept = runs.filter("coalesce(output_hash, '') <> ''")
    return (
        kept.groupBy("input_hash")
        .agg(
            F.count("*").alias("run_count"),
            F.countDistinct("output_hash").alias("distinct_outputs"),
            F.min("completed_at").alias("first_seen_at"),
            F.max("completed_at").alias("last_seen_at"),
        )
        .withColumn("stable", F.col("distinct_outputs") <= 1)
    )


def recent_failures(runs: DataFrame, limit: int = HISTORY_SIZE) -> DataFrame:
    """Latest matched runs with their failure."""
    return (
        runs.filter("matched AND coalesce(failure_id, '') <> ''")
        .select("run_id", "failure_id", "completed_at")
        .orderBy(F.desc("completed_at"), F.desc("run_id"))
        .limit(limit)
    )


def seen_counts(runs: DataFrame) -> DataFrame:
    return runs.filter("coalesce(failure_id, '') <> ''").groupBy("failure_id").agg(F.count("*").alias("seen_count"))


def stability(runs: DataFrame, keys: Sequence[str] = ("pipeline",), size: int = HISTORY_SIZE, block: int = 50_000) -> DataFrame:
    """TSS of each matched run: share of the same failure among it and the ``size`` matched runs before.

    Runs are numbered per pipeline and cut into blocks; each block also gets the last ``size``
    runs of the block before as context, so its frames are complete and a hot pipeline is split.
    """
    keys = list(keys)
    matched = runs.filter("matched AND coalesce(failure_id, '') <> ''").select(*keys, "run_id", "failure_id", "completed_at")
    numbered = running_number(matched, keys, ["completed_at", "run_id"], time_bucket(F.col("completed_at")), "rn")
    home = F.floor((F.col("rn") - 1) / block)
    reach = F.floor((F.col("rn") - 1 + size) / block)
    spread = numbered.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(home, reach)))
    same = W.partitionBy(*keys, "_block", "failure_id").orderBy("rn").rangeBetween(-size, 0)
    counted = spread.withColumn("_seen", F.count("*").over(same)).filter("_home = _block")
    n = F.least(F.col("rn"), F.lit(size + 1))
    return counted.select(
        *keys, "run_id", "failure_id", "completed_at", n.alias("history_count"), F.col("_seen").alias("seen"),
        F.when(n >= MIN_TSS, round2(F.col("_seen") / n)).alias("tss"),
    )


def health(history: DataFrame, keys: Sequence[str] = ("pipeline",)) -> DataFrame:
    """FPC, dominant failure and PHI per pipeline from history lines (``matched``, ``failure_id``)."""
    keys = list(keys)
    per_failure = history.groupBy(*keys, "matched", F.coalesce("failure_id", F.lit("")).alias("failure_id")).agg(
        F.count("*").alias("c")
    )
    counted = F.col("matched") & (F.col("failure_id") != "")
    g = per_failure.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(F.col("matched"), F.col("c"))), F.lit(0)).alias("n_matched"),
        F.coalesce(F.max(F.when(counted, F.col("c"))), F.lit(0)).alias("top_count"),
        F.min_by("failure_id", F.when(counted, F.struct((-F.col("c")).alias("c"), "failure_id"))).alias("top_failure"),
    )
    share = F.when(F.col("n_matched") == 0, 0.0).otherwise(F.col("top_count") / F.col("n_matched"))
    g = g.withColumn("dominant_share", share)
    g = g.withColumn("fpc", F.when(F.col("n") >= MIN_FPC, round2(F.col("n_matched") / F.col("n"))))
    return g.withColumn("phi", F.when(F.col("n") >= MIN_PHI, round2(F.col("fpc") * (1 - F.col("dominant_share")))))


def _percent(c: Column) -> Column:
    return F.bround(c * 100, 0).cast("int")


def metrics(stability_rows: DataFrame, health_rows: DataFrame, keys: Sequence[str] = ("pipeline",)) -> DataFrame:
    """Metrics of each matched run with the drift components they imply."""
    keys = list(keys)
    m = stability_rows.join(health_rows, keys, "left")
    drift = F.array_sort(
        F.array_compact(
            F.array(
                F.when(
                    (F.col("tss") >= WARN_TSS) & (F.col("seen") > 0),
                    F.format_string("persistent failure: %s is %d%% of recent analyzed runs", F.col("failure_id"), _percent(F.col("tss"))),
                ),
                F.when(
                    F.col("fpc") < WARN_FPC,
                    F.format_string("low coverage: %d of %d analyzed runs had no playbook match", F.col("n") - F.col("n_matched"), F.col("n")),
                ),
                F.when(
                    (F.col("phi") < WARN_PHI) & F.col("top_failure").isNotNull(),
                    F.format_string("dominant pattern: %s is %d%% of matched failures", F.col("top_failure"), _percent(F.col("dominant_share"))),
                ),
            )
        )
    )
    return m.withColumn("drift_components", drift)


def policy(rows: DataFrame, severity: str = "severity") -> DataFrame:
    """Advisory recommendation with its reason and basis; NULL without any metric."""
    tss, fpc, phi, sev = F.col("tss"), F.col("fpc"), F.col("phi"), F.col(severity)
    none = tss.isNull() & fpc.isNull() & phi.isNull()
    blocking = (tss >= BLOCK_TSS) & sev.isin("critical", "high")
    low = [
        ("tss", tss >= QUARANTINE_TSS, F.format_string("TSS %.2f (recurring pattern)", tss)),
        ("fpc", fpc < QUARANTINE_FPC, F.format_string("FPC %.2f (low pattern coverage)", fpc)),
        ("phi", phi < QUARANTINE_PHI, F.format_string("PHI %.2f (degraded pipeline health)", phi)),
    ]
    parts = F.array_compact(F.array(*[F.when(c, t) for _, c, t in low]))
    bases = F.array_compact(F.array(*[F.when(c, F.lit(b)) for b, c, _ in low]))
    cases = [
        (none, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")),
        (
            blocking, F.lit("blocking"),
            F.format_string(
                "persistent critical failure: TSS %.2f with %s severity — recommend halting until root cause is resolved", tss, sev
            ),
            F.array(F.lit("tss")),
        ),
        (F.size(parts) > 0, F.lit("quarantine"), F.concat(F.lit("isolate and review: "), F.array_join(parts, "; ")), bases),
        (
            tss >= OBSERVE_TSS, F.lit("observe"),
            F.format_string("pattern emerging: TSS %.2f — monitor for continued recurrence", tss), F.array(F.lit("tss")),
        ),
        (
            phi < OBSERVE_PHI, F.lit("observe"),
            F.format_string("pipeline health degrading: PHI %.2f — review failure mix", phi), F.array(F.lit("phi")),
        ),
    ]
    out = {"recommendation": None, "reason": None, "basis": None}
    for cond, *values in cases:
        for name, v in zip(out, values):
            out[name] = F.when(cond, v) if out[name] is None else out[name].when(cond, v)
    rest = {"recommendation": F.lit("ok"), "reason": F.lit("metrics within acceptable range"), "basis": F.array().cast("array<string>")}
    return rows.withColumns({n: c.otherwise(rest[n]) for n, c in out.items()})


def output_hash(columns: Sequence[str]) -> Column:
    """Hash of the stable columns of an analysis row."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def workflow_runs(table: DataFrame, limit: int = 20) -> DataFrame:
    """Latest workflow executions."""
    return table.orderBy(F.desc("finished_at"), F.desc("id")).limit(limit)


def span_text(first: Column, last: Column) -> Column:
    """Length of a history: days from two days up, else hours, else minutes, else nothing."""
    seconds = F.timestamp_diff("SECOND", first, last)
    return (
        F.when(seconds >= 48 * 3600, F.concat(F.floor(seconds / 86400), F.lit("d")))
        .when(seconds >= 3600, F.concat(F.floor(seconds / 3600), F.lit("h")))
        .when(seconds >= 60, F.concat(F.floor(seconds / 60), F.lit("m")))
        .otherwise(F.lit(""))
    )
