"""Queries on run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from culprit.operators import history as hi
from culprit.plans import demo
from culprit.plans.demo import RUNS_SQL

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = f"WITH {RUNS_SQL}" + oracle
        return fn

    return add


def t(c):
    """Timestamps as text, to the second, in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def ts(c, alias=None):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {alias or c}"


SIGS = """, sigs AS (SELECT signature_hash, arg_min(failure_id, (seen_at, run_id)) AS failure_id, min(seen_at) AS first_seen_at,
 max(seen_at) AS last_seen_at, count(*) AS occurrence_count FROM findings WHERE rank = 1 GROUP BY 1)"""
SPAN = """CASE WHEN date_diff('second', first_seen_at, last_seen_at) >= 172800 THEN (date_diff('second', first_seen_at, last_seen_at) // 86400) || 'd'
 WHEN date_diff('second', first_seen_at, last_seen_at) >= 3600 THEN (date_diff('second', first_seen_at, last_seen_at) // 3600) || 'h'
 WHEN date_diff('second', first_seen_at, last_seen_at) >= 60 THEN (date_diff('second', first_seen_at, last_seen_at) // 60) || 'm' ELSE '' END"""


@register(
    "signature_recurrence",
    SIGS + f" SELECT signature_hash, failure_id, {ts('first_seen_at')}, {ts('last_seen_at')}, occurrence_count, "
    f"{SPAN.replace('first_seen_at', '''date_trunc('second', first_seen_at)''').replace('last_seen_at', '''date_trunc('second', last_seen_at)''')} AS span FROM sigs",
)
def signature_recurrence(spark, sf):
    r = hi.recurrence(demo.history(spark, sf, "findings"))
    span = hi.span_text(F.date_trunc("second", "first_seen_at"), F.date_trunc("second", "last_seen_at"))
    return r.select("signature_hash", "failure_id", t("first_seen_at"), t("last_seen_at"), "occurrence_count", span.alias("span"))


@register(
    "signature_lookup",
    SIGS.replace("WHERE rank = 1", "WHERE rank = 1 AND run_id % 4 <> 0")
    + f" SELECT f.run_id, f.signature_hash, coalesce(s.occurrence_count, 0) AS occurrence_count, s.signature_hash IS NOT NULL AS seen_before, {ts('first_seen_at')} "
    "FROM findings f LEFT JOIN sigs s USING (signature_hash) WHERE f.run_id % 4 = 0",
)
def signature_lookup(spark, sf):
    f = demo.history(spark, sf, "findings")
    known = hi.recurrence(f.filter("run_id % 4 <> 0"))
    c = hi.lookup_signatures(f.filter("run_id % 4 = 0").select("run_id", "signature_hash"), known)
    return c.select("run_id", "signature_hash", "occurrence_count", "seen_before", t("first_seen_at"))


@register(
    "recurring_signatures",
    SIGS + f""", l AS (SELECT signature_hash, arg_max(title, (seen_at, run_id)) AS title, arg_max(category, (seen_at, run_id)) AS category FROM findings WHERE rank = 1 GROUP BY 1)
SELECT signature_hash, failure_id, title, category, occurrence_count, {ts('first_seen_at')}, {ts('sigs.last_seen_at', 'last_seen_at')} FROM sigs JOIN l USING (signature_hash)
ORDER BY occurrence_count DESC, sigs.last_seen_at DESC, signature_hash LIMIT 25""",
)
def recurring_signatures(spark, sf):
    r = hi.recurring_signatures(demo.history(spark, sf, "findings"), 25)
    return r.select("signature_hash", "failure_id", "title", "category", "occurrence_count", t("first_seen_at"), t("last_seen_at"))



@register(
    "recent_findings",
    f" SELECT run_id, failure_id, title, {ts('seen_at')} FROM findings WHERE rank = 1 AND signature_hash = sha256('error:8:0') ORDER BY findings.seen_at DESC, run_id DESC LIMIT 10",
)
def recent_findings(spark, sf):
    import hashlib

    r = hi.recent_findings(demo.history(spark, sf, "findings"), hashlib.sha256(b"error:8:0").hexdigest())
    return r.select("run_id", "failure_id", "title", t("seen_at"))


@register(
    "rule_quality",
    SIGS + f""", pm AS (SELECT rule_id, count(*) AS mc, avg(rank) AS ar FROM matches GROUP BY 1)
SELECT f.failure_id, max(f.title) AS title, max(f.category) AS category, count(*) AS selected_count, coalesce(pm.mc, count(*)) AS matched_count,
 greatest(coalesce(pm.mc, count(*)) - count(*), 0) AS non_selected_count, coalesce(pm.ar, 1.0) AS avg_rank,
 sum((s.occurrence_count > 1)::INT)::BIGINT AS recurring_run_count, count(DISTINCT CASE WHEN s.occurrence_count > 1 THEN f.signature_hash END) AS recurring_signatures,
 avg(f.confidence) AS avg_confidence, {ts('max(f.seen_at)', 'last_seen_at')}
FROM findings f LEFT JOIN sigs s ON s.signature_hash = f.signature_hash LEFT JOIN pm ON pm.rule_id = f.failure_id WHERE f.rank = 1
GROUP BY f.failure_id, pm.mc, pm.ar""",
)
def rule_quality(spark, sf):
    q = hi.rule_quality(demo.history(spark, sf, "findings"), demo.history(spark, sf, "matches"))
    return q.withColumn("last_seen_at", t("last_seen_at"))


HOOKS = """count(*) AS total_count, count(*) FILTER (WHERE status = 'executed') AS executed_count,
 count(*) FILTER (WHERE status = 'failed' OR (status = 'executed' AND NOT passed)) AS failed_count, count(*) FILTER (WHERE status = 'blocked') AS blocked_count,
 count(*) FILTER (WHERE status = 'skipped') AS skipped_count"""


@register(
    "hook_history",
    f" SELECT signature_hash, rule_id, {HOOKS}, count(*) FILTER (WHERE status = 'executed' AND passed) AS passed_count, {ts('max(executed_at)', 'last_seen_at')} FROM hooks GROUP BY 1, 2",
)
def hook_history(spark, sf):
    return hi.hook_history(demo.history(spark, sf, "hooks")).withColumn("last_seen_at", t("last_seen_at"))


@register(
    "hook_quality",
    f" SELECT rule_id, hook_id, category, {HOOKS}, count(*) FILTER (WHERE passed) AS passed_count, avg(confidence_delta) AS avg_confidence_delta, {ts('max(executed_at)', 'last_seen_at')} FROM hooks GROUP BY 1, 2, 3",
)
def hook_quality(spark, sf):
    return hi.hook_quality(demo.history(spark, sf, "hooks")).withColumn("last_seen_at", t("last_seen_at"))


@register(
    "run_determinism",
    f" SELECT input_hash, count(*) AS run_count, count(DISTINCT output_hash) AS distinct_outputs, {ts('min(completed_at)', 'first_seen_at')}, {ts('max(completed_at)', 'last_seen_at')}, "
    "count(DISTINCT output_hash) <= 1 AS stable FROM runs WHERE output_hash <> '' GROUP BY 1",
)
def run_determinism(spark, sf):
    d = hi.determinism(demo.history(spark, sf, "runs"))
    return d.withColumn("first_seen_at", t("first_seen_at")).withColumn("last_seen_at", t("last_seen_at"))


@register("recent_failures", f" SELECT run_id, failure_id, {ts('completed_at')} FROM runs WHERE matched ORDER BY runs.completed_at DESC, run_id DESC LIMIT 500")
def recent_failures(spark, sf):
    return hi.recent_failures(demo.history(spark, sf, "runs")).select("run_id", "failure_id", t("completed_at"))


@register("seen_counts", " SELECT failure_id, count(*) AS seen_count FROM runs WHERE failure_id IS NOT NULL GROUP BY 1")
def seen_counts(spark, sf):
    return hi.seen_counts(demo.history(spark, sf, "runs"))


SIZE = 20
TSS = f""", m AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY completed_at, run_id) AS rn FROM runs WHERE matched),
 w AS (SELECT *, list(failure_id) OVER (PARTITION BY pipeline ORDER BY rn ROWS BETWEEN {SIZE} PRECEDING AND CURRENT ROW) AS h FROM m),
 stab AS (SELECT pipeline, run_id, failure_id, completed_at, len(h) AS history_count, len(list_filter(h, lambda x: x = failure_id)) AS seen,
  CASE WHEN len(h) >= 2 THEN round(len(list_filter(h, lambda x: x = failure_id))::DOUBLE / len(h) * 100) / 100 END AS tss FROM w)"""
HEALTH = """, pf AS (SELECT pipeline, failure_id, count(*) AS c FROM runs WHERE matched GROUP BY 1, 2),
 tp AS (SELECT pipeline, max(c) AS top_count, arg_min(failure_id, (-c, failure_id)) AS top_failure FROM pf GROUP BY 1),
 hn AS (SELECT pipeline, count(*) AS n, count(*) FILTER (WHERE matched) AS n_matched FROM runs GROUP BY 1),
 h1 AS (SELECT hn.*, coalesce(top_count, 0) AS top_count, top_failure, CASE WHEN n_matched = 0 THEN 0.0 ELSE top_count::DOUBLE / n_matched END AS dominant_share,
   CASE WHEN n >= 3 THEN round(n_matched::DOUBLE / n * 100) / 100 END AS fpc FROM hn LEFT JOIN tp USING (pipeline)),
 health AS (SELECT *, CASE WHEN n >= 5 THEN round(fpc * (1 - dominant_share) * 100) / 100 END AS phi FROM h1)"""


@register("run_stability", TSS + " SELECT pipeline, run_id, failure_id, history_count, seen, tss FROM stab")
def run_stability(spark, sf):
    # a short block and history make the split visible on small data
    return hi.stability(demo.history(spark, sf, "runs"), size=SIZE, block=25).drop("completed_at")


@register("pipeline_health", HEALTH + " SELECT * FROM health")
def pipeline_health(spark, sf):
    return hi.health(demo.history(spark, sf, "runs"))


METRICS = TSS + HEALTH + """, met AS (SELECT s.pipeline, s.run_id, s.failure_id, s.tss, h.fpc, h.phi, list_sort(list_filter([
  CASE WHEN s.tss >= 0.5 THEN format('persistent failure: {} is {:.0f}% of recent analyzed runs', s.failure_id, s.tss * 100) END,
  CASE WHEN h.fpc < 0.7 THEN format('low coverage: {} of {} analyzed runs had no playbook match', h.n - h.n_matched, h.n) END,
  CASE WHEN h.phi < 0.5 AND top_failure IS NOT NULL THEN format('dominant pattern: {} is {:.0f}% of matched failures', top_failure, dominant_share * 100) END],
  lambda e: e IS NOT NULL)) AS drift FROM stab s LEFT JOIN health h USING (pipeline))"""


def _metrics(spark, sf):
    runs = demo.history(spark, sf, "runs")
    return hi.metrics(hi.stability(runs, size=SIZE), hi.health(runs))


@register("run_metrics", METRICS + " SELECT pipeline, run_id, failure_id, tss, fpc, phi, array_to_string(drift, '|') AS drift_components FROM met")
def run_metrics(spark, sf):
    return _metrics(spark, sf).select("pipeline", "run_id", "failure_id", "tss", "fpc", "phi", F.array_join("drift_components", "|").alias("drift_components"))


@register(
    "run_policy",
    METRICS + """, sv AS (SELECT *, CASE failure_id WHEN 'error' THEN 'critical' WHEN 'click' THEN 'high' ELSE 'low' END AS severity FROM met),
 q AS (SELECT *, list_filter([CASE WHEN tss >= 0.5 THEN format('TSS {:.2f} (recurring pattern)', tss) END, CASE WHEN fpc < 0.5 THEN format('FPC {:.2f} (low pattern coverage)', fpc) END,
  CASE WHEN phi < 0.4 THEN format('PHI {:.2f} (degraded pipeline health)', phi) END], lambda e: e IS NOT NULL) AS parts FROM sv)
SELECT run_id, CASE WHEN tss IS NULL AND fpc IS NULL AND phi IS NULL THEN NULL WHEN tss >= 0.8 AND severity IN ('critical', 'high') THEN 'blocking' WHEN len(parts) > 0 THEN 'quarantine'
  WHEN tss >= 0.3 OR phi < 0.6 THEN 'observe' ELSE 'ok' END AS recommendation,
 CASE WHEN tss IS NULL AND fpc IS NULL AND phi IS NULL THEN NULL
  WHEN tss >= 0.8 AND severity IN ('critical', 'high') THEN format('persistent critical failure: TSS {:.2f} with {} severity — recommend halting until root cause is resolved', tss, severity)
  WHEN len(parts) > 0 THEN 'isolate and review: ' || array_to_string(parts, '; ') WHEN tss >= 0.3 THEN format('pattern emerging: TSS {:.2f} — monitor for continued recurrence', tss)
  WHEN phi < 0.6 THEN format('pipeline health degrading: PHI {:.2f} — review failure mix', phi) ELSE 'metrics within acceptable range' END AS reason FROM q""",
)
def run_policy(spark, sf):
    severity = F.when(F.col("failure_id") == "error", "critical").when(F.col("failure_id") == "click", "high").otherwise("low")
    p = hi.policy(_metrics(spark, sf).withColumn("severity", severity))
    return p.select("run_id", "recommendation", "reason")


@register("output_hashes", """ SELECT run_id, sha256('{"failure_id":"' || failure_id || '","title":"' || title || '","category":"' || category || '"}') AS output_hash FROM findings""")
def output_hashes(spark, sf):
    f = demo.history(spark, sf, "findings")
    return f.select("run_id", hi.output_hash(["failure_id", "title", "category"]).alias("output_hash"))


@register("workflow_runs", f" SELECT run_id AS id, hook_id AS workflow_id, status, {ts('executed_at', 'finished_at')} FROM hooks ORDER BY executed_at DESC, run_id DESC LIMIT 20")
def workflow_runs(spark, sf):
    h = demo.history(spark, sf, "hooks").select(F.col("run_id").alias("id"), F.col("hook_id").alias("workflow_id"), "status", F.col("executed_at").alias("finished_at"))
    return hi.workflow_runs(h).withColumn("finished_at", t("finished_at"))
