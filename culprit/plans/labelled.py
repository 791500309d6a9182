"""Queries on labelled logs."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from culprit.functions import text as tx
from culprit.functions.storage import stored
from culprit.operators import labelled as lb
from culprit.operators import match as mt
from culprit.operators import rules as ru
from culprit.plans import demo, sql

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


FIX = """SELECT d.doc_id AS log_id, concat('prov', d.doc_id % 4) AS provider, concat('ad', d.doc_id % 2) AS adapter,
 CASE WHEN d.doc_id % 10 = 0 THEN '' WHEN l.toxic = 1 THEN 'stutter' WHEN d.lang = 'fr' THEN 'french-text' WHEN d.lang = 'es' THEN 'spanish-text'
   WHEN d.lang = 'de' THEN 'german-text' WHEN l.quality = 1 THEN 'boilerplate-line' ELSE 'stutter' END AS expected_rule,
 CASE d.doc_id % 3 WHEN 0 THEN 'minimal' WHEN 1 THEN 'real' ELSE 'staging' END AS fixture_class,
 CASE WHEN d.doc_id % 4 = 0 THEN 2 ELSE 0 END AS top_n, d.doc_id % 5 = 0 AS strict_top1, CASE WHEN d.doc_id % 6 = 0 THEN 'test' ELSE '' END AS expected_stage,
 CASE WHEN d.doc_id % 7 = 0 THEN 'stutter' ELSE 'mixed-markup' END AS disallowed_rule, d.doc_id % 3 AS max_unexpected,
 CASE WHEN d.doc_id % 8 = 0 THEN 0.6E0 ELSE 0.0E0 END AS min_confidence
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""


def fixtures(spark, sf):
    demo.table(spark, sf, "documents").createOrReplaceTempView("fx_documents")
    demo.table(spark, sf, "labels").createOrReplaceTempView("fx_labels")
    f = spark.sql(FIX.replace("documents d", "fx_documents d").replace("labels l", "fx_labels l"))
    return f.withColumn("disallowed", F.array("disallowed_rule"))


def evaluated(spark, sf, diagnosed=None):
    d = diagnosed() if diagnosed else mt.diagnose(demo.logs(spark, sf), demo.rules(spark), source="source")
    return lb.evaluate_fixtures(d, fixtures(spark, sf))


def evaluated_both(spark, sf):
    """All rules, and those of ``OTHER``: the texts are scanned once."""
    sets = [demo.rules(spark), ru.RuleSet.from_records(spark, OTHER)]
    each = cache(lambda: mt.diagnose_each(demo.logs(spark, sf), sets, source="source"))
    return [evaluated(spark, sf, lambda i=i: each()[i]) for i in range(len(sets))]


def evaluated_sql(rules=None):
    return f"""({sql.ranked(f''', fx AS ({FIX}), fy AS (SELECT *, CASE WHEN top_n > 0 THEN top_n WHEN fixture_class = 'minimal' THEN 1 ELSE 3 END AS allow,
  CASE WHEN min_confidence > 0 THEN min_confidence WHEN fixture_class = 'real' THEN 0.55 ELSE 0 END AS floor FROM fx),
 fz AS (SELECT f.*, s.stage, len(s.ls) = 0 AS is_empty, coalesce(min(r.rank) FILTER (WHERE r.rule_id = f.expected_rule), 0) AS expected_rank,
   max(r.confidence) FILTER (WHERE r.rule_id = f.expected_rule) AS ec, max(r.rule_id) FILTER (WHERE r.rank = 1) AS top_rule,
   count(*) FILTER (WHERE r.rank <= greatest(allow, 3) AND r.rule_id <> f.expected_rule) AS unexpected_top_n,
   count(*) FILTER (WHERE r.rank <= greatest(allow, 3) AND r.rule_id = f.disallowed_rule) AS disallowed_hits
   FROM fy f JOIN staged s USING (log_id) LEFT JOIN ranked r USING (log_id) GROUP BY ALL),
 fw AS (SELECT *, expected_rule <> '' AS labelled, expected_stage <> '' AND stage <> expected_stage AS sm,
   CASE WHEN strict_top1 OR fixture_class = 'minimal' THEN expected_rank = 1 ELSE expected_rank > 0 AND expected_rank <= allow END AS okr FROM fz),
 ev AS (SELECT log_id, provider, adapter, expected_rule, fixture_class, expected_rank, top_rule, stage, labelled, unexpected_top_n, disallowed_hits,
   CASE WHEN NOT labelled THEN top_rule IS NOT NULL ELSE NOT is_empty AND okr AND NOT sm END AS success, labelled AND NOT (NOT is_empty AND okr AND NOT sm) AS unmatched,
   labelled AND NOT is_empty AND sm AS stage_mismatch,
   labelled AND NOT is_empty AND (coalesce(top_rule <> expected_rule, false) OR disallowed_hits > 0 OR (max_unexpected > 0 AND unexpected_top_n > max_unexpected)) AS false_positive,
   labelled AND NOT is_empty AND expected_rank > 0 AND (expected_rank > 1 OR ec < floor) AS weak_match FROM fw)''', rules)} SELECT * FROM ev)"""


EV = evaluated_sql()
COLS = "log_id, expected_rule, expected_rank::BIGINT AS expected_rank, top_rule, stage, labelled, success, unmatched, stage_mismatch, false_positive, weak_match, unexpected_top_n, disallowed_hits"


@register("fixture_verdicts", f"SELECT {COLS} FROM {EV}")
def fixture_verdicts(spark, sf):
    e = evaluated(spark, sf)
    return e.select("log_id", "expected_rule", F.col("expected_rank").cast("bigint").alias("expected_rank"), "top_rule", "stage", "labelled", "success",
                    "unmatched", "stage_mismatch", "false_positive", "weak_match", "unexpected_top_n", "disallowed_hits")


REPORT = """rep AS (SELECT count(*) AS fixture_count, count(*) FILTER (WHERE expected_rank = 1) AS top1_count, count(*) FILTER (WHERE expected_rank BETWEEN 1 AND 3) AS top3_count,
 count(*) FILTER (WHERE unmatched) AS unmatched_count, count(*) FILTER (WHERE false_positive) AS false_positive_count, count(*) FILTER (WHERE weak_match) AS weak_match_count FROM {e} WHERE labelled),
 report AS (SELECT *, top1_count::DOUBLE / fixture_count AS top1_rate, top3_count::DOUBLE / fixture_count AS top3_rate, unmatched_count::DOUBLE / fixture_count AS unmatched_rate,
 false_positive_count::DOUBLE / fixture_count AS false_positive_rate, weak_match_count::DOUBLE / fixture_count AS weak_match_rate FROM rep)"""


@register("fixture_report", f"WITH {REPORT.format(e=EV)} SELECT * FROM report")
def fixture_report(spark, sf):
    return lb.report(evaluated(spark, sf))


@register("problem_fixtures", f"WITH e AS {EV} SELECT 'unmatched' AS problem, log_id FROM e WHERE unmatched UNION ALL SELECT 'false_positive', log_id FROM e WHERE false_positive "
          "UNION ALL SELECT 'weak_match', log_id FROM e WHERE weak_match")
def problem_fixtures(spark, sf):
    return lb.problem_ids(evaluated(spark, sf))


BREAK = f"br AS (SELECT 'playbook' AS kind, expected_rule AS key, count(*) AS n FROM ({FIX}) WHERE expected_rule <> '' GROUP BY 2 UNION ALL SELECT 'provider', provider, count(*) FROM ({FIX}) GROUP BY 2 " \
        f"UNION ALL SELECT 'adapter', adapter, count(*) FROM ({FIX}) GROUP BY 2)"


@register("fixture_breakdowns", f"WITH {BREAK} SELECT * FROM br")
def fixture_breakdowns(spark, sf):
    return lb.breakdowns(fixtures(spark, sf).withColumn("labelled", F.col("expected_rule") != ""))


FP = f"""WITH {REPORT.format(e=EV)}, {BREAK}, t AS (SELECT string_agg(kind || ':' || key || ':' || n, '|' ORDER BY CASE kind WHEN 'playbook' THEN 0 WHEN 'provider' THEN 1 ELSE 2 END, key) AS c FROM br),
 fp AS (SELECT report.*, left(sha256(format('real:{{}}|{{:.4f}}|{{:.4f}}|{{:.4f}}|{{:.4f}}|{{:.4f}}', fixture_count, top1_rate, top3_rate, unmatched_rate, false_positive_rate, weak_match_rate) || '|' || c), 16) AS fingerprint FROM report, t)"""


@register("report_fingerprint", FP + " SELECT fixture_count, fingerprint FROM fp")
def report_fingerprint(spark, sf):
    e = evaluated(spark, sf)
    return lb.report_fingerprint(lb.report(e), lb.breakdowns(e), "real").select("fixture_count", "fingerprint")


BASELINE = {
    "fixture_count": 100, "top1_rate": 0.9, "top3_rate": 0.2, "unmatched_rate": 0.01, "false_positive_rate": 0.9, "weak_match_rate": 0.0,
    "thresholds": {"min_top_1": 0.65, "min_top_3": 0.85, "max_unmatched": 0.15, "max_false_positive": 0.35, "max_weak_match": 0.15},
    "fingerprint": "0000000000000000",
}


def _gate_sql():
    t = BASELINE["thresholds"]
    c = ["CASE WHEN fixture_count <> 100 THEN format('fixture count changed: baseline={} current={}', 100, fixture_count) END"]
    rates = [("top-1", "top1_rate", "min_top_1", "<"), ("top-3", "top3_rate", "min_top_3", "<"), ("unmatched", "unmatched_rate", "max_unmatched", ">"),
             ("false-positive", "false_positive_rate", "max_false_positive", ">"), ("weak-match", "weak_match_rate", "max_weak_match", ">")]
    for n, col, k, op in rates:
        c.append(f"CASE WHEN {col} {op} {t[k]} THEN format('{n} rate {{:.3f}} {'is below' if op == '<' else 'exceeds'} threshold {{:.3f}}', {col}, {t[k]}::DOUBLE) END")
    for n, col, k, op in rates:
        c.append(f"CASE WHEN {col} {op} {BASELINE[col]} THEN format('{n} rate regressed from {{:.3f}} to {{:.3f}}', {BASELINE[col]}::DOUBLE, {col}) END")
    c.append("CASE WHEN fingerprint <> '0000000000000000' THEN format('corpus fingerprint changed: baseline={} current={}', '0000000000000000', fingerprint) END")
    return FP + f" SELECT array_to_string(list_filter([{', '.join(c)}], lambda e: e IS NOT NULL), '|') AS violations FROM fp"


@register("baseline_gate", _gate_sql())
def baseline_gate(spark, sf):
    e = evaluated(spark, sf)
    r = lb.report_fingerprint(lb.report(e), lb.breakdowns(e), "real")
    return lb.baseline_gate(r, BASELINE).select(F.array_join("violations", "|").alias("violations"))


OTHER = [r for r in demo.RULES if r["rule_id"] not in ("mixed-markup", "spanish-text")]


@register(
    "mode_changes",
    f"""WITH a AS {EV}, b AS {evaluated_sql(OTHER)} SELECT a.log_id, a.expected_rank::BIGINT AS baseline_rank, b.expected_rank::BIGINT AS other_rank,
 CASE WHEN b.expected_rank > 0 AND (a.expected_rank = 0 OR b.expected_rank < a.expected_rank) THEN 'improved' WHEN a.expected_rank > 0 AND (b.expected_rank = 0 OR b.expected_rank > a.expected_rank) THEN 'regressed'
 ELSE 'unchanged' END AS change FROM a JOIN b USING (log_id) WHERE b.labelled""",
)
def mode_changes(spark, sf):
    c = lb.compare_modes(*evaluated_both(spark, sf))
    return c.select("log_id", F.col("baseline_rank").cast("bigint").alias("baseline_rank"), F.col("other_rank").cast("bigint").alias("other_rank"), "change")


@register(
    "mode_summary",
    f"""WITH ch AS ({ORACLES['mode_changes']}), n AS (SELECT count(*) FILTER (WHERE change = 'improved') AS improved, count(*) FILTER (WHERE change = 'regressed') AS regressed,
  count(*) FILTER (WHERE change = 'unchanged') AS unchanged, avg((baseline_rank = 1)::INT) AS b1, avg((other_rank = 1)::INT) AS o1,
  avg((baseline_rank BETWEEN 1 AND 3)::INT) AS b3, avg((other_rank BETWEEN 1 AND 3)::INT) AS o3 FROM ch)
SELECT improved, regressed, unchanged, b1 AS baseline_top1_rate, o1 AS other_top1_rate, b3 AS baseline_top3_rate, o3 AS other_top3_rate,
 trunc((o1 - b1) * 1000 + 0.5) / 1000 AS top1_delta, trunc((o3 - b3) * 1000 + 0.5) / 1000 AS top3_delta FROM n""",
)
def mode_summary(spark, sf):
    a, b = (stored(e.select("log_id", "expected_rank", "labelled", "unmatched", "false_positive", "weak_match")) for e in evaluated_both(spark, sf))
    return lb.mode_summary(lb.report(a), lb.report(b), lb.compare_modes(a, b))


META = """SELECT doc_id AS log_id, CASE doc_id % 3 WHEN 0 THEN 'minimal' WHEN 1 THEN 'real' ELSE 'staging' END AS fixture_class, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS title,
 CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'ad' END AS adapter, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END AS provider, CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'u' END AS url,
 CASE WHEN doc_id % 23 = 0 THEN NULL ELSE 'promoted' END AS review_status, CASE WHEN doc_id % 29 = 0 THEN '' ELSE '2024' END AS promoted_at,
 CASE WHEN doc_id % 31 = 0 THEN '' ELSE {fp} END AS fingerprint FROM documents"""


def _meta(spark, sf):
    demo.table(spark, sf, "documents").createOrReplaceTempView("meta_documents")
    return spark.sql(META.format(fp="substring(sha2(text, 256), 1, 16)").replace("FROM documents", "FROM meta_documents"))


def _blank(c):
    return f"trim(coalesce({c}, '')) = ''"


@register(
    "metadata_issues",
    f"WITH m AS ({META.format(fp='left(sha256(text), 16)')}) SELECT log_id, 'missing field' AS issue, 'fingerprint' AS detail FROM m WHERE fingerprint = '' "
    + "".join(f"UNION ALL SELECT log_id, 'missing field', '{n}' FROM m WHERE fixture_class = '{c}' AND {_blank(n)} "
              for c, ns in (("real", ["title", "adapter", "provider", "url", "promoted_at"]), ("staging", ["adapter", "provider", "url"])) for n in ns)
    + "UNION ALL SELECT log_id, 'review status must be promoted', coalesce(review_status, '') FROM m WHERE fixture_class = 'real' AND coalesce(review_status, '') <> 'promoted' "
    "UNION ALL SELECT min(log_id), 'duplicate fingerprint', fingerprint || ' x' || count(*) FROM m WHERE fingerprint <> '' GROUP BY fingerprint HAVING count(*) > 1",
)
def metadata_issues(spark, sf):
    return lb.metadata_issues(_meta(spark, sf))


@register(
    "prepared_fixtures",
    f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE lower(text) END AS n FROM documents), g AS (SELECT doc_id, array_to_string({sql.lines('n')}, chr(10)) AS t FROM f)
SELECT doc_id AS log_id, t AS text, left(sha256(t), 16) AS fingerprint, CASE WHEN doc_id % 2 = 0 THEN 'real' ELSE 'minimal' END AS fixture_class FROM g""",
)
def prepared_fixtures(spark, sf):
    d = demo.table(spark, sf, "documents").select(
        F.col("doc_id").alias("log_id"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.lower("text")).alias("normalized_log"),
        F.col("text").alias("raw_log"), F.when(F.col("doc_id") % 2 == 0, "real").alias("fixture_class"), F.lit("").alias("fingerprint"),
    )
    return lb.prepare_fixtures(d).select("log_id", "text", "fingerprint", "fixture_class")


@register(
    "ingest_new_fixtures",
    """WITH f AS (SELECT doc_id AS log_id, source, left(sha256(text), 16) AS fingerprint FROM documents)
SELECT min(log_id) AS log_id, arg_min(source, log_id) AS source, fingerprint FROM f WHERE log_id % 3 <> 0 AND fingerprint NOT IN (SELECT fingerprint FROM f WHERE log_id % 3 = 0) GROUP BY fingerprint""",
)
def ingest_new_fixtures(spark, sf):
    f = demo.logs(spark, sf).select("log_id", "source", tx.fixture_fingerprint(F.col("text")).alias("fingerprint"))
    return lb.ingest_new(f.filter("log_id % 3 <> 0"), f.filter("log_id % 3 = 0")).select("log_id", "source", "fingerprint")


@register(
    "promoted_fixtures",
    """SELECT d.doc_id AS log_id, d.lang, 'real' AS fixture_class, 'promoted' AS review_status, '2024-01-01T00:00:00Z' AS promoted_at,
 CASE WHEN l.quality = 1 THEN 'french-text' ELSE 'stutter' END AS expected_rule FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def promoted_fixtures(spark, sf):
    staging = demo.table(spark, sf, "documents").select(
        F.col("doc_id").alias("log_id"), "lang", F.lit("staging").alias("fixture_class"), F.lit("").alias("expected_rule"))
    accepted = demo.table(spark, sf, "labels").select(F.col("doc_id").alias("log_id"), F.when(F.col("quality") == 1, "french-text").otherwise("stutter").alias("expected_rule"))
    return lb.promote(staging, accepted, F.lit("2024-01-01T00:00:00Z")).select("log_id", "lang", "fixture_class", "review_status", "promoted_at", "expected_rule")


@register(
    "rule_coverage",
    f"""WITH {sql.rule_rows()}, n AS (SELECT expected_rule AS rule_id, count(*) AS n FROM ({FIX}) WHERE expected_rule <> '' GROUP BY 1)
SELECT category, count(*) AS rule_count, count(n) AS covered_rules, coalesce(sum(n), 0)::BIGINT AS fixture_count, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (WHERE n IS NULL), '') AS uncovered
FROM rules LEFT JOIN n USING (rule_id) GROUP BY 1""",
)
def rule_coverage(spark, sf):
    c = lb.rule_coverage(demo.rules(spark).rules, fixtures(spark, sf))
    return c.withColumn("uncovered", F.array_join("uncovered", ","))


@register(
    "pack_provenance",
    sql.results() + "SELECT pack, count(*) AS matched_logs FROM results JOIN rules ON rule_id = failure_id GROUP BY 1",
)
def pack_provenance(spark, sf):
    """Matched logs per pack of the winning rule."""
    r = mt.evaluate_logs(demo.logs(spark, sf), demo.rules(spark)).filter("matched").groupBy(F.col("failure_id").alias("rule_id")).agg(F.count("*").alias("n"))
    return r.join(demo.rules(spark).rules.select("rule_id", "pack"), "rule_id").groupBy("pack").agg(F.sum("n").alias("matched_logs"))


@register("pack_counts", """SELECT CASE item_id % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'team' ELSE 'custom' END AS pack, count(*) AS rule_count FROM benchmark GROUP BY 1""")
def pack_counts(spark, sf):
    b = demo.table(spark, sf, "benchmark").select(F.when(F.col("item_id") % 3 == 0, "starter").when(F.col("item_id") % 3 == 1, "team").otherwise(" ").alias("pack"))
    return ru.pack_counts(b)


@register(
    "taxonomy_rollup",
    sql.results() + "SELECT domain, class, mode, count(*) AS n, grouping_id(domain, class, mode)::BIGINT AS level FROM results JOIN rules ON rule_id = failure_id GROUP BY ROLLUP (domain, class, mode)",
)
def taxonomy_rollup(spark, sf):
    return lb.taxonomy_rollup(mt.evaluate_logs(demo.logs(spark, sf), demo.rules(spark)), demo.rules(spark).rules).withColumn("level", F.col("level").cast("bigint"))


@register(
    "review_duplicates",
    sql.ranked(f""", d_b AS (SELECT doc_id AS log_id, left(sha256(text), 16) AS fp, list_sort(list_distinct(list_filter(list_transform(string_split(lower(text), chr(10)), lambda l: {sql.trim_space('l')}), lambda l: l <> ''))) AS hs FROM documents),
 d_s AS (SELECT hs, min(log_id) AS set_id, count(*) AS set_size, count(DISTINCT fp) AS n_prints FROM d_b GROUP BY hs),
 d_p AS (SELECT a.set_id AS sa, c.set_id AS sb, c.set_size AS nb, len(list_intersect(a.hs, c.hs))::DOUBLE / (len(a.hs) + len(c.hs) - len(list_intersect(a.hs, c.hs))) AS sim
   FROM d_s a JOIN d_s c ON a.set_id <> c.set_id AND len(a.hs) > 0),
 d_q AS (SELECT sa AS set_id, list_sort(list(sb) FILTER (WHERE sim >= 0.82)) AS near, sum(nb) FILTER (WHERE sim >= 0.82) AS near_count, max(sim) AS best FROM d_p GROUP BY 1),
 d_g AS (SELECT fp, list_sort(list(log_id))[1:2] AS ids, count(*) AS copies FROM d_b GROUP BY 1),
 d_t AS (SELECT log_id, list(rule_id ORDER BY rank) AS top3 FROM ranked WHERE rank <= 3 GROUP BY 1),
 d_j AS (SELECT d_b.log_id, d_g.copies, d_g.ids, d_s.set_id, d_s.set_size, d_s.n_prints, d_q.near, d_q.near_count, d_q.best, d_t.top3
   FROM d_b JOIN d_g USING (fp) JOIN d_s ON d_s.hs = d_b.hs LEFT JOIN d_q ON d_q.set_id = d_s.set_id LEFT JOIN d_t ON d_t.log_id = d_b.log_id)""") + """
SELECT log_id, CASE WHEN copies > 1 THEN 'duplicate' WHEN n_prints > 1 OR near IS NOT NULL THEN 'near-duplicate' ELSE 'candidate' END AS status,
 CASE WHEN copies > 1 THEN CASE WHEN log_id = ids[1] THEN ids[2] ELSE ids[1] END END AS duplicate_of, CASE WHEN copies > 1 OR n_prints > 1 THEN 1.0 ELSE coalesce(best, 0.0) END AS similarity,
 CASE WHEN copies = 1 THEN array_to_string(list_sort(list_concat(coalesce(near, []), CASE WHEN n_prints > 1 THEN [set_id] ELSE [] END)), ',') END AS near_sets,
 CASE WHEN copies = 1 THEN (coalesce(near_count, 0) + set_size - 1)::BIGINT END AS near_count,
 top3[1] AS predicted_top, coalesce(array_to_string(top3, ','), '') AS predicted_top3 FROM d_j""",
)
def review_duplicates(spark, sf):
    logs = demo.logs(spark, sf)
    r = lb.review_duplicates(logs, diagnosed=mt.diagnose(logs, demo.rules(spark)))
    return r.withColumn("near_sets", F.array_join(F.col("near_sets").cast("array<string>"), ",")).withColumn("predicted_top3", F.array_join("predicted_top3", ","))
