"""Queries on corpus jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from culprit.functions import text as tx
from culprit.operators import corpus as cp
from culprit.operators import match as mt
from culprit.plans import demo, sql
from culprit.plans.sql import chain, lit, trim_space
from culprit.plans.texts import CLUSTER, GAP_CLASS_SQL, GAP_CONF_SQL, REDACT, _prefix_sql

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def records(spark, sf):
    return demo.logs(spark, sf).select(F.col("text").alias("raw"), "source", F.col("log_id").alias("line_num"))


CAP = 2048
RAW = f"CASE WHEN strlen(text) <= {CAP} THEN text ELSE {_prefix_sql('text', CAP)} || chr(10) || '...[truncated]' END"
INGEST_SQL = f"""WITH c AS (SELECT doc_id AS line_num, source, {chain(RAW, REDACT)} AS raw FROM documents),
 i AS (SELECT *, sha256({trim_space('raw')}) AS fixture_id FROM c),
 f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY line_num) = 1)"""


@register("ingest_corpus", INGEST_SQL + " SELECT fixture_id, raw, source, line_num FROM f")
def ingest_corpus(spark, sf):
    return cp.ingest(records(spark, sf), max_bytes=tx.parse_size("2kb")).select("fixture_id", "raw", "source", "line_num")


@register(
    "ingest_counts",
    INGEST_SQL + " SELECT (SELECT count(*) FROM i) AS total, (SELECT count(*) FROM f) AS written, "
    "(SELECT count(*) FROM i) - (SELECT count(*) FROM f) AS skipped",
)
def ingest_counts(spark, sf):
    return cp.ingest_counts(cp.with_content_id(records(spark, sf), max_bytes=tx.parse_size("2kb")))


@register(
    "dedupe_documents",
    f"SELECT sha256({trim_space('text')}) AS fixture_id, min(doc_id) AS line_num, count(*) AS copies FROM documents GROUP BY 1",
)
def dedupe_documents(spark, sf):
    d = demo.logs(spark, sf).select(tx.content_id(F.col("text")).alias("fixture_id"), "log_id")
    return d.groupBy("fixture_id").agg(F.min("log_id").alias("line_num"), F.count("*").alias("copies"))


def results(spark, sf, rules=None):
    return mt.evaluate_logs(demo.logs(spark, sf), rules or demo.rules(spark), source="source")


R = sql.results()


@register(
    "coverage_total",
    R + "SELECT count(*) AS total, sum(matched::INT)::BIGINT AS matched, sum((NOT matched)::INT)::BIGINT AS unmatched, "
    "sum((error <> '')::INT)::BIGINT AS errors, avg(matched::INT) AS match_rate FROM results",
)
def coverage_total(spark, sf):
    return cp.coverage(results(spark, sf))


@register(
    "coverage_by_source",
    R + "SELECT source, count(*) AS total, sum(matched::INT)::BIGINT AS matched, sum((NOT matched)::INT)::BIGINT AS unmatched, "
    "sum((error <> '')::INT)::BIGINT AS errors, avg(matched::INT) AS match_rate FROM results GROUP BY ROLLUP (source)",
)
def coverage_by_source(spark, sf):
    return cp.coverage(results(spark, sf), by_source=True)


@register(
    "failure_distribution",
    R + "SELECT failure_id, count(*) AS count, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM results WHERE matched) AS pct "
    "FROM results WHERE matched GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def failure_distribution(spark, sf):
    return cp.failure_distribution(results(spark, sf))


@register(
    "unmatched_clusters",
    R + "SELECT first_line_tag AS tag, arg_min(first_line_snippet, log_id) AS snippet, count(*) AS count FROM results "
    "WHERE NOT matched AND first_line_tag <> '' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20",
)
def unmatched_clusters(spark, sf):
    return cp.unmatched_clusters(results(spark, sf))


GAP_SQL = f""", u AS (SELECT log_id, first_line_snippet AS line FROM results WHERE NOT matched AND error = ''),
 v AS (SELECT log_id, {CLUSTER} AS c FROM u), w AS (SELECT *, left(sha256(c), 8) AS signature FROM v),
 g AS (SELECT signature, count(*) AS count, arg_min(c, log_id) AS c, list_sort(list(log_id))[1:5] AS ids FROM w GROUP BY 1)
SELECT signature, count, c AS representative_line, array_to_string(ids, ',') AS sample_ids, {GAP_CLASS_SQL} AS suspected_class,
 ({GAP_CONF_SQL})::DOUBLE AS confidence, format('cluster-{{:03d}}', row_number() OVER (ORDER BY count DESC, signature)) AS cluster_id FROM g"""


def _gap(df):
    return df.select("signature", "count", "representative_line", F.array_join(F.col("sample_ids").cast("array<string>"), ",").alias("sample_ids"),
                     "suspected_class", "confidence", "cluster_id")


@register("gap_clusters", R.rstrip() + GAP_SQL)
def gap_clusters(spark, sf):
    return _gap(cp.gap_clusters(results(spark, sf)))


@register("gap_clusters_ci", sql.results(demo.CI_RULES[:2], "event_logs").rstrip() + GAP_SQL)
def gap_clusters_ci(spark, sf):
    from culprit.operators.rules import RuleSet

    r = mt.evaluate_logs(demo.event_logs(spark, sf), RuleSet.from_records(spark, demo.CI_RULES[:2]), source="source")
    return _gap(cp.gap_clusters(r))


@register(
    "label_outcomes",
    R + """, l AS (SELECT r.*, CASE WHEN b.quality = 1 THEN 'french-text' WHEN b.toxic = 1 THEN 'stutter' WHEN b.quality = 0 THEN 'german-text' END AS expected
  FROM results r LEFT JOIN labels b ON b.doc_id = r.log_id)
SELECT log_id, CASE WHEN expected IS NULL THEN 'unlabelled' WHEN matched AND failure_id = expected THEN 'TP' WHEN matched THEN 'FP' ELSE 'FN' END AS outcome FROM l""",
)
def label_outcomes(spark, sf):
    labels = demo.table(spark, sf, "labels")
    r = results(spark, sf).join(labels, F.col("doc_id") == F.col("log_id"), "left")
    expected = F.when(F.col("quality") == 1, "french-text").when(F.col("toxic") == 1, "stutter").when(F.col("quality") == 0, "german-text")
    return r.select("log_id", cp.label_outcome(F.col("matched"), F.col("failure_id"), expected).alias("outcome"))


@register(
    "label_rates",
    f"WITH o AS ({ORACLES['label_outcomes']}), n AS (SELECT count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'FP') AS fp, "
    "count(*) FILTER (WHERE outcome = 'FN') AS fn, count(*) FILTER (WHERE outcome = 'unlabelled') AS unlabelled FROM o) "
    "SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall FROM n",
)
def label_rates(spark, sf):
    return cp.outcome_rates(label_outcomes(spark, sf))


def _two(spark, sf):
    from culprit.operators.rules import RuleSet

    sets = [RuleSet.from_records(spark, r) for r in (demo.RULES[:-1], demo.RULES[1:])]
    return mt.evaluate_each(demo.logs(spark, sf), sets, source="source")


B = f"b AS ({sql.results(demo.RULES[:-1])} SELECT * FROM results), c AS ({sql.results(demo.RULES[1:])} SELECT * FROM results)"


@register(
    "determinism_diff",
    f"""WITH {B}, j AS (SELECT coalesce(b.log_id, c.log_id) AS log_id, b, c FROM b FULL JOIN c ON b.log_id = c.log_id)
SELECT log_id, 'matched' AS field, b.matched::VARCHAR AS baseline, c.matched::VARCHAR AS compare FROM j WHERE b.matched <> c.matched
UNION ALL SELECT log_id, 'failure_id', b.failure_id, c.failure_id FROM j WHERE b.failure_id <> c.failure_id
UNION ALL SELECT log_id, 'confidence', b.confidence::VARCHAR, c.confidence::VARCHAR FROM j WHERE b.confidence <> c.confidence
UNION ALL SELECT log_id, 'error', b.error, c.error FROM j WHERE b.error <> c.error
UNION ALL SELECT log_id, 'evidence', coalesce(array_to_string(b.evidence, chr(10)), ''), coalesce(array_to_string(c.evidence, chr(10)), '')
  FROM j WHERE b.evidence <> c.evidence""",
)
def determinism_diff(spark, sf):
    return cp.determinism_diff(*_two(spark, sf))


@register(
    "match_rate_delta",
    f"""WITH {B}, x AS (SELECT avg(matched::INT) AS baseline_match_rate, count(*) AS baseline_total FROM b),
 y AS (SELECT avg(matched::INT) AS current_match_rate, count(*) AS current_total FROM c)
SELECT *, current_match_rate - baseline_match_rate AS delta FROM x, y""",
)
def match_rate_delta(spark, sf):
    return cp.match_rate_delta(*_two(spark, sf))


@register(
    "rule_deltas",
    f"""WITH {B}, x AS (SELECT failure_id, count(*) AS n FROM b WHERE matched GROUP BY 1), y AS (SELECT failure_id, count(*) AS n FROM c WHERE matched GROUP BY 1)
SELECT failure_id, coalesce(x.n, 0) AS baseline_count, coalesce(y.n, 0) AS current_count, coalesce(y.n, 0) - coalesce(x.n, 0) AS delta,
 CASE WHEN coalesce(y.n, 0) < coalesce(x.n, 0) THEN 'lost' ELSE 'gained' END AS change
FROM x FULL JOIN y USING (failure_id) WHERE coalesce(y.n, 0) <> coalesce(x.n, 0)""",
)
def rule_deltas(spark, sf):
    return cp.rule_deltas(*_two(spark, sf))


@register(
    "new_unmatched_tags",
    f"""WITH b AS ({sql.results()} SELECT * FROM results), c AS ({sql.results(demo.RULES[:5])} SELECT * FROM results) SELECT DISTINCT first_line_tag AS tag FROM c WHERE NOT matched AND first_line_tag <> ''
EXCEPT SELECT first_line_tag FROM b WHERE NOT matched""",
)
def new_unmatched_tags(spark, sf):
    """Rules taken out: their logs turn up under new tags."""
    from culprit.operators.rules import RuleSet

    return cp.new_unmatched_tags(*mt.evaluate_each(demo.logs(spark, sf), [demo.rules(spark), RuleSet.from_records(spark, demo.RULES[:5])], source="source"))


@register(
    "quality_gate",
    f"""WITH {B}, x AS (SELECT avg(matched::INT) AS br FROM b), y AS (SELECT avg(matched::INT) AS cr FROM c),
 d AS (SELECT count(*) AS n FROM b JOIN c USING (log_id) WHERE b.matched <> c.matched OR b.failure_id <> c.failure_id OR b.confidence <> c.confidence
   OR b.error <> c.error OR b.evidence <> c.evidence),
 r AS (SELECT *, list_filter([CASE WHEN cr < 0.99 THEN format('match rate {{:.4f}} is below minimum {{:.4f}}', cr, 0.99::DOUBLE) END,
  CASE WHEN cr < br THEN format('coverage dropped by {{:.4f}} ({{:.4f}} → {{:.4f}})', br - cr, br, cr) END,
  CASE WHEN n > 0 THEN format('{{}} non-deterministic fixture(s) detected', n) END], lambda e: e IS NOT NULL) AS reasons FROM x, y, d)
SELECT len(reasons) = 0 AS pass, array_to_string(reasons, '|') AS fail_reasons, n AS n_unstable FROM r""",
)
def quality_gate(spark, sf):
    g = cp.quality_gate(*_two(spark, sf), min_match_rate=0.99, fail_on_drop=True, fail_on_nondeterminism=True)
    return g.select("pass", F.array_join("fail_reasons", "|").alias("fail_reasons"), "n_unstable")


TREE_SQL = """p AS (SELECT left(fixture_id, 6) AS p, sha256(string_agg(fixture_id, chr(10) ORDER BY fixture_id)) AS h FROM f GROUP BY 1),
 q AS (SELECT left(p, 3) AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h FROM p GROUP BY 1)"""


@register(
    "corpus_manifest",
    INGEST_SQL + f", {TREE_SQL} SELECT count(*) AS fixture_count, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source AS s FROM f)) AS sources, "
    "(SELECT sha256(string_agg(h, chr(10) ORDER BY p)) FROM q) AS tree_hash FROM f",
)
def corpus_manifest(spark, sf):
    m = cp.manifest(ingest_corpus(spark, sf).select("fixture_id", "source"))
    return m.select("fixture_count", F.array_join("sources", ",").alias("sources"), "tree_hash")


@register(
    "corpus_tree_hash",
    INGEST_SQL + f", {TREE_SQL} SELECT sha256(string_agg(h, chr(10) ORDER BY p)) AS tree_hash FROM q",
)
def corpus_tree_hash(spark, sf):
    return cp.tree_hash(ingest_corpus(spark, sf).select("fixture_id"))


@register(
    "coverage_summary",
    R + """, g AS (SELECT first_line_tag AS tag, arg_min(first_line_snippet, log_id) AS s, count(*) AS n FROM results WHERE NOT matched AND error = '' AND first_line_tag <> ''
  GROUP BY 1 ORDER BY n DESC, tag LIMIT 5), t AS (SELECT failure_id, count(*) AS n FROM results WHERE matched GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5)
SELECT count(*) AS total, sum(matched::INT)::BIGINT AS matched, avg(matched::INT) AS match_rate,
 (SELECT string_agg(failure_id, '|' ORDER BY n DESC, failure_id) FROM t) AS top_covered, (SELECT string_agg(s, '|' ORDER BY n DESC, tag) FROM g) AS top_gaps FROM results""",
)
def coverage_summary(spark, sf):
    s = cp.coverage_summary(results(spark, sf))
    return s.select("total", "matched", "match_rate", F.array_join("top_covered", "|").alias("top_covered"), F.array_join("top_gaps", "|").alias("top_gaps"))
