"""Queries on silent failures, unknown failures, traces and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from culprit.functions import classify as cl
from culprit.operators import match as mt
from culprit.operators import rules as ru
from culprit.operators import silent as si
from culprit.operators import trace as tr
from culprit.operators import unknown as uk
from culprit.plans import demo, sql
from culprit.plans.sql import any_of, lit
from culprit.plans.texts import noise_sql, score_sql, unknown_sql

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def _silent_sql():
    parts = []
    for i, d in enumerate(si.DETECTORS):
        groups = [[w.lower() for w in g] for g in d.groups]
        cond = " AND ".join(any_of("array_to_string(ns, chr(10))", g) for g in groups)
        if d.line_level:
            cond += f" AND len(list_filter(ns, lambda l: {any_of('l', groups[0])} AND NOT {any_of('l', groups[1])})) > 0"
        shown = [w for k in d.evidence for w in groups[k]]
        ev = f"list_filter(ls, lambda l: {any_of('lower(l)', shown)})"
        if d.distinct:
            ev = f"list_filter({ev}, lambda x, i: NOT list_contains(({ev})[1:i - 1], x))"
        parts.append(
            f"SELECT log_id, {lit(d.name)} AS detector, '{d.severity}' AS severity, '{d.confidence}' AS confidence, {i} AS o, "
            f"({ev})[1:{d.limit}] AS evidence FROM logs WHERE {cond}"
        )
    return (
        f"WITH {sql.staged('event_logs')}, f AS (" + " UNION ALL ".join(parts) + "), findings AS (SELECT log_id, detector, severity, confidence, "
        "array_to_string(evidence, chr(10)) AS evidence, row_number() OVER (PARTITION BY log_id ORDER BY (severity = 'high') DESC, "
        "(confidence = 'high') DESC, o) AS rank FROM f)"
    )


@register("silent_findings", _silent_sql() + " SELECT * FROM findings")
def silent_findings(spark, sf):
    f = si.silent_findings(demo.event_logs(spark, sf))
    return f.select("log_id", "detector", "severity", "confidence", F.array_join("evidence", "\n").alias("evidence"),
                    F.col("rank").cast("bigint").alias("rank"))


CI = sql.results(demo.CI_RULES[:3], "event_logs")


def ci_some(spark):
    return ru.RuleSet.from_records(spark, demo.CI_RULES[:3])


@register(
    "silent_promotion",
    f"""WITH r AS ({CI} SELECT log_id, matched, failure_id FROM results), s AS ({_silent_sql()} SELECT log_id, detector FROM findings WHERE rank = 1)
SELECT r.log_id, CASE WHEN matched THEN failure_id ELSE coalesce(detector, '') END AS primary_id,
 CASE WHEN matched THEN 'explicit' WHEN detector IS NOT NULL THEN 'silent' ELSE 'none' END AS kind,
 CASE WHEN matched OR detector IS NOT NULL THEN 'failure' ELSE 'unknown' END AS status, NOT matched AND detector IS NOT NULL AS gate_failed
FROM r LEFT JOIN s USING (log_id)""",
)
def silent_promotion(spark, sf):
    logs = demo.event_logs(spark, sf)
    return si.promote(mt.evaluate_logs(logs, ci_some(spark), source="source"), si.silent_findings(logs), fail_on_silent=True)


def _unknown_sql(source):
    return f"""WITH {sql.staged(source)}, l AS (SELECT log_id, stage, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM staged),
 k AS (SELECT * FROM l WHERE NOT {noise_sql('line')} QUALIFY row_number() OVER (PARTITION BY log_id, lower(line) ORDER BY n) = 1),
 s AS (SELECT log_id, stage, line AS pattern, {score_sql('line')}::BIGINT AS score FROM k),
 c AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY score DESC, pattern) AS rank FROM s QUALIFY rank <= 8),
 d AS (SELECT *, {unknown_sql('pattern', 'stage')} AS category FROM c WHERE rank <= 5)"""


@register("candidate_patterns", _unknown_sql("event_logs") + " SELECT log_id, rank, pattern, score, stage FROM c")
def candidate_patterns(spark, sf):
    c = uk.candidate_patterns(demo.event_logs(spark, sf))
    return c.select("log_id", F.col("rank").cast("bigint").alias("rank"), "pattern", F.col("score").cast("bigint").alias("score"), "stage")


@register("candidate_patterns_documents", _unknown_sql("documents") + " SELECT log_id, rank, pattern, score, stage FROM c")
def candidate_patterns_documents(spark, sf):
    c = uk.candidate_patterns(demo.logs(spark, sf))
    return c.select("log_id", F.col("rank").cast("bigint").alias("rank"), "pattern", F.col("score").cast("bigint").alias("score"), "stage")


@register(
    "candidate_clusters",
    _unknown_sql("event_logs") + """, g AS (SELECT log_id, category, string_agg(pattern, '|' ORDER BY rank) AS signals FROM d GROUP BY 1, 2)
SELECT log_id, category, signals, greatest(0.45 - (row_number() OVER (PARTITION BY log_id ORDER BY category) - 1) * 0.08, 0.2)::DOUBLE AS confidence FROM g""",
)
def candidate_clusters(spark, sf):
    c = uk.candidate_clusters(uk.candidate_patterns(demo.event_logs(spark, sf)))
    return c.select("log_id", "category", "confidence", F.array_join("signals", "|").alias("signals"))


@register(
    "rule_seeds",
    _unknown_sql("event_logs") + f""", g AS (SELECT log_id, string_agg(pattern, '|' ORDER BY rank) AS match_any, arg_min(category, rank) AS category FROM d GROUP BY 1)
SELECT *, 'Observed ' || category || ' failure signature' AS title,
 CASE category {' '.join(f"WHEN '{k}' THEN {lit('|'.join(v))}" for k, v in cl.UNKNOWN_LIKELY_FILES.items())} END AS likely_files FROM g""",
)
def rule_seeds(spark, sf):
    s = uk.rule_seeds(uk.candidate_patterns(demo.event_logs(spark, sf)))
    return s.select("log_id", "category", "title", F.array_join("match_any", "|").alias("match_any"), F.array_join("likely_files", "|").alias("likely_files"))


def _trace_sql():
    return f"""WITH {sql.staged('event_logs')}, {sql.pattern_rows(demo.CI_RULES)}, tp AS (SELECT *, lower({sql.clean('pattern')}) AS tn FROM raw_patterns),
 h AS (SELECT s.log_id, p.*, list_position(list_transform(s.ns, lambda l: contains(l, p.tn)), true) AS line_no, s.ls FROM staged s, tp p),
 t1 AS (SELECT log_id, rule_id, section, idx::BIGINT AS position, pattern,
   CASE WHEN section = 'none' AND line_no IS NOT NULL THEN 'blocked' WHEN section = 'none' THEN 'clear' WHEN line_no IS NOT NULL THEN 'matched' ELSE 'missing' END AS status,
   coalesce(line_no::VARCHAR, '') AS line_nos, coalesce(ls[line_no], '') AS lines FROM h WHERE section <> 'partial'),
 g AS (SELECT log_id, rule_id, group_idx, max(group_min) AS k, count(*) AS n, count(line_no) AS hit, string_agg(pattern, ' | ' ORDER BY idx) AS pats,
   list(line_no ORDER BY idx) FILTER (WHERE line_no IS NOT NULL) AS nos, any_value(ls) AS ls FROM h WHERE section = 'partial' GROUP BY 1, 2, 3),
 g2 AS (SELECT *, coalesce(list_filter(nos, lambda x, i: NOT list_contains(nos[1:i - 1], x)), []) AS dn FROM g),
 t AS (SELECT * FROM t1 UNION ALL SELECT log_id, rule_id, 'partial', group_idx::BIGINT, format('{{}}-of-{{}}: {{}}', k, n, pats),
   CASE WHEN hit >= k THEN 'matched' ELSE 'missing' END, array_to_string(dn, ','), array_to_string(list_transform(dn, lambda i: ls[i]), chr(10)) FROM g2)"""


@register("rule_trace", _trace_sql() + " SELECT log_id, rule_id, section, position, pattern, status, line_nos, coalesce(lines, '') AS lines FROM t")
def rule_trace(spark, sf):
    t = tr.trace_rules(demo.event_logs(spark, sf), demo.ci_rules(spark))
    return t.select("log_id", "rule_id", "section", F.col("position").cast("bigint").alias("position"), "pattern", "status",
                    F.array_join(F.col("line_nos").cast("array<string>"), ",").alias("line_nos"), F.array_join("lines", "\n").alias("lines"))


def _line(name, words):
    return f"CASE WHEN {name} > 0 THEN {name} || ' {words}' END"


@register(
    "trace_reasons",
    f"""WITH t AS ({_trace_sql()} SELECT * FROM t), r AS ({sql.ranked(rules=demo.CI_RULES, source='event_logs')} SELECT log_id, rule_id FROM ranked),
 c AS (SELECT log_id, rule_id, count(*) FILTER (WHERE section = 'any' AND status = 'matched') AS am, count(*) FILTER (WHERE section = 'all' AND status = 'matched') AS lm,
  count(*) FILTER (WHERE section = 'all' AND status = 'missing') AS lx, count(*) FILTER (WHERE section = 'partial' AND status = 'matched') AS pm,
  count(*) FILTER (WHERE section = 'partial' AND status = 'missing') AS px, count(*) FILTER (WHERE status = 'clear') AS nc, count(*) FILTER (WHERE status = 'blocked') AS nb
  FROM t GROUP BY 1, 2),
 w AS (SELECT c.*, r.rule_id IS NOT NULL AS ranked FROM c LEFT JOIN r USING (log_id, rule_id)),
 y AS (SELECT log_id, rule_id, ranked, list_filter(CASE WHEN ranked THEN
  [{_line('am', 'trigger rule(s) matched explicit log evidence')}, {_line('lm', 'required rule(s) matched')}, {_line('pm', 'partial group(s) reached their threshold')},
   {_line('nc', 'exclusion rule(s) stayed clear')}, {_line('nb', 'exclusion rule(s) were triggered')}, 'matched evidence was pulled directly from the input log']
  ELSE [CASE WHEN am = 0 THEN 'no trigger rule matched the input log' END, {_line('lx', 'required rule(s) were missing')},
   {_line('px', 'partial group(s) did not reach their threshold')}, {_line('nb', 'exclusion rule(s) blocked the playbook')}] END, lambda e: e IS NOT NULL) AS why FROM w)
SELECT log_id, rule_id, ranked, CASE WHEN len(why) = 0 THEN 'the playbook did not reach a ranked match' ELSE array_to_string(why, '; ') END AS why FROM y""",
)
def trace_reasons(spark, sf):
    logs, rules = demo.event_logs(spark, sf), demo.ci_rules(spark)
    t = tr.rule_reasons(logs, rules, mt.match_rules(logs, rules))
    return t.select("log_id", "rule_id", "ranked", F.array_join("why", "; ").alias("why"))


K = sql.ranked(rules=demo.CI_RULES, source="event_logs")


@register("match_ranked_ci", K + "SELECT log_id, rule_id, stage, score, confidence, rank, array_to_string(evidence, chr(10)) AS evidence FROM ranked")
def match_ranked_ci(spark, sf):
    r = mt.match_rules(demo.event_logs(spark, sf), demo.ci_rules(spark))
    return r.select("log_id", "rule_id", "stage", "score", "confidence", F.col("rank").cast("bigint").alias("rank"), F.array_join("evidence", "\n").alias("evidence"))


@register("pattern_hits", f"""WITH {sql.staged()}, {sql.pattern_rows()}, n AS (SELECT DISTINCT norm FROM patterns)
SELECT log_id, norm, list_position(list_transform(ns, lambda l: contains(l, norm)), true)::BIGINT AS line_no FROM staged JOIN n ON contains(array_to_string(ns, chr(10)), norm)""")
def pattern_hits(spark, sf):
    h = mt.first_pattern_lines(demo.logs(spark, sf), demo.rules(spark).normalized_patterns())
    return h.select("log_id", "norm", F.col("line_no").cast("bigint").alias("line_no"))


SHINGLES = f"""SELECT DISTINCT lower({sql.collapse('l')}) AS norm FROM (SELECT unnest(regexp_extract_all(text, '[^ \\n]+ [^ \\n]+ [^ \\n]+ [^ \\n]+')) AS l FROM benchmark)"""


@register("pattern_hits_large", f"""WITH {sql.staged()}, n AS ({SHINGLES}), h AS (SELECT log_id, norm, ns FROM staged JOIN n ON contains(array_to_string(ns, chr(10)), norm))
SELECT log_id, norm, list_position(list_transform(ns, lambda l: contains(l, norm)), true)::BIGINT AS line_no FROM h""")
def pattern_hits_large(spark, sf):
    """Four-word pieces of the benchmark passages as patterns."""
    from culprit.functions import text as tx

    pieces = F.explode(F.regexp_extract_all("text", F.lit("[^ \n]+ [^ \n]+ [^ \n]+ [^ \n]+"), F.lit(0)))
    lines = demo.table(spark, sf, "benchmark").select(pieces.alias("l"))
    norms = lines.select(tx.normalize_pattern(F.col("l")).alias("norm"))
    h = mt.first_pattern_lines(demo.logs(spark, sf), norms)
    return h.select("log_id", "norm", F.col("line_no").cast("bigint").alias("line_no"))


CATALOGUE_SQL = f"""WITH {sql.staged()}, w AS (SELECT string_split(lower(text), ' ') AS w FROM conversations UNION ALL SELECT string_split(lower(text), ' ') FROM benchmark),
 n AS (SELECT DISTINCT ' ' || array_to_string(w[i:i + 2], ' ') || ' ' AS norm FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w) WHERE NOT contains(array_to_string(w[i:i + 2], ' '), chr(10))),
 l AS (SELECT log_id, generate_subscripts(ns, 1) AS line_no, string_split(unnest(ns), ' ') AS w FROM staged),
 s AS (SELECT log_id, line_no, ' ' || array_to_string(w[i:i + 2], ' ') || ' ' AS norm FROM (SELECT log_id, line_no, w, unnest(range(2, len(w) - 2)) AS i FROM l))
SELECT log_id, norm, min(line_no)::BIGINT AS line_no FROM s SEMI JOIN n USING (norm) GROUP BY ALL"""


@register("pattern_hits_catalogue", CATALOGUE_SQL)
def pattern_hits_catalogue(spark, sf):
    """A catalogue of hundreds of thousands of patterns: all three-word windows of the conversations and benchmark passages,
    with a space at both ends, so that SQL can find them by words."""
    w, texts = F.split(F.lower("text"), " "), [demo.table(spark, sf, t).select(F.col("text")) for t in ("conversations", "benchmark")]
    windows = texts[0].unionByName(texts[1]).select(w.alias("w")).filter(F.size("w") > 2)
    at = F.explode(F.sequence(F.lit(1), F.size("w") - 2))
    norms = windows.select("w", at.alias("i")).select(F.concat(F.lit(" "), F.array_join(F.slice("w", F.col("i"), 3), " "), F.lit(" ")).alias("norm"))
    h = mt.first_pattern_lines(demo.logs(spark, sf), norms.filter(~F.contains("norm", F.lit("\n"))))
    return h.select("log_id", "norm", F.col("line_no").cast("bigint").alias("line_no"))


@register("excluded_pairs", sql.ranked() + "SELECT log_id, rule_id FROM candidates WHERE blocked AND positive > 0")
def excluded_pairs(spark, sf):
    return mt.excluded_pairs(demo.logs(spark, sf), demo.rules(spark))


@register("guard_findings", sql.ranked() + "SELECT log_id, rule_id, score, confidence FROM ranked WHERE confidence >= 0.5 AND score >= 3.5 "
          "QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY rank) <= 1")
def guard_findings(spark, sf):
    r = mt.match_rules(demo.logs(spark, sf), demo.rules(spark))
    return mt.guard(r, min_confidence=0.5, top=1).select("log_id", "rule_id", "score", "confidence")


@register("second_candidate", sql.ranked() + "SELECT log_id, rule_id, score FROM ranked WHERE rank = 2")
def second_candidate(spark, sf):
    return mt.select_rank(mt.match_rules(demo.logs(spark, sf), demo.rules(spark)), 2).select("log_id", "rule_id", "score")


@register("category_filter", sql.ranked(rules=[r for r in demo.RULES if r["category"] == "test"]) + "SELECT log_id, rule_id, score, confidence FROM ranked")
def category_filter(spark, sf):
    rules = demo.rules(spark).filter_rules(F.col("category") == "test")
    return mt.match_rules(demo.logs(spark, sf), rules.by_detector("log")).select("log_id", "rule_id", "score", "confidence")


@register("unmatched_logs", sql.results() + "SELECT log_id FROM results WHERE NOT matched AND error = ''")
def unmatched_logs(spark, sf):
    return mt.unmatched(mt.evaluate_logs(demo.logs(spark, sf), demo.rules(spark))).select("log_id")


@register("idf_weights", f"""WITH p AS (SELECT item_id, lower({sql.collapse('l')}) AS norm FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS l FROM benchmark))
SELECT norm, count(DISTINCT item_id) AS n_rules, 1.0::DOUBLE / count(DISTINCT item_id) AS weight FROM p WHERE norm <> '' GROUP BY 1""")
def idf_weights(spark, sf):
    """Each benchmark passage as a rule with its words as patterns."""
    return ru.idf_weights(_word_rules(spark, sf))


def _word_rules(spark, sf):
    words = F.posexplode(F.split(F.lower("text"), " "))
    p = demo.table(spark, sf, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("rule_id"), "item_id", words.alias("idx", "pattern"))
    section = F.when(F.col("idx") % 11 == 0, "none").when(F.col("idx") % 7 == 0, "all").otherwise("any")
    return p.select("rule_id", F.lit("any").alias("section"), F.lit(0).alias("group_idx"), F.lit(0).alias("group_min"), "idx", "pattern",
                    section.alias("mixed"))


@register("pattern_conflicts", """WITH p AS (SELECT 'item-' || item_id AS rule_id, unnest(string_split(lower(text), ' ')) AS pattern,
  generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM benchmark),
 q AS (SELECT DISTINCT rule_id, trim(pattern) AS norm, CASE WHEN i % 11 = 0 THEN 'none' WHEN i % 7 = 0 THEN 'all' ELSE 'any' END AS section FROM
   (SELECT rule_id, i, regexp_replace(pattern, '\\s+', ' ', 'g') AS pattern FROM p) WHERE trim(pattern) <> '')
SELECT norm, count(DISTINCT rule_id) FILTER (WHERE section <> 'none') AS positive_rules, count(*) FILTER (WHERE section = 'none') AS negative_refs,
 coalesce(string_agg(rule_id || ':' || section, ',' ORDER BY rule_id || ':' || section) FILTER (WHERE section <> 'none'), '') AS positive_at,
 coalesce(string_agg(rule_id || ':' || section, ',' ORDER BY rule_id || ':' || section) FILTER (WHERE section = 'none'), '') AS negative_at
FROM q GROUP BY 1 HAVING positive_rules > 1 OR (positive_rules > 0 AND negative_refs > 0)""")
def pattern_conflicts(spark, sf):
    p = _word_rules(spark, sf).withColumn("section", F.col("mixed")).drop("mixed")
    return ru.pattern_conflicts(p).select("norm", "positive_rules", "negative_refs", F.array_join("positive_at", ",").alias("positive_at"),
                                          F.array_join("negative_at", ",").alias("negative_at"))


@register("rule_checks", """WITH r AS (SELECT 'item-' || item_id AS rule_id, CASE WHEN item_id % 5 = 0 THEN '' ELSE text END AS title,
  CASE WHEN item_id % 4 = 0 THEN NULL ELSE 'fix' END AS fix, CASE WHEN item_id % 9 = 0 THEN 'metric' ELSE 'log' END AS detector FROM benchmark),
 p AS (SELECT 'item-' || item_id AS rule_id, unnest(string_split(lower(text), ' ')) AS norm, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM benchmark),
 q AS (SELECT rule_id, trim(regexp_replace(norm, '\\s+', ' ', 'g')) AS norm, CASE WHEN i % 11 = 0 THEN 'none' WHEN i % 7 = 0 THEN 'all' ELSE 'any' END AS section FROM p),
 f AS (SELECT rule_id, norm, bool_or(section = 'any') AS a, bool_or(section = 'all') AS b, count(*) FILTER (WHERE section = 'all') AS nb, bool_or(section = 'none') AS n
   FROM q WHERE norm <> '' GROUP BY 1, 2)
SELECT rule_id, 'missing field' AS problem, 'title' AS detail FROM r WHERE title = '' UNION ALL SELECT rule_id, 'missing field', 'fix' FROM r WHERE fix IS NULL
UNION ALL SELECT rule_id, 'unknown detector', detector FROM r WHERE detector <> 'log'
UNION ALL SELECT rule_id, 'pattern listed twice', norm FROM f WHERE (a AND b) OR nb > 1
UNION ALL SELECT rule_id, 'pattern both positive and excluded', norm FROM f WHERE n AND (a OR b)""")
def rule_checks(spark, sf):
    b = demo.table(spark, sf, "benchmark")
    rid = F.concat(F.lit("item-"), F.col("item_id"))
    rules = b.select(
        rid.alias("rule_id"), F.when(F.col("item_id") % 5 == 0, "").otherwise(F.col("text")).alias("title"),
        F.when(F.col("item_id") % 4 != 0, "fix").alias("fix"), F.when(F.col("item_id") % 9 == 0, "metric").otherwise("log").alias("detector"),
    )
    p = _word_rules(spark, sf).withColumn("section", F.col("mixed")).drop("mixed")
    return ru.check_rules(ru.RuleSet(rules, p))
