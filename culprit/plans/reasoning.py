"""Queries on the differential, re-ranking, comparison and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from culprit.functions.classify import fix_steps
from culprit.functions.signals import DEFAULT_WEIGHTS, SIGNALS, Signal, describe, split_signal
from culprit.functions.tables import small_table
from culprit.functions.text import canonicalize_log
from culprit.functions import stage as st
from culprit.operators import artifact as af
from culprit.operators import changes as ch
from culprit.operators import differential as df
from culprit.operators import match as mt
from culprit.operators import rerank as rr
from culprit.plans import demo, repos, sql
from culprit.plans.sql import any_of, lit
from culprit.plans.texts import TOKENS_SQL, file_class_sql

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


REGISTRY = {
    **SIGNALS,
    "test.failed": Signal("log", "a test failed", ["--- FAIL:", "FAILED  tests/", "assertionerror"]),
    "network.refused": Signal("log", "a peer refused the connection", ["refused by"]),
    "any.failure": Signal("union", "some failure was logged", ["test.failed", "network.refused"]),
    "cache.absent": Signal("absent", "no cache step", ["cache.restore.detected"]),
}
ITEMS = [
    [r["rule_id"], role, o, i, s, (-abs(w or DEFAULT_WEIGHTS[role]) if role == "contradict" else (w or DEFAULT_WEIGHTS.get(role, 0.0))),
     (d if role == "discriminator" and d else describe(s, REGISTRY)), describe(s, REGISTRY)]
    for r in demo.CI_RULES
    for o, role in enumerate(df.ROLES)
    for i, (s, w, d) in enumerate(r["hypothesis"][role])
]
NAMES = list(dict.fromkeys(x[4] for x in ITEMS))


def _delta(spark, sf):
    r = ch.successive_deltas(demo.event_logs(spark, sf), F.substring_index("log_id", "-", 1))
    return ch.change_signals(r.withColumn("files", F.array().cast("array<string>")), key="log_id")


DELTA_SQL = f"""ld AS ({repos.ORACLES['log_delta']}), delta AS (SELECT log_id, 'delta.test.failure.introduced' AS sig, replace(tests_newly_failing, '|', ', ') AS detail FROM ld WHERE tests_newly_failing <> ''
 UNION ALL SELECT log_id, 'delta.error.new', string_split(errors_added, '|')[1] FROM ld WHERE errors_added <> '')"""


def _norm(p):
    return " ".join(p.lower().split())


def _ev(ps):
    def lines(p):
        e = f"list_filter(ls, lambda l: contains(lower(l), {lit(_norm(p))}))"
        return f"(list_filter({e}, lambda x, i: NOT list_contains(({e})[1:i - 1], x)))[1:3]"

    return "CASE " + " ".join(f"WHEN contains(nl, {lit(_norm(p))}) THEN {lines(p)}" for p in ps) + " END"


def _sig_expr(name):
    head, v = split_signal(name)
    none = "[]::VARCHAR[]"
    has = "EXISTS (SELECT 1 FROM delta d WHERE d.log_id = b.log_id AND d.sig = {})"
    if name in REGISTRY:
        s = REGISTRY[name]
        if s.kind == "log":
            return _ev(s.values)
        if s.kind == "absent":
            return f"CASE WHEN ({_sig_expr(s.values[0])}) IS NULL THEN {none} END"
        if s.kind == "union":
            e = "list_concat(" + ", ".join(f"coalesce({_sig_expr(x)}, {none})" for x in s.values) + ")"
            return f"CASE WHEN len({e}) > 0 THEN {e} END"
        return f"CASE WHEN {has.format(lit(s.values[0]))} THEN {none} END"
    if head == "log.contains":
        return _ev([v])
    if head == "log.absent":
        return f"CASE WHEN NOT contains(nl, {lit(_norm(v))}) THEN {none} END"
    if head == "delta.signal":
        return f"CASE WHEN {has.format(lit(v))} THEN {none} END"
    if head == "context.stage":
        return f"CASE WHEN stage = {lit(v)} THEN ['stage: ' || stage] END"
    if head == "context.stage.absent":
        return f"CASE WHEN stage <> {lit(v)} THEN CASE WHEN stage = '' THEN {none} ELSE ['stage: ' || stage] END END"
    raise ValueError(name)


DIFF = sql.ranked(f""", {DELTA_SQL}, {sql.values('items', ['rule_id', 'role', 'o', 'idx', 'sig', 'w', 'text', 'plain'], ITEMS)},
 b AS (SELECT log_id, stage, ls, array_to_string(ns, chr(10)) AS nl FROM staged),
 sig AS ({' UNION ALL '.join(f"SELECT log_id, {lit(n)} AS sig, {_sig_expr(n)} AS ev FROM b" for n in NAMES)}),
 matched AS (SELECT log_id, sig, ev FROM sig WHERE ev IS NOT NULL),
 hit AS (SELECT r.log_id, r.rule_id, i.role, i.o, i.idx, i.sig, i.w, i.text, i.plain FROM ranked r JOIN items i USING (rule_id) JOIN matched m ON m.log_id = r.log_id AND m.sig = i.sig),
 asm AS (SELECT r.*, round((r.score + coalesce((SELECT sum(w) FROM hit h WHERE h.log_id = r.log_id AND h.rule_id = r.rule_id AND role <> 'exclude'), 0)) * 100) / 100 AS hypothesis_score,
   EXISTS (SELECT 1 FROM hit h WHERE h.log_id = r.log_id AND h.rule_id = r.rule_id AND role = 'exclude') AS eliminated,
   EXISTS (SELECT 1 FROM hit h WHERE h.log_id = r.log_id AND h.rule_id = r.rule_id) AS reasoned,
   coalesce((SELECT list(text ORDER BY CASE role WHEN 'support' THEN 0 ELSE 1 END, idx) FROM hit h WHERE h.log_id = r.log_id AND h.rule_id = r.rule_id AND role IN ('support', 'discriminator')), []) AS why0,
   coalesce((SELECT list(text ORDER BY idx) FROM hit h WHERE h.log_id = r.log_id AND h.rule_id = r.rule_id AND role = 'contradict'), []) AS less0,
   coalesce((SELECT list(text ORDER BY idx) FROM hit h WHERE h.log_id = r.log_id AND h.rule_id = r.rule_id AND role = 'exclude'), []) AS out0,
   coalesce((SELECT list(plain ORDER BY CASE role WHEN 'exclude' THEN 0 ELSE 1 END, idx) FROM items i WHERE i.rule_id = r.rule_id AND role IN ('exclude', 'contradict')), []) AS dis0,
   (SELECT list(sig ORDER BY sig) FROM hit h WHERE h.log_id = r.log_id AND h.rule_id = r.rule_id AND role IN ('support', 'discriminator')) AS ks FROM ranked r),
 assessed AS (SELECT *, why0[1:3] AS why, less0[1:2] AS less, out0[1:2] AS ruled, dis0[1:3] AS dis, category || '|' || array_to_string(CASE WHEN len(ks) > 0 THEN ks WHEN len(evidence) > 0 THEN list_sort(evidence[1:2]) ELSE [rule_id] END, '|') AS rivalry_key,
   row_number() OVER (PARTITION BY log_id ORDER BY eliminated, hypothesis_score DESC, score DESC, confidence DESC, rule_id) AS new_rank FROM asm)""", demo.CI_RULES, "event_logs")


def _assessed(spark, sf):
    logs = demo.event_logs(spark, sf)
    items = df.hypothesis_items(spark, demo.CI_RULES)
    signals = df.evaluate_signals(logs, NAMES, REGISTRY, delta=_delta(spark, sf))
    return df.assess(mt.match_rules(logs, demo.ci_rules(spark)), signals, items, REGISTRY)


@register(
    "log_signals",
    DIFF + "SELECT log_id, m.sig AS signal, coalesce(d.detail, array_to_string(m.ev, chr(10)), '') AS evidence FROM matched m LEFT JOIN (SELECT log_id, 'delta.signal:' || sig AS sig, detail FROM delta) d USING (log_id, sig)",
)
def log_signals(spark, sf):
    s = df.evaluate_signals(demo.event_logs(spark, sf), NAMES, REGISTRY, delta=_delta(spark, sf))
    rows = s.select("log_id", F.explode("signals").alias("signal", "e"))
    return rows.select("log_id", "signal", F.array_join("e", "\n").alias("evidence"))


@register(
    "hypothesis_assessment",
    DIFF + "SELECT log_id, rule_id, hypothesis_score, eliminated, array_to_string(why, '; ') AS why, array_to_string(less, '; ') AS why_less_likely, array_to_string(ruled, '; ') AS ruled_out_by, "
    "array_to_string(dis, '; ') AS disproof_checks, new_rank FROM assessed",
)
def hypothesis_assessment(spark, sf):
    a = _assessed(spark, sf)
    texts = [F.array_join(c, "; ").alias(c) for c in ("why", "why_less_likely", "ruled_out_by", "disproof_checks")]
    return a.select("log_id", "rule_id", "hypothesis_score", "eliminated", *texts, F.col("new_rank").cast("bigint").alias("new_rank"))


D2 = DIFF.rstrip() + """, lead AS (SELECT log_id, hypothesis_score AS ls, why AS lw FROM assessed WHERE new_rank = 1),
 kept AS (SELECT a.*, l.ls, l.lw FROM assessed a JOIN lead l USING (log_id) WHERE log_id IN (SELECT log_id FROM assessed WHERE reasoned) QUALIFY row_number() OVER (PARTITION BY log_id, rivalry_key ORDER BY new_rank) = 1),
 st AS (SELECT *, CASE WHEN new_rank = 1 THEN 'likely' WHEN eliminated THEN 'ruled_out' ELSE 'alternative' END AS status FROM kept),
 ps AS (SELECT *, row_number() OVER (PARTITION BY log_id, status ORDER BY new_rank) AS position FROM st),
 diff AS (SELECT log_id, status, position, rule_id, hypothesis_score, CASE WHEN confidence >= 0.8 THEN 'High' WHEN confidence >= 0.55 THEN 'Medium' ELSE 'Low' END AS confidence_text, why, ruled,
  CASE WHEN status = 'alternative' AND len(less) = 0 AND hypothesis_score <> 0 AND ls > hypothesis_score THEN [CASE WHEN len(lw) > 0 THEN 'it lacked the stronger discriminator: ' || lw[1]
   ELSE format('it trailed the likely cause by {:.2f} points', ls - hypothesis_score) END] ELSE less END AS less FROM ps WHERE status <> 'alternative' OR position <= 2)
"""


@register("differential_diagnosis", D2 + "SELECT log_id, status, position, rule_id, hypothesis_score, confidence_text, coalesce(array_to_string(less, '; '), '') AS why_less_likely FROM diff")
def differential_diagnosis(spark, sf):
    d = df.differential(_assessed(spark, sf))
    return d.select("log_id", "status", F.col("position").cast("bigint").alias("position"), "rule_id", "hypothesis_score", "confidence_text",
                    F.array_join("why_less_likely", "; ").alias("why_less_likely"))


@register("competing_candidates", D2 + "SELECT log_id, CASE WHEN status = 'likely' THEN 'higher_ranked' ELSE status END AS status, rule_id, "
          "array_to_string(CASE status WHEN 'likely' THEN why WHEN 'alternative' THEN less ELSE ruled END, '; ') AS reasons FROM diff WHERE rule_id <> 'cache-restore'")
def competing_candidates(spark, sf):
    c = df.competing(df.differential(_assessed(spark, sf)), "cache-restore")
    return c.select("log_id", "status", "rule_id", F.array_join("reasons", "; ").alias("reasons"))


COUNTS = [["cache-restore", 5], ["npm-network", 11], ["missing-executable", 7], ["pytest-failure", 1], ["unused-rule", 4]]
BOOSTS = [
    [r["rule_id"], k, s, w, bool(r.get(f"requires_{k}", False))]
    for r in demo.CI_RULES for k in ("delta", "topology") for s, w in r["boosts"][k]
] + [["npm-network", "topology", None, 0.0, True]]


def _context(spark, sf):
    """Change context per log: parts with the log's user number as files, flags from the user number; and the files of each number."""
    logs = demo.event_logs(spark, sf).select("log_id", canonicalize_log(F.col("text")).alias("c"), F.regexp_extract("log_id", "^u([0-9]+)-", 1).cast("bigint").alias("u"))
    files = demo.table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("k"), "p_partkey", F.expr(demo.FILE_PATH).alias("path"))
    per = files.groupBy(F.col("k").alias("context_id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("p_partkey") % 2 == F.floor(F.col("k") / 2) % 2, F.col("path")))).alias("changed_files"),
        F.array_sort(F.collect_set(F.when(F.col("p_partkey") % 3 == 0, F.col("path")))).alias("recent_files"),
    )
    none = F.array().cast("array<string>")
    u = F.col("u")
    return per, logs.select(
        "log_id", (u % 40).alias("context_id"),
        F.when(u % 3 == 0, F.array(F.lit("Repeated edits in src"))).otherwise(none).alias("drift_signals"),
        F.when(u % 4 == 0, F.array(F.lit("hotfix"), F.lit("hotfix two"))).otherwise(none).alias("hotfix_signals"),
        F.when(u % 5 == 0, F.array(F.lit("topology.boundary.crossed"))).when(u % 5 == 1, F.array(F.lit("topology.failure.clustered"))).otherwise(none).alias("topology_signals"),
        F.when(u % 7 == 0, F.lit(None).cast("array<string>")).when(u % 7 < 3, F.array(F.lit("delta.dependency.changed"), F.lit("delta.scope.changed"))).otherwise(F.array(F.lit("delta.error.new"))).alias("delta_signals"),
        st.log_command(F.col("c")).alias("command"), st.log_step(F.col("c")).alias("step"),
        F.when(u % 2 == 0, "dependency").otherwise("test_data").alias("top_cause"),
    )


def _scored(spark, sf):
    from culprit.operators.match import match_rules

    counts = small_table(spark, [{"rule_id": r, "n": n} for r, n in COUNTS], {"rule_id": "string", "n": "int"})
    boosts = small_table(spark, [dict(zip(["rule_id", "kind", "signal", "weight", "required"], b)) for b in BOOSTS],
                         {"rule_id": "string", "kind": "string", "signal": "string", "weight": "double", "required": "boolean"})
    rules = demo.ci_rules(spark)
    files, context = _context(spark, sf)
    return rr.score_features(match_rules(demo.event_logs(spark, sf), rules), rules, counts, context, boosts, delta_requested=True, files=files)


def _c01(e):
    return f"greatest(0.0, least(1.0, {e}))"


def _r2(e):
    return f"(round(({e}) * 100) / 100)"


def _profile_rows():
    out = []
    for r in demo.CI_RULES:
        i = r["rule_id"]
        cls = []
        for name, words in rr.ID_CLASSES.items():
            if any(w in i for w in words):
                cls.append(name)
                break
        if r["category"] in rr.CATEGORY_CLASSES:
            cls.append(rr.CATEGORY_CLASSES[r["category"]])
        pats = r.get("any", []) + r.get("all", [])
        out.append([i, cls, r["tags"] + [i, r["title"]], sorted(set(r["likely_files"])), pats, len(pats)])
    return sql.values("prof", ["rule_id", "cls0", "toks0", "hints", "pats", "n_listed"], out)


def _fit(files):
    star = "(regexp_matches(f, '^' || replace(replace(h, '.', '\\.'), '*', '[^/]*') || '$') OR regexp_matches(regexp_extract(f, '[^/]*$'), '^' || replace(replace(h, '.', '\\.'), '*', '[^/]*') || '$'))"
    return f"len(list_filter({files}, lambda f: len(list_filter(hints, lambda h: CASE WHEN contains(h, '*') THEN {star} ELSE contains(f, h) END)) > 0))"


def _share(c):
    return f"CASE WHEN list_contains(classes, '{c}') AND len(changed) > 0 THEN len(list_filter(changed, lambda f: {file_class_sql('f')} = '{c}'))::DOUBLE / len(changed) ELSE 0 END"


_HAY = "lower(array_to_string(list_concat(evidence, [coalesce(command, ''), coalesce(step, '')]), ' '))"
_VALUES = {
    "detector_score": _c01("score / top"), "detector_confidence": _c01("confidence"),
    "candidate_separation": f"CASE WHEN rank <> 1 THEN 0 WHEN second IS NULL THEN 1 WHEN second >= score THEN 0 ELSE {_c01('(score - second) / score')} END",
    "log_match_coverage": _c01("n_matched::DOUBLE / n_listed"),
    "error_exact_match": "CASE WHEN len(list_filter(evt, lambda e: list_contains(pt, e))) > 0 THEN 1 ELSE 0 END",
    "error_fuzzy_overlap": "coalesce(list_max(flatten(list_transform(evt, lambda e: list_transform(pt, lambda p: CASE WHEN len(e) = 0 OR len(p) = 0 THEN 0.0 ELSE len(list_intersect(e, p))::DOUBLE / len(list_distinct(list_concat(e, p))) END)))), 0)",
    "stage_hint_match": "CASE WHEN stage <> '' AND list_contains(stage_hints, stage) THEN 1 ELSE 0 END",
    "tool_or_stack_match": f"CASE WHEN trim({_HAY}) <> '' AND len(toks) > 0 THEN len(list_filter(toks, lambda t: contains({_HAY}, t)))::DOUBLE / len(toks) ELSE 0 END",
    "file_path_relevance": _c01(f"{_fit('list_distinct(list_concat(recent, changed))')}::DOUBLE / len(hints)"),
    "changed_files_relevance": f"CASE WHEN len(changed) > 0 THEN {_fit('changed')}::DOUBLE / len(changed) ELSE 0 END",
    "dependency_change_relevance": _share("dependency"), "runtime_toolchain_change_relevance": _share("runtime_toolchain"), "ci_config_change_relevance": _share("ci_config"),
    "environment_drift_relevance": "CASE WHEN u % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN u % 4 = 0 THEN 0.2 ELSE 0 END",
    "repo_delta_agreement": "CASE WHEN list_contains(classes, CASE WHEN u % 2 = 0 THEN 'dependency' ELSE 'test_data' END) THEN 1 ELSE 0 END",
    "historical_fixture_support": "coalesce(cn, 0)::DOUBLE / (SELECT max(n) FROM counts)",
}
_ACTIVE = "EXISTS (SELECT 1 FROM boosts b WHERE b.rule_id = q.rule_id AND b.kind = 'delta' AND list_contains(dsig, b.signal))"
_NEED = "EXISTS (SELECT 1 FROM boosts b WHERE b.rule_id = q.rule_id AND b.kind = '{}' AND b.required)"

RERANK = sql.ranked(f""", {_profile_rows()}, {sql.values('counts', ['rule_id', 'n'], COUNTS)}, {sql.values('boosts', ['rule_id', 'kind', 'signal', 'weight', 'required'], BOOSTS)},
 prof2 AS (SELECT rule_id, hints, n_listed, list_transform(pats, lambda p: {TOKENS_SQL.format(c='p')}) AS pt,
   list_sort(list_distinct(list_filter(flatten(list_transform(toks0, lambda t: {TOKENS_SQL.format(c='t')})), lambda t: length(t) >= 3))) AS toks,
   list_distinct(list_concat(cls0, list_filter(list_transform(hints, lambda f: {file_class_sql('f')}), lambda c: c IS NOT NULL))) AS classes FROM prof),
 pf AS (SELECT p_partkey % 40 AS k, p_partkey, {demo.FILE_PATH} AS path FROM part),
 pk AS (SELECT k, coalesce(list_sort(list(DISTINCT path) FILTER (WHERE p_partkey % 2 = (k // 2) % 2)), []) AS changed, coalesce(list_sort(list(DISTINCT path) FILTER (WHERE p_partkey % 3 = 0)), []) AS recent FROM pf GROUP BY k),
 ctx AS (SELECT log_id, regexp_extract(log_id, '^u([0-9]+)-', 1)::BIGINT AS u, coalesce(list_filter(list_transform(ls, lambda line: nullif({sql.trim_space(f'regexp_extract(line, {lit(st.COMMAND)}, 1)')}, '')), lambda c: c IS NOT NULL)[1], '') AS command,
   coalesce(list_filter(list_transform(ls, lambda line: nullif({sql.trim_space(f'regexp_extract(line, {lit(st.STEP)}, 1)')}, '')), lambda c: c IS NOT NULL)[1], '') AS step FROM staged),
 nm AS (SELECT log_id, rule_id, count(DISTINCT norm) AS n_matched FROM hits WHERE section IN ('any', 'all') GROUP BY 1, 2),
 base AS (SELECT r.*, ru.stage_hints, p.hints, p.n_listed, p.pt, p.toks, p.classes, c.u, c.command, c.step, coalesce(pk.changed, []) AS changed, coalesce(pk.recent, []) AS recent, coalesce(nm.n_matched, 0) AS n_matched,
   list_transform(r.evidence, lambda e: {TOKENS_SQL.format(c='e')}) AS evt, max(r.score) OVER (PARTITION BY r.log_id) AS top, max(CASE WHEN r.rank = 2 THEN r.score END) OVER (PARTITION BY r.log_id) AS second,
   k.n AS cn, sum(k.n) OVER (PARTITION BY r.log_id, r.category) AS catn,
   CASE WHEN c.u % 7 = 0 THEN NULL WHEN c.u % 7 < 3 THEN ['delta.dependency.changed', 'delta.scope.changed'] ELSE ['delta.error.new'] END AS dsig,
   CASE c.u % 5 WHEN 0 THEN ['topology.boundary.crossed'] WHEN 1 THEN ['topology.failure.clustered'] ELSE [] END AS tsig
   FROM ranked r JOIN rules ru USING (rule_id) JOIN prof2 p USING (rule_id) JOIN ctx c ON c.log_id = r.log_id LEFT JOIN pk ON pk.k = c.u % 40 LEFT JOIN nm ON nm.log_id = r.log_id AND nm.rule_id = r.rule_id LEFT JOIN counts k ON k.rule_id = r.rule_id),
 ncat AS (SELECT log_id, count(DISTINCT CASE WHEN cn IS NOT NULL THEN category END) AS cats FROM base GROUP BY 1),
 q AS (SELECT base.*, {_r2("0.7 * greatest(-0.35, least(0.35, ln(((coalesce(cn, 0) + 1) / ((SELECT sum(n) FROM counts) + (SELECT count(*) FROM counts))) * (SELECT count(*) FROM counts)))) + 0.3 * greatest(-0.2, least(0.2, CASE WHEN catn > 0 THEN ln(((catn + 1) / ((SELECT sum(n) FROM counts) + cats)) * (SELECT count(*) FROM counts)) ELSE 0 END))")} AS prior
   FROM base JOIN ncat USING (log_id)),
 feats AS ({' UNION ALL '.join(f"SELECT log_id, rule_id, '{n}' AS feature, {_r2(v)} AS value, {rr.FEATURE_WEIGHTS[n]} AS w FROM q" for n, v in _VALUES.items())}
  UNION ALL SELECT log_id, rule_id, 'delta_required_missing', 1, -1.5 FROM q WHERE dsig IS NULL AND {_NEED.format('delta')}
  UNION ALL SELECT log_id, rule_id, 'delta_required_unmatched', 1, -0.75 FROM q WHERE dsig IS NOT NULL AND {_NEED.format('delta')} AND NOT {_ACTIVE}
  UNION ALL SELECT q.log_id, q.rule_id, 'delta_boost:' || b.signal, 1, CASE WHEN b.weight = 0 THEN 1 ELSE b.weight END FROM q JOIN boosts b USING (rule_id) WHERE b.kind = 'delta' AND list_contains(dsig, b.signal)
  UNION ALL SELECT log_id, rule_id, 'topology_required_missing', 1, -1.0 FROM q WHERE len(tsig) = 0 AND {_NEED.format('topology')}
  UNION ALL SELECT q.log_id, q.rule_id, 'topology_boost:' || b.signal, 1, CASE WHEN b.weight = 0 THEN 1 ELSE b.weight END FROM q JOIN boosts b USING (rule_id) WHERE b.kind = 'topology' AND list_contains(tsig, b.signal)),
 contrib AS (SELECT log_id, rule_id, feature, value::DOUBLE AS value, round(value * w * 100) / 100 AS contribution FROM feats WHERE value <> 0 AND round(value * w * 100) <> 0),
 fin AS (SELECT q.log_id, q.rule_id, q.score, q.confidence, q.prior, round((q.score + q.prior + coalesce((SELECT sum(contribution) FROM contrib c WHERE c.log_id = q.log_id AND c.rule_id = q.rule_id), 0)) * 100) / 100 AS final_score FROM q),
 fr AS (SELECT *, row_number() OVER w AS new_rank, coalesce(lead(final_score) OVER w, 0) AS nxt, max(final_score) OVER (PARTITION BY log_id) AS best FROM fin WINDOW w AS (PARTITION BY log_id ORDER BY final_score DESC, score DESC, confidence DESC, rule_id))""", demo.CI_RULES, "event_logs")
MIXED = _r2(f"({_c01('final_score / (final_score + 1)')} + {_c01('(final_score - nxt) / greatest(final_score, 1.0)')} + confidence) / 3")


@register("feature_contributions", RERANK + "SELECT log_id, rule_id, feature, value, contribution::DOUBLE AS contribution FROM contrib")
def feature_contributions(spark, sf):
    r = rr.rerank(_scored(spark, sf))
    return r.select("log_id", "rule_id", F.explode("contributions").alias("c")).select("log_id", "rule_id", "c.feature", "c.value", "c.contribution")


@register(
    "reranked",
    RERANK + f"SELECT log_id, rule_id, prior::DOUBLE AS prior, final_score::DOUBLE AS final_score, new_rank, CASE WHEN final_score = best AND nxt = 0 THEN greatest({MIXED}, confidence) ELSE {MIXED} END::DOUBLE AS new_confidence FROM fr",
)
def reranked(spark, sf):
    return rr.rerank(_scored(spark, sf)).select("log_id", "rule_id", "prior", "final_score", F.col("new_rank").cast("bigint").alias("new_rank"), "new_confidence")


# Comparison of two analyses and the artifact row.
OTHER = demo.CI_RULES[1:]


def _analyses(spark, sf, rules):
    from culprit.operators.rules import RuleSet
    from culprit.operators import unknown as uk

    logs = demo.event_logs(spark, sf)
    rs = RuleSet.from_records(spark, rules)
    res = mt.evaluate_logs(logs, rs, source="source")
    dominant = uk.dominant_signals(uk.candidate_patterns(logs)).groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pattern"))).alias("d"))
    fixes = rs.rules.select(F.col("rule_id").alias("failure_id"), "fix")
    out = res.join(dominant, "log_id", "left").join(fixes, "failure_id", "left")
    none = F.array().cast("array<string>")
    return out.select("log_id", "matched", "failure_id", "evidence", F.when(~F.col("matched"), F.transform("d", lambda x: x["pattern"])).otherwise(none).alias("dominant_signals"),
                      fix_steps(F.col("fix")).alias("fix_steps"))


def _steps(fix):
    """Fix steps of the demo rules, for the oracle."""
    return [x[2:].strip() if x.startswith("- ") else x[3:].strip() for x in fix.split("\n") if x.startswith("- ") or x[1:3] == ". "]


def _an_sql(rules):
    from culprit.plans.diagnosis import _unknown_sql

    fixes = sql.values("fx", ["failure_id", "fs"], [[r["rule_id"], _steps(r["fix"])] for r in rules])
    return f"""({sql.results(rules, 'event_logs', f''', {fixes}''')} SELECT r.log_id, r.matched, r.failure_id, r.evidence, coalesce(fs, []) AS fix_steps,
 CASE WHEN matched THEN [] ELSE coalesce((SELECT list(pattern) FROM ({_unknown_sql('event_logs')} SELECT log_id, pattern FROM c WHERE rank <= 5) u WHERE u.log_id = r.log_id), []) END AS dominant_signals FROM results r LEFT JOIN fx USING (failure_id))"""


def _minus(a, b):
    return f"array_to_string(list_sort(list_distinct(list_filter({a}, lambda x: x <> '' AND NOT list_contains({b}, x)))), '|')"


@register(
    "analysis_comparison",
    f"""WITH a AS {_an_sql(demo.CI_RULES)}, b AS {_an_sql(OTHER)}, j AS (SELECT a.log_id, a, b FROM a JOIN b USING (log_id)),
 k AS (SELECT log_id, a.failure_id AS f0, b.failure_id AS f1, a.matched AS m0, b.matched AS m1, {_minus('b.evidence', 'a.evidence')} AS evidence_added, {_minus('a.evidence', 'b.evidence')} AS evidence_removed,
  {_minus('b.fix_steps', 'a.fix_steps')} AS fix_added, {_minus('b.dominant_signals', 'a.dominant_signals')} AS signals_added, {_minus('a.dominant_signals', 'b.dominant_signals')} AS signals_removed FROM j)
SELECT log_id, f0 <> f1 AS diagnosis_changed, m0 <> m1 AS status_changed, evidence_added, evidence_removed, fix_added, signals_added,
 CASE WHEN NOT m0 AND NOT m1 THEN 'neither artifact contains a matched diagnosis' WHEN NOT m0 THEN 'a diagnosis appeared: ' || f1 WHEN NOT m1 THEN 'the previous diagnosis disappeared: ' || f0
  WHEN f0 <> f1 THEN 'top diagnosis changed from ' || f0 || ' to ' || f1 ELSE 'top diagnosis stayed the same: ' || f1 END AS headline FROM k""",
)
def analysis_comparison(spark, sf):
    c = af.compare_analyses(_analyses(spark, sf, demo.CI_RULES), _analyses(spark, sf, OTHER))
    return c.select("log_id", "diagnosis_changed", "status_changed", *[F.array_join(F.col(p), "|").alias(n) for p, n in (
        ("evidence.added", "evidence_added"), ("evidence.removed", "evidence_removed"), ("fix_steps.added", "fix_added"), ("dominant_signals.added", "signals_added"))],
        F.get("summary", 0).alias("headline"))


@register(
    "failure_artifacts",
    f"""WITH r AS ({sql.results(demo.CI_RULES, 'event_logs')} SELECT r.*, ru.likely_files, ru.fix FROM results r LEFT JOIN rules ru ON ru.rule_id = failure_id),
 x AS (SELECT *, regexp_extract(log_id, '^u([0-9]+)-', 1)::BIGINT AS u FROM r)
SELECT log_id, CASE WHEN matched THEN 'matched' ELSE 'unknown' END AS status, failure_id, array_to_string(evidence, chr(10)) AS evidence,
 CASE WHEN matched THEN least(1.0, confidence + CASE WHEN u % 3 = 0 THEN 0.04 ELSE 0 END + CASE WHEN u % 2 = 0 THEN 0.03 ELSE 0 END) ELSE 0.2 END::DOUBLE AS confidence,
 CASE WHEN matched THEN array_to_string(likely_files || ['recent/' || u || '.go'], '|') ELSE '' END AS likely_files FROM x""",
)
def failure_artifacts(spark, sf):
    rules = demo.ci_rules(spark)
    res = mt.evaluate_logs(demo.event_logs(spark, sf), rules, source="source")
    res = res.join(rules.rules.select(F.col("rule_id").alias("failure_id"), "likely_files", "fix"), "failure_id", "left")
    u = F.regexp_extract("log_id", "^u([0-9]+)-", 1).cast("bigint")
    res = res.withColumns({
        "recent_files": F.array(F.concat(F.lit("recent/"), u, F.lit(".go"))), "has_related_commits": u % 3 == 0, "has_delta": u % 2 == 0,
    })
    a = af.artifacts(res)
    return a.select("log_id", "status", F.coalesce("matched_rule.id", F.lit("")).alias("failure_id"), F.array_join("evidence", "\n").alias("evidence"), "confidence",
                    F.array_join("likely_files", "|").alias("likely_files"))


@register(
    "hook_confidence",
    f"""WITH {demo.RUNS_SQL}, d AS (SELECT signature_hash, rule_id, sum(CASE WHEN category = 'verify' AND status = 'executed' AND passed IS NOT NULL THEN CASE WHEN passed THEN confidence_delta ELSE -confidence_delta END ELSE 0 END) AS t FROM hooks GROUP BY 1, 2)
SELECT signature_hash, rule_id, round(greatest(-0.3, least(0.3, t)) * 100) / 100 AS confidence_delta, round(greatest(0.0, least(1.0, 0.75 + greatest(-0.3, least(0.3, t)))) * 100) / 100 AS final_confidence FROM d""",
)
def hook_confidence(spark, sf):
    h = demo.history(spark, sf, "hooks")
    return af.hook_confidence(h, ["signature_hash", "rule_id"], F.lit(0.75))


@register(
    "resolved_files",
    f"""WITH {demo.FILES_SQL}, l AS (SELECT DISTINCT concat('r', p_partkey % 4) AS repo, path FROM files), {sql.values('pt', ['idx', 'pattern', 'rx', 'base'], [[0, 'deploy/*/*.tf', '^deploy/[^/]*/[^/]*[.]tf$', False], [1, '*.yml', '[.]yml$', True], [2, 'src/core', 'src/core', False]])},
 m AS (SELECT l.repo, l.path, min(idx) AS idx FROM l JOIN pt ON regexp_matches(path, rx) GROUP BY 1, 2)
SELECT repo, array_to_string((list(path ORDER BY idx, path))[1:12], '|') AS files FROM m GROUP BY 1""",
)
def resolved_files(spark, sf):
    listing = demo.files(spark, sf).select(F.concat(F.lit("r"), F.col("p_partkey") % 4).alias("repo"), "path").distinct()
    r = af.resolve_files(listing, ["deploy/*/*.tf", "*.yml", "src/core"], limit=12)
    return r.select("repo", F.array_join("files", "|").alias("files"))
