"""Queries on the source-tree scan."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from culprit.functions import signature as sg
from culprit.functions.storage import stored
from culprit.functions.tables import small_table
from culprit.operators import rerank as rr
from culprit.operators import source_scan as sc
from culprit.operators.match import match_rules
from culprit.operators.rules import RuleSet
from culprit.plans import demo, sql
from culprit.plans.sql import collapse
from culprit.plans.texts import source_class_sql

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


RULES = [  # rule, base, blast, hot, suppression, safe, new file, line, legacy, includes, excludes
    ["raw-query", 0.5, 0.0, 2.0, 1.5, 0.0, 0.0, 0.0, 0.0, [], ["/scripts/"]],
    ["unchecked-fetch", 0.25, 0.75, 0.0, 0.0, 0.5, 0.0, 0.5, 0.0, [], []],
    ["noisy-loop", 0.0, 0.0, 0.0, 0.0, 0.0, 2.5, 0.0, 0.25, ["/core/", "/handlers/"], []],
]
MATCHERS = [  # rule, kind, signal, label, patterns, includes, excludes, weight
    ["raw-query", "trigger", "query", "raw query", ["db.Query("], [], [], 1.5],
    ["raw-query", "amplifier", "fetch", "", ["http.get("], [], [], 0.0],
    ["raw-query", "mitigation", "validated", "validated input", ["validate(input)"], [], [], 0.7],
    ["raw-query", "context", "hot", "hot path logging", ["hot path"], ["/handlers/"], [], 0.3],
    ["unchecked-fetch", "trigger", "fetch", "fetch", ["http.Get("], [], ["/tests/"], 0.0],
    ["unchecked-fetch", "mitigation", "review", "", ["reviewed by security"], [], [], 0.4],
    ["noisy-loop", "trigger", "loop", "loop query", ["loop {  db.query"], [], [], 1.0],
    ["noisy-loop", "amplifier", "query", "query", ["db.query("], [], [], 0.2],
]
COMPOUNDS = [  # rule, id, label, require, scope, bonus, allow mitigated
    ["raw-query", "query-and-fetch", "query near fetch", ["query", "fetch"], "function", 3.0, False],
    ["raw-query", "many", "", ["query", "query"], "module", 0.0, True],
    ["noisy-loop", "twice", "loop and query", ["loop", "query"], "file", 1.25, False],
]
CONSISTENCY = [["raw-query", "peers", "", 2, 0.1, 0.0], ["unchecked-fetch", "reviewed", "not reviewed", 0, 0.05, 2.0]]
SUPPRESSIONS = [["unchecked-fetch", "reviewed line", "reviewed by security", ["/handlers/"], 0.01, False, ""], ["noisy-loop", "", "", ["mod3/"], 0.02, False, "2030-01-01"]]
SAFE = [["raw-query", "ex", "example code", ["/examples/"], 0.05], ["unchecked-fetch", "tests", "", ["/tests/"], 0.0]]

TABLES = {
    "rules": (RULES, {"rule_id": "string", "base_score": "double", "blast_bonus": "double", "hot_bonus": "double", "suppression_discount": "double", "safe_discount": "double",
                      "new_file_bonus": "double", "modified_line_bonus": "double", "legacy_discount": "double", "path_includes": "array<string>", "path_excludes": "array<string>"}),
    "matchers": (MATCHERS, {"rule_id": "string", "kind": "string", "signal_id": "string", "label": "string", "patterns": "array<string>", "path_includes": "array<string>",
                            "path_excludes": "array<string>", "weight": "double"}),
    "compounds": (COMPOUNDS, {"rule_id": "string", "id": "string", "label": "string", "require": "array<string>", "scope": "string", "bonus": "double", "allow_mitigated": "boolean"}),
    "consistency": (CONSISTENCY, {"rule_id": "string", "id": "string", "label": "string", "minimum_peers": "int", "threshold": "double", "amplifier": "double"}),
    "suppressions": (SUPPRESSIONS, {"rule_id": "string", "style": "string", "pattern": "string", "paths": "array<string>", "discount": "double", "suppress_all": "boolean", "expires_on": "string"}),
    "safe_contexts": (SAFE, {"rule_id": "string", "id": "string", "label": "string", "paths": "array<string>", "discount": "double"}),
}


@lru_cache(maxsize=4)
def source_rules(spark):
    return sc.SourceRules(**{n: small_table(spark, [dict(zip(cols, r)) for r in rows], cols) for n, (rows, cols) in TABLES.items()})


VALUES = ", ".join(sql.values(n, list(cols), rows) for n, (rows, cols) in TABLES.items())
NAME = """CASE WHEN starts_with(trim(original), 'func ') THEN trim(regexp_extract(trim(original), '^func ([^(]*)\\(', 1)) WHEN regexp_matches(trim(original), '^(const|let|var) ') THEN
 regexp_replace(regexp_extract(trim(original), '^(?:const|let|var) +([^ ]+)', 1), '=$', '') ELSE '' END"""
LINES = f"""{demo.SOURCES_SQL}, l0 AS (SELECT *, {NAME.replace('trim(original)', "trim(original, chr(9) || ' ')")} AS name, len(original) - len(replace(original, '{{', '')) - (len(original) - len(replace(original, '}}', ''))) AS d FROM src),
 l1 AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY repo, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS depth,
   sum((name <> '')::INT) OVER (PARTITION BY repo, path ORDER BY line) AS g FROM l0),
 l2 AS (SELECT *, first(depth) OVER w AS fd, first(name) OVER w AS fname, min(depth + d) OVER (PARTITION BY repo, path, g ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
   FROM l1 WINDOW w AS (PARTITION BY repo, path, g ORDER BY line)),
 lines AS (SELECT repo, path, line, original, depth, CASE WHEN g > 0 AND (low IS NULL OR low > fd) THEN fname ELSE '' END AS fn, lower({collapse('original')}) AS norm,
   regexp_replace(path, '/[^/]*$', '') AS module, {source_class_sql('path')} AS path_class FROM l2),
 sl AS (SELECT *, CASE WHEN fn <> '' THEN fn ELSE path END AS scope_name, CASE WHEN fn <> '' THEN path || '|' || fn ELSE path END AS scope_key,
   CASE WHEN fn = '' THEN 'same_file' WHEN depth > 0 THEN 'same_block' ELSE 'same_function' END AS place FROM lines)"""


@register("source_lines", f"WITH {LINES} SELECT repo, path, line, depth, fn AS function, scope_key, place, module, path_class FROM sl")
def source_lines(spark, sf):
    t = sc.line_table(demo.source_files(spark, sf))
    return t.select("repo", "path", F.col("line").cast("bigint").alias("line"), F.col("depth").cast("bigint").alias("depth"), "function", "scope_key", "place", "module", "path_class")


def _hit(path, arr):
    return f"len(list_filter({arr}, lambda p: contains(lower({path}), lower(p)))) > 0"


def _ok(path, inc, exc):
    return f"(len({inc}) = 0 OR {_hit(path, inc)}) AND NOT ({_hit(path, exc)})"


HITS = f"""{LINES}, {VALUES}, h0 AS (SELECT s.*, m.rule_id, m.kind, m.signal_id, CASE WHEN m.label = '' THEN m.signal_id ELSE m.label END AS label, CASE WHEN m.weight = 0 THEN 1.0 ELSE m.weight END::DOUBLE AS weight
  FROM sl s JOIN matchers m ON len(list_filter(m.patterns, lambda p: contains(s.norm, lower(regexp_replace(p, ' +', ' ', 'g'))))) > 0 JOIN rules r ON r.rule_id = m.rule_id
  WHERE {_ok('s.path', 'r.path_includes', 'r.path_excludes')} AND {_ok('s.path', 'm.path_includes', 'm.path_excludes')}),
 trg AS (SELECT * FROM h0 WHERE kind = 'trigger'), mit AS (SELECT * FROM h0 WHERE kind = 'mitigation'),
 ms AS (SELECT t.repo, t.rule_id, t.module, count(DISTINCT t.scope_key) AS peers, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM mit m WHERE m.repo = t.repo AND m.rule_id = t.rule_id AND m.module = t.module AND m.scope_key = t.scope_key) THEN t.scope_key END) AS guarded FROM trg t GROUP BY 1, 2, 3),
 cs AS (SELECT t.repo, t.path, t.line, t.original, t.depth, t.fn, t.norm, t.module, t.path_class, t.scope_name, t.scope_key, t.place, t.rule_id, 'amplifier' AS kind, c.id AS signal_id,
   CASE WHEN c.label = '' THEN 'violates local idiom' ELSE c.label END AS label, CASE WHEN c.amplifier = 0 THEN 1.25 ELSE c.amplifier END::DOUBLE AS weight
  FROM trg t JOIN ms USING (repo, rule_id, module) JOIN consistency c ON c.rule_id = t.rule_id WHERE peers >= CASE WHEN c.minimum_peers = 0 THEN 2 ELSE c.minimum_peers END AND guarded::DOUBLE / peers >= CASE WHEN c.threshold = 0 THEN 0.6 ELSE c.threshold END
   AND NOT EXISTS (SELECT 1 FROM mit m WHERE m.repo = t.repo AND m.rule_id = t.rule_id AND m.scope_key = t.scope_key) QUALIFY row_number() OVER (PARTITION BY t.repo, t.rule_id, c.id ORDER BY t.path, t.line, t.label) = 1),
 hits AS (SELECT * FROM h0 UNION ALL SELECT * FROM cs)"""


def signal_hits(spark, sf):
    """Signals and broken local idioms, and the rules. The idioms are found from the signals in several steps, so those are kept."""
    rules = source_rules(spark)
    h = stored(sc.signal_matches(sc.matched_lines(demo.source_files(spark, sf), rules), rules))
    return h.unionByName(stored(sc.consistency_matches(h, rules).select(*h.columns))), rules


@register("source_signals", f"WITH {HITS} SELECT repo, rule_id, kind, signal_id, label, weight, path, line, scope_key FROM hits")
def source_signals(spark, sf):
    h, _ = signal_hits(spark, sf)
    return h.select("repo", "rule_id", "kind", "signal_id", "label", "weight", "path", F.col("line").cast("bigint").alias("line"), "scope_key")


COMPOUND = """cr AS (SELECT rule_id, id AS cid, label AS clabel, scope, CASE WHEN bonus = 0 THEN 2.5 ELSE bonus END AS bonus, allow_mitigated AS allow, len(require) AS need, unnest(require) AS signal_id, generate_subscripts(require, 1) AS pos FROM compounds),
 ck AS (SELECT h.repo, h.rule_id, cid, need, allow, bonus, CASE scope WHEN 'module' THEN h.module WHEN 'file' THEN h.path ELSE h.scope_key END AS key FROM hits h JOIN cr USING (rule_id, signal_id) WHERE h.kind IN ('trigger', 'amplifier')),
 cg AS (SELECT repo, rule_id, cid, key, any_value(bonus) AS bonus, any_value(allow) AS allow FROM ck GROUP BY 1, 2, 3, 4 HAVING count(*) >= any_value(need)),
 cf AS (SELECT * FROM cg c WHERE allow OR NOT EXISTS (SELECT 1 FROM mit m WHERE m.repo = c.repo AND m.rule_id = c.rule_id AND m.scope_key = c.key) QUALIFY row_number() OVER (PARTITION BY repo, rule_id, cid ORDER BY key) = 1)"""


@register("source_compounds", f"WITH {HITS}, {COMPOUND} SELECT repo, rule_id, cid AS signal_id, key, bonus::DOUBLE AS bonus FROM cf")
def source_compounds(spark, sf):
    h, rules = signal_hits(spark, sf)
    return sc.compound_matches(h, rules).select("repo", "rule_id", "signal_id", "key", "bonus")


SUPPRESS = f"""fl AS (SELECT DISTINCT repo, path, module FROM sl), sup AS (
 SELECT s.repo, r.rule_id, s.path, s.line, CASE WHEN r.suppression_discount = 0 THEN 2.0 ELSE r.suppression_discount END AS weight, true AS sall, regexp_extract(s.original, 'reason=([^ \\t]*)', 1) AS reason, regexp_extract(s.original, 'until=([^ \\t]*)', 1) AS expires_on
  FROM sl s JOIN rules r ON contains(s.norm, 'culprit:ignore ' || r.rule_id) OR contains(s.norm, 'culprit:disable ' || r.rule_id)
 UNION ALL SELECT s.repo, c.rule_id, s.path, s.line, CASE WHEN c.discount = 0 THEN 2.0 ELSE c.discount END, c.suppress_all, '', c.expires_on FROM sl s JOIN suppressions c ON c.pattern <> '' AND contains(s.norm, lower(c.pattern)) AND (len(c.paths) = 0 OR {_hit('s.path', 'c.paths')})
 UNION ALL SELECT f.repo, c.rule_id, f.path, 0, CASE WHEN c.discount = 0 THEN 2.0 ELSE c.discount END, c.suppress_all, '', c.expires_on FROM fl f JOIN suppressions c ON c.pattern = '' AND (len(c.paths) = 0 OR {_hit('f.path', 'c.paths')})),
 safe AS (SELECT f.repo, c.rule_id, f.path, 0 AS line, f.path AS scope_name, f.module, CASE WHEN c.discount <> 0 THEN c.discount WHEN r.safe_discount <> 0 THEN r.safe_discount ELSE 1.0 END AS weight FROM fl f JOIN safe_contexts c ON {_hit('f.path', 'c.paths')} JOIN rules r ON r.rule_id = c.rule_id)"""


@register("source_suppressions", f"WITH {HITS}, {SUPPRESS} SELECT repo, rule_id, path, line, weight::DOUBLE AS weight, sall AS suppress_all, reason, expires_on FROM sup")
def source_suppressions(spark, sf):
    files, rules = stored(demo.source_files(spark, sf)), source_rules(spark)
    s = sc.suppression_matches(files, sc.matched_lines(files, rules), rules)
    return s.select("repo", "rule_id", "path", F.col("line").cast("bigint").alias("line"), "weight", "suppress_all", "reason", "expires_on")


CHANGES = f"""changes AS (SELECT repo, path AS file, CASE WHEN hash(0) IS NULL THEN '' WHEN ends_with(path, '.js') THEN 'added' ELSE 'modified' END AS status, CASE WHEN contains(path, '/core/') THEN NULL ELSE line END AS line
 FROM src WHERE repo <> 'r2' AND regexp_matches(path, '[05][.]') AND line % 3 = 0)"""


def _changes(spark, sf):
    f = demo.source_files(spark, sf).select("repo", "path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    f = f.withColumn("line", F.col("pos") + 1).filter((F.col("repo") != "r2") & F.rlike("path", F.lit("[05][.]")) & (F.col("line") % 3 == 0))
    return f.select("repo", F.col("path").alias("file"), F.when(F.endswith("path", F.lit(".js")), "added").otherwise("modified").alias("status"),
                    F.when(~F.contains("path", F.lit("/core/")), F.col("line")).alias("line"))


def _r2(e):
    return f"round(({e}) * 100) / 100"


SCAN = f"""{HITS}, {COMPOUND}, {SUPPRESS}, {CHANGES.replace("WHEN hash(0) IS NULL THEN '' ", '')},
 items AS (SELECT repo, rule_id, path, line, scope_name, module, kind, weight FROM hits WHERE kind IN ('amplifier', 'mitigation') UNION ALL SELECT repo, rule_id, path, line, scope_name, module, 'safe', weight FROM safe),
 prox AS (SELECT i.*, greatest(0.1, coalesce((SELECT max(CASE WHEN t.path = i.path THEN CASE WHEN t.scope_name <> '' AND t.scope_name = i.scope_name THEN CASE WHEN abs(t.line - i.line) <= 6 THEN 1.0 ELSE 0.85 END ELSE 0.55 END
   WHEN t.module = i.module THEN 0.3 ELSE 0.1 END) FROM trg t WHERE t.repo = i.repo AND t.rule_id = i.rule_id), 0.1)) AS near FROM items i),
 pw AS (SELECT repo, rule_id, coalesce(sum(weight * near) FILTER (WHERE kind = 'amplifier'), 0) AS amp, coalesce(sum(weight * near) FILTER (WHERE kind = 'mitigation'), 0) AS mitig, coalesce(sum(weight * near) FILTER (WHERE kind = 'safe'), 0) AS safe FROM prox GROUP BY 1, 2),
 tg AS (SELECT t.repo, t.rule_id, any_value(r.base_score) + sum(t.weight) AS base, count(*) AS n_triggers, greatest(0.0, sum(CASE WHEN path_class = 'production' THEN CASE WHEN r.blast_bonus = 0 THEN 1.5 ELSE r.blast_bonus END WHEN path_class IN ('test', 'fixture', 'example') THEN -1.0 ELSE 0 END)) AS blast,
   sum(CASE WHEN place = 'same_block' AND contains(lower(path), 'handler') THEN CASE WHEN r.hot_bonus = 0 THEN 1.0 ELSE r.hot_bonus END ELSE 0 END) AS hot FROM trg t JOIN rules r USING (rule_id) GROUP BY 1, 2),
 hc AS (SELECT repo, rule_id, sum(weight) AS hc FROM hits WHERE kind = 'context' AND contains(lower(label), 'hot path') GROUP BY 1, 2),
 sp AS (SELECT repo, rule_id, sum(weight) AS sup, bool_or(sall) AS sall FROM sup GROUP BY 1, 2), cp AS (SELECT repo, rule_id, sum(bonus) AS comp FROM cf GROUP BY 1, 2),
 cf1 AS (SELECT repo, file, max(status) AS status, count(line) AS n FROM changes GROUP BY 1, 2),
 tc AS (SELECT t.repo, t.rule_id, t.path, t.line, t.label, c.status, CASE WHEN c.status = 'added' THEN CASE WHEN r.new_file_bonus = 0 THEN 1.5 ELSE r.new_file_bonus END
   WHEN c.status IS NOT NULL AND (c.n = 0 OR EXISTS (SELECT 1 FROM changes x WHERE x.repo = t.repo AND x.file = t.path AND x.line = t.line)) THEN CASE WHEN r.modified_line_bonus = 0 THEN 1.0 ELSE r.modified_line_bonus END ELSE 0 END AS b,
   CASE WHEN r.legacy_discount = 0 THEN 0.5 ELSE r.legacy_discount END AS ld FROM trg t JOIN rules r USING (rule_id) LEFT JOIN cf1 c ON c.repo = t.repo AND c.file = t.path),
 ca AS (SELECT repo, rule_id, CASE WHEN repo NOT IN (SELECT repo FROM changes) THEN 0 WHEN count(status) = 0 THEN -any_value(ld) ELSE sum(b) END AS chg,
   coalesce(arg_max(CASE WHEN status = 'added' THEN 'introduced' ELSE 'modified' END, (path, line, label)) FILTER (WHERE status IS NOT NULL), 'legacy') AS change_status FROM tc GROUP BY 1, 2),
 fin AS (SELECT tg.*, coalesce(amp, 0) AS amp, coalesce(comp, 0) AS comp, hot + coalesce(hc, 0) AS hott, chg, coalesce(mitig, 0) AS mitig, coalesce(sup, 0) AS sup, coalesce(safe, 0) AS safe, change_status, coalesce(sall, false) AS sall FROM tg LEFT JOIN pw USING (repo, rule_id) LEFT JOIN hc USING (repo, rule_id)
   LEFT JOIN sp USING (repo, rule_id) LEFT JOIN cp USING (repo, rule_id) LEFT JOIN ca USING (repo, rule_id)),
 sc AS (SELECT *, base + amp + comp + blast + hott + chg - mitig - sup - safe AS f, base + amp + comp AS p FROM fin)
SELECT repo, rule_id, {_r2('f')} AS score, CASE WHEN p <= 0 THEN 0.1 ELSE {_r2('least(1.0, p / greatest(p, f))')} END AS confidence, {_r2('base')} AS base_signal, {_r2('comp')} AS compound_bonus, {_r2('blast')} AS blast_bonus, {_r2('hott')} AS hot_bonus,
 {_r2('chg')} AS change_bonus, {_r2('mitig')} AS mitigation_discount, {_r2('sup')} AS suppression_discount, {_r2('safe')} AS safe_discount, change_status, n_triggers,
 (coalesce((SELECT count(*) FROM mit m WHERE m.repo = sc.repo AND m.rule_id = sc.rule_id), 0) + coalesce((SELECT count(*) FROM sup s WHERE s.repo = sc.repo AND s.rule_id = sc.rule_id), 0))::BIGINT AS n_mitigations FROM sc WHERE NOT sall AND f > 0"""


@register("source_scan", f"SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, confidence DESC, rule_id) AS rank FROM (WITH {SCAN})")
def source_scan(spark, sf):
    s = sc.scan_sources(stored(demo.source_files(spark, sf)), source_rules(spark), stored(_changes(spark, sf)))
    return s.withColumns({c: F.col(c).cast("bigint") for c in ("rank", "n_triggers", "n_mitigations")})


@register(
    "source_evidence",
    f"""WITH {HITS}, {COMPOUND}, {SUPPRESS}, cq AS (SELECT c.repo, c.rule_id, c.cid, c.key, CASE WHEN k.label = '' THEN 'compound signal' ELSE k.label END AS label FROM cf c JOIN compounds k ON k.rule_id = c.rule_id AND k.id = c.cid),
 cw AS (SELECT q.repo, q.rule_id, q.label, h.path, h.line FROM cq q JOIN cr ON cr.rule_id = q.rule_id AND cr.cid = q.cid JOIN hits h ON h.repo = q.repo AND h.rule_id = q.rule_id AND h.signal_id = cr.signal_id AND h.kind IN ('trigger', 'amplifier')
   AND CASE cr.scope WHEN 'module' THEN h.module WHEN 'file' THEN h.path ELSE h.scope_key END = q.key QUALIFY row_number() OVER (PARTITION BY q.repo, q.rule_id, q.cid ORDER BY cr.pos, h.kind DESC, h.path, h.line, h.label) = 1),
 ev AS (SELECT repo, rule_id, kind, path, line, label FROM hits UNION ALL SELECT repo, rule_id, 'amplifier', path, line, label FROM cw
  UNION ALL SELECT s.repo, s.rule_id, 'suppression', s.path, s.line, CASE WHEN s.sall THEN 'inline suppression' WHEN s.rule_id = 'unchecked-fetch' THEN 'reviewed line' ELSE 'configured suppression' END FROM sup s
  UNION ALL SELECT repo, rule_id, 'context', path, 0, CASE WHEN rule_id = 'raw-query' THEN 'example code' ELSE 'safe context' END FROM safe)
SELECT repo, rule_id, kind, CASE WHEN line > 0 THEN path || ':' || line || ' ' || label ELSE path || ' ' || label END AS evidence FROM ev WHERE (repo, rule_id) IN (SELECT repo, rule_id FROM trg)""",
)
def source_evidence(spark, sf):
    return sc.scan_evidence(stored(demo.source_files(spark, sf)), source_rules(spark)).select("repo", "rule_id", "kind", "evidence")


@register(
    "source_signatures",
    f"""WITH {HITS}, g AS (SELECT repo, rule_id, list_sort(list(DISTINCT lower(label))) AS e, list_sort(list(DISTINCT path)) AS f, list_sort(list(DISTINCT lower(scope_name))) AS n, list_sort(list(DISTINCT lower(signal_id))) AS s FROM trg GROUP BY 1, 2)
SELECT repo, rule_id, sha256('{{"version":"{sg.VERSION}","failure_id":"' || rule_id || '","detector":"source","evidence":' || to_json(e)::VARCHAR || ',"attributes":{{"files":' || to_json(f)::VARCHAR
 || ',"scope_names":' || to_json(n)::VARCHAR || ',"signal_ids":' || to_json(s)::VARCHAR || '}}}}') AS signature_hash FROM g""",
)
def source_signatures(spark, sf):
    """Signatures of source findings: labels of the triggers with their files, scopes and signals."""
    rules = source_rules(spark)
    hits = sc.signal_matches(sc.matched_lines(demo.source_files(spark, sf), rules), rules).filter("kind = 'trigger'")
    found = hits.groupBy("repo", "rule_id").agg(*[F.collect_set(c).alias(c) for c in ("label", "path", "scope_name", "signal_id")])
    attributes = sg.trigger_attributes(F.col("path"), F.col("scope_name"), F.col("signal_id"))
    return found.select("repo", "rule_id", sg.signature_hash(F.col("rule_id"), F.lit("source"), F.col("label"), F.lit(""), attributes).alias("signature_hash"))


def _both_rules(spark):
    """The log rules and, without patterns, the source rules."""
    own = [{"rule_id": r[0], "title": r[0], "category": "runtime", "severity": "medium", "detector": "source"} for r in RULES]
    return RuleSet.from_records(spark, demo.CI_RULES + own)


@register(
    "source_candidates",
    sql.ranked(f""", scan AS (SELECT * FROM (WITH {SCAN})), lr AS (SELECT log_id, 'r' || (regexp_extract(log_id, '^u([0-9]+)-', 1)::BIGINT % 3) AS repo FROM staged),
 every AS (SELECT log_id, rule_id, score, confidence, len(evidence) AS shown, 'log' AS detector, 0 AS nt, 0 AS nm FROM ranked
  UNION ALL SELECT log_id, rule_id, score, confidence, least(5, n_triggers), 'source', n_triggers, n_mitigations FROM scan JOIN lr USING (repo))""", demo.CI_RULES, "event_logs")
    + """SELECT log_id, rule_id, detector, row_number() OVER (PARTITION BY log_id ORDER BY score DESC, confidence DESC, shown DESC, rule_id) AS rank,
  CASE WHEN nm > 0 THEN round(least(1.0, nm::DOUBLE / greatest(nt, 1)) * 100) / 100 ELSE 0 END::DOUBLE AS mitigation_presence FROM every""",
)
def source_candidates(spark, sf):
    """Candidates of each log next to the source findings of its repository, with the share of mitigated triggers."""
    files, rules, both = stored(demo.source_files(spark, sf)), source_rules(spark), _both_rules(spark)
    logs = stored(demo.event_logs(spark, sf))
    repo = F.concat(F.lit("r"), F.regexp_extract("log_id", "^u([0-9]+)-", 1).cast("bigint") % 3)
    findings = sc.scan_sources(files, rules, stored(_changes(spark, sf))).join(logs.select("log_id", repo.alias("repo")), "repo")
    ranked = rr.with_source_candidates(match_rules(logs, both.by_detector("log")), findings, sc.scan_evidence(files, rules), both.rules)
    none = F.lit(None).cast("array<string>")
    context = logs.select("log_id", *[none.alias(c) for c in rr.CONTEXT_COLUMNS], F.lit("").alias("command"), F.lit("").alias("step"), F.lit("").alias("top_cause"))
    counts = small_table(spark, [], {"rule_id": "string", "n": "int"})
    scored = rr.score_features(stored(ranked), both, counts, context)
    value = F.get(F.filter("features", lambda f: f["name"] == "mitigation_presence"), 0)["value"]
    return scored.select("log_id", "rule_id", "detector", F.col("rank").cast("bigint").alias("rank"), F.coalesce(value, F.lit(0.0)).alias("mitigation_presence"))
