"""Building blocks of the DuckDB oracle statements."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from culprit.functions import stage as st
from culprit.functions import text as tx
from culprit.functions.regex import SPACE
from culprit.plans import demo

NL = "chr(10)"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(lit(x) for x in v) + "]" + ("::VARCHAR[]" if not v else "")
    return "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: Sequence[str], rows: Iterable[Sequence]) -> str:
    body = ",\n".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def sub(expr: str, pattern: str, replacement: str, options: str = "g") -> str:
    replacement = replacement.replace("$1", "\\1")
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(replacement)}, '{options}')"


def chain(expr: str, masks) -> str:
    for pattern, replacement in masks:
        expr = sub(expr, pattern, replacement)
    return expr


def collapse(expr: str) -> str:
    return f"trim({sub(expr, f'[{SPACE}]+', ' ')})"


def trim_space(expr: str) -> str:
    return sub(expr, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean(expr: str) -> str:
    return collapse(chain(expr, tx.CANONICAL_MASKS))


def raw_lines(expr: str) -> str:
    return f"string_split(replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"


def lines(expr: str) -> str:
    """Cleaned, non-blank lines of a log."""
    return f"list_filter(list_transform({raw_lines(expr)}, lambda l: {clean('l')}), lambda l: l <> '')"


def any_of(expr: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def line_stage(expr: str) -> str:
    whens = " ".join(f"WHEN {any_of(expr, w)} THEN '{s}'" for s, w in st.STAGE_WORDS.items())
    return f"CASE {whens} END"


def staged(source: str = "documents") -> str:
    """CTEs up to `staged(log_id, source, text, ls, ns, stage)`."""
    if source == "documents":
        first = "raw_logs AS (SELECT doc_id AS log_id, source, text FROM documents)"
    else:
        first = f"{demo.EVENT_LOGS_SQL}, raw_logs AS (SELECT log_id, source, text FROM event_logs)"
    return f"""{first}, docs AS (
  SELECT log_id, source, text, {lines('text')} AS ls FROM raw_logs
), logs AS (
  SELECT log_id, source, text, ls, list_transform(ls, lambda l: lower(l)) AS ns FROM docs
), staged AS (
  SELECT log_id, source, text, ls, ns,
    coalesce(list_filter(list_transform(ns, lambda l: {line_stage('l')}), lambda s: s IS NOT NULL)[1], '') AS stage
  FROM logs
)"""


def rule_rows(rules=None) -> str:
    return values(
        "rules",
        ["rule_id", "title", "category", "severity", "base_score", "stage_hints", "pack", "domain", "class", "mode", "fix",
         "likely_files", "tags"],
        [
            [r["rule_id"], r["title"], r["category"], r["severity"], float(r["base_score"]), r["stage_hints"], r["pack"],
             r["domain"], r["class"], r["mode"], r["fix"], r["likely_files"], r["tags"]]
            for r in rules or demo.RULES
        ],
    )


def pattern_rows(rules=None) -> str:
    rows = []
    for r in rules or demo.RULES:
        for o, section in enumerate(("any", "all")):
            rows += [[r["rule_id"], section, o, 0, 0, i, p] for i, p in enumerate(r.get(section, []))]
        for g, group in enumerate(r.get("partial", [])):
            rows += [[r["rule_id"], "partial", 2, g, group["minimum"], i, p] for i, p in enumerate(group["patterns"])]
        rows += [[r["rule_id"], "none", 3, 0, 0, i, p] for i, p in enumerate(r.get("none", []))]
    raw = values("raw_patterns", ["rule_id", "section", "so", "group_idx", "group_min", "idx", "pattern"], rows)
    return raw + f""", patterns AS (
  SELECT *, lower({collapse('pattern')}) AS norm FROM raw_patterns
), weights AS (
  SELECT norm, 1.0::DOUBLE / count(DISTINCT rule_id) AS w FROM patterns WHERE section = 'any' GROUP BY norm
)"""


def ranked(extra: str = "", rules=None, source: str = "documents") -> str:
    """CTEs up to `ranked(log_id, rule_id, score, confidence, rank, evidence, ...)`."""
    return f"""WITH {staged(source)}, {rule_rows(rules)}, {pattern_rows(rules)}, hits AS (
  SELECT s.log_id, s.stage, p.rule_id, p.section, p.so, p.group_idx, p.group_min, p.idx, p.norm,
    list_position(list_transform(s.ns, lambda l: contains(l, p.norm)), true) AS line_no,
    s.ls[list_position(list_transform(s.ns, lambda l: contains(l, p.norm)), true)] AS line
  FROM staged s JOIN patterns p ON contains(array_to_string(s.ns, chr(10)), p.norm)
), groups AS (
  SELECT log_id, rule_id, group_idx, 0.75 * count(*) + CASE WHEN count(*) >= max(group_min) THEN 1.0 ELSE 0.0 END AS part
  FROM hits WHERE section = 'partial' GROUP BY ALL
), parts AS (
  SELECT log_id, rule_id, sum(part) AS part FROM groups GROUP BY ALL
), agg AS (
  SELECT h.log_id, h.rule_id, any_value(h.stage) AS stage,
    coalesce(sum(w.w) FILTER (WHERE h.section = 'any'), 0) AS any_score,
    count(*) FILTER (WHERE h.section = 'all') AS all_hits,
    count(*) FILTER (WHERE h.section <> 'none') AS positive,
    bool_or(h.section = 'none') AS blocked,
    list(h.line ORDER BY h.so, h.group_idx, h.idx) FILTER (WHERE h.section <> 'none') AS raw_ev
  FROM hits h LEFT JOIN weights w ON w.norm = h.norm AND h.section = 'any' GROUP BY ALL
), candidates AS (
  SELECT a.log_id, a.rule_id, a.stage, a.blocked, a.positive, r.title, r.category, r.severity, r.pack, r.domain, r.class, r.mode,
    r.base_score + any_score + all_hits * 1.5 + coalesce(p.part, 0) AS base_signal,
    CASE WHEN all_hits > 0 AND all_hits = (SELECT count(*) FROM patterns q WHERE q.rule_id = a.rule_id AND q.section = 'all')
      THEN 2.0 ELSE 0.0 END AS compound_bonus,
    CASE WHEN a.stage <> '' AND list_contains(r.stage_hints, a.stage) THEN 0.75 ELSE 0.0 END AS stage_bonus,
    list_filter(raw_ev, lambda x, i: NOT list_contains(raw_ev[1:i - 1], x)) AS evidence
  FROM agg a JOIN rules r USING (rule_id) LEFT JOIN parts p ON p.log_id = a.log_id AND p.rule_id = a.rule_id
), scored AS (
  SELECT *, round((base_signal + compound_bonus + stage_bonus) * 100) / 100 AS score FROM candidates
  WHERE NOT blocked AND positive > 0
), tops AS (
  SELECT log_id, max(score) AS top FROM scored GROUP BY log_id
), seconds AS (
  SELECT t.log_id, t.top, count(*) FILTER (WHERE s.score = t.top) AS n_top,
    coalesce(max(s.score) FILTER (WHERE s.score < t.top), 0) AS second
  FROM tops t JOIN scored s USING (log_id) GROUP BY ALL
), conf AS (
  SELECT s.*, CASE WHEN s.score = t.top AND t.n_top = 1 THEN t.second ELSE t.top END AS rival
  FROM scored s JOIN seconds t USING (log_id)
), confident AS (
  SELECT *, CASE WHEN score <= 0 THEN 0.0 ELSE
    round(((score / (score + 1)) + CASE WHEN rival < score THEN 1 - rival / score ELSE 0.0 END) / 2 * 100) / 100 END AS confidence
  FROM conf
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY score DESC, confidence DESC, len(evidence) DESC, rule_id) AS rank
  FROM confident
){extra}
"""


FIRST_LINE = f"lower({trim_space('string_split(text, chr(10))[1]')})"


def results(rules=None, source: str = "documents", extra: str = "") -> str:
    """`results`: one row per log, like `evaluate_logs`."""
    return ranked(f""", firsts AS (
  SELECT log_id, source, stage, len(ls) AS n_lines, {FIRST_LINE} AS full_line FROM staged
), cut AS (
  SELECT *, decode(encode(full_line)[1:CASE
      WHEN octet_length(encode(full_line)) <= 120 THEN octet_length(encode(full_line))
      WHEN (ord_at(121)) THEN 120 WHEN (ord_at(120)) THEN 119 WHEN (ord_at(119)) THEN 118 ELSE 117 END]) AS first_line_snippet
  FROM firsts
), results AS (
  SELECT f.log_id, f.source, r.rule_id IS NOT NULL AS matched, coalesce(r.rule_id, '') AS failure_id,
    coalesce(r.confidence, 0) AS confidence, coalesce(r.evidence, []) AS evidence,
    CASE WHEN n_lines = 0 THEN 'empty fixture' ELSE '' END AS error,
    CASE WHEN first_line_snippet = '' THEN '' ELSE left(sha256(first_line_snippet), 8) END AS first_line_tag,
    first_line_snippet, f.stage, r.severity, r.category, r.title, r.score
  FROM cut f LEFT JOIN ranked r ON r.log_id = f.log_id AND r.rank = 1
){extra}""", rules, source).replace("(ord_at(121))", _not_tail(121)).replace("(ord_at(120))", _not_tail(120)).replace("(ord_at(119))", _not_tail(119))


def _not_tail(i: int) -> str:
    """Byte ``i`` of the line does not continue a code point."""
    return f"hex(encode(full_line)[{i}:{i}]) NOT BETWEEN '80' AND 'BF'"
