"""Feature-based re-ranking of ranked candidates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from culprit.functions import paths as pt
from culprit.functions import text as tx
from culprit.functions.storage import stored
from culprit.functions.tables import with_row
from culprit.functions.text import round2
from culprit.operators.rules import RuleSet

# --- fixed values: feature weights, reasons, prior limits, penalties ---------------------------------
FEATURE_WEIGHTS = {
    "detector_score": 1.60,
    "detector_confidence": 1.20,
    "candidate_separation": 0.90,
    "log_match_coverage": 1.00,
    "error_exact_match": 0.90,
    "error_fuzzy_overlap": 0.70,
    "stage_hint_match": 0.45,
    "tool_or_stack_match": 0.50,
    "file_path_relevance": 0.70,
    "changed_files_relevance": 0.90,
    "dependency_change_relevance": 0.80,
    "runtime_toolchain_change_relevance": 0.80,
    "ci_config_change_relevance": 0.80,
    "environment_drift_relevance": 0.40,
    "repo_delta_agreement": 0.90,
    "historical_fixture_support": 0.60,
    "mitigation_presence": -0.80,
}
REASONS = {
    "detector_score": "baseline detector score remains the anchor",
    "detector_confidence": "detector confidence supports the candidate",
    "candidate_separation": "competitive separation supports only the baseline leader",
    "log_match_coverage": "broader explicit signal coverage supports the candidate",
    "error_exact_match": "exact log-pattern overlap is present",
    "error_fuzzy_overlap": "token overlap between evidence and playbook patterns supports the candidate",
    "stage_hint_match": "stage hint matches the observed context",
    "tool_or_stack_match": "tool or stack tokens align with the evidence",
    "file_path_relevance": "likely files overlap with repo or source evidence",
    "changed_files_relevance": "recent changes overlap with the likely failure area",
    "dependency_change_relevance": "dependency drift aligns with the candidate",
    "runtime_toolchain_change_relevance": "runtime or toolchain drift aligns with the candidate",
    "ci_config_change_relevance": "CI workflow drift aligns with the candidate",
    "environment_drift_relevance": "repo drift signals increase uncertainty around recent changes",
    "repo_delta_agreement": "top-ranked delta cause agrees with the candidate",
    "historical_fixture_support": "accepted fixtures provide conservative support",
    "mitigation_presence": "mitigations or suppressions weaken the match",
}
PRIOR_SMOOTHING = 1.0
RULE_PRIOR_LIMIT, CATEGORY_PRIOR_LIMIT = 0.35, 0.20
RULE_PRIOR_SHARE, CATEGORY_PRIOR_SHARE = 0.7, 0.3
DELTA_MISSING, DELTA_UNMATCHED, TOPOLOGY_MISSING = -1.5, -0.75, -1.0
ID_CLASSES = {
    "dependency": ["lockfile", "dependency", "go-sum", "pip", "poetry", "npm"],
    "runtime_toolchain": ["runtime", "node-version", "missing-executable"],
}
CATEGORY_CLASSES = {
    "ci": "ci_config", "deploy": "deploy_infra", "auth": "environment", "runtime": "environment", "network": "environment",
    "test": "test_data",
}
# --- end of fixed values -------------------------------------------------------------------------------


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def rule_profiles(rule_set: RuleSet) -> DataFrame:
    """What the features need to know about each rule; one row per rule."""
    p = rule_set.patterns.filter("section IN ('any', 'all')").groupBy("rule_id").agg(
        F.collect_list(tx.token_set(F.col("pattern"))).alias("pattern_tokens"), F.count("*").alias("n_listed")
    )
    i, c = F.lower("rule_id"), F.lower("category")
    by_id = None
    for name, words in ID_CLASSES.items():
        hit = tx.contains_any(i, words)
        by_id = F.when(hit, F.lit(name)) if by_id is None else by_id.when(hit, F.lit(name))
    by_category = F.create_map(*[F.lit(x) for k, v in CATEGORY_CLASSES.items() for x in (k, v)])[c]
    source = F.when(F.lower("detector") == "source", F.lit("source_code"))
    files = F.coalesce("likely_files", F.array().cast("array<string>"))
    classes = F.array_distinct(
        F.array_compact(F.concat(F.array(by_id, by_category, source), F.transform(files, pt.changed_file_class)))
    )
    tokens = F.flatten(F.transform(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array("rule_id", "title")), tx.token_set))
    return rule_set.rules.select(
        "rule_id", "stage_hints",
        F.transform(
            F.array_sort(F.array_distinct(F.filter(files, lambda f: F.trim(f) != ""))),
            lambda h: F.struct(
                h.alias("hint"), F.contains(h, F.lit("*")).alias("glob"), _hint_regex(h).alias("rx"), _longest_piece(h).alias("piece")
            ),
        ).alias("likely_files"),
        classes.alias("classes"),
        F.array_sort(F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= 3))).alias("tokens"),
    ).join(p, "rule_id", "left")


def _hint_regex(hint: Column) -> Column:
    """Glob hint as one regex: without a slash it fits the base name, else the whole path."""
    rx = pt.glob_to_regex(hint)
    return F.when(F.contains(hint, F.lit("/")), rx).otherwise(F.concat(F.lit("(?:^|/)"), F.substring(rx, F.lit(2), F.length(rx))))


def _longest_piece(hint: Column) -> Column:
    """Longest literal piece of a glob: a path without it cannot fit."""
    pieces = F.transform(F.split(hint, "[*?]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    return F.array_max(pieces)["p"]


def _file_fits(file: Column, hint: Column) -> Column:
    """A hint with ``*`` is a glob on the path or base name; otherwise part of the path.

    The cheap test for the literal piece spares most regex evaluations.
    """
    return F.when(hint["glob"], F.contains(file, hint["piece"]) & F.rlike(file, hint["rx"])).otherwise(F.contains(file, hint["hint"]))


def _ratio(n: Column, of: Column) -> Column:
    return F.when(of > 0, clamp01(n / of)).otherwise(0.0)


def prior(rows: DataFrame, counts: DataFrame, log_id: str) -> DataFrame:
    """Add ``prior``: how often rule and category were seen, smoothed and limited.

    Category counts cover only the candidates of the same log.
    """
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_total"), F.count("*").alias("_rules"), F.coalesce(F.max("n"), F.lit(0)).alias("_max"))
    d = with_row(rows.join(counts.select("rule_id", F.col("n").alias("_n")), "rule_id", "left"), totals)
    known = F.col("_n").isNotNull() & (F.col("category") != "")
    d = d.withColumn("_cat", F.sum(F.when(known, F.col("_n"))).over(W.partitionBy(log_id, "category")))
    d = d.withColumn("_cats", F.size(F.collect_set(F.when(known, F.col("category"))).over(W.partitionBy(log_id))))
    s = F.lit(PRIOR_SMOOTHING)
    uniform = F.lit(1.0) / F.greatest(F.col("_rules"), F.lit(1))
    p_rule = (F.coalesce("_n", F.lit(0)) + s) / (F.col("_total") + s * F.col("_rules"))
    p_cat = F.when(F.coalesce("_cat", F.lit(0)) > 0, (F.col("_cat") + s) / (F.col("_total") + s * F.col("_cats"))).otherwise(uniform)

    def limited(p: Column, limit: float) -> Column:
        return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.log(p / uniform)))

    value = round2(limited(p_rule, RULE_PRIOR_LIMIT) * RULE_PRIOR_SHARE + limited(p_cat, CATEGORY_PRIOR_LIMIT) * CATEGORY_PRIOR_SHARE)
    support = F.when(F.col("_max") > 0, clamp01(F.coalesce("_n", F.lit(0)) / F.col("_max"))).otherwise(0.0)
    return d.withColumn("prior", F.when(F.col("_total") == 0, 0.0).otherwise(value)).withColumn("history_support", support).drop(
        "_n", "_total", "_rules", "_max", "_cat", "_cats"
    )


FILE_COLUMNS = ["changed_files", "recent_files"]
CONTEXT_COLUMNS = [*FILE_COLUMNS, "drift_signals", "hotfix_signals", "topology_signals", "delta_signals"]


def _file_values(rows: DataFrame) -> dict[str, Column]:
    """Features of the ``FILE_COLUMNS`` of a row and the hints and classes of its rule; ``changed_classes`` are given."""
    none = F.array().cast("array<string>")
    changed, recent = (F.coalesce(rows[c], none) for c in FILE_COLUMNS)
    repo_files = F.array_distinct(F.filter(F.concat(recent, changed), lambda f: F.trim(f) != ""))
    hints = F.col("likely_files")

    def fitting(files: Column) -> Column:
        return F.size(F.filter(files, lambda f: F.exists(hints, lambda h: _file_fits(f, h))))

    def class_share(name: str) -> Column:
        n = F.size(F.filter(F.coalesce("changed_classes", none), lambda c: F.coalesce(c == name, F.lit(False))))
        return F.when(F.array_contains("classes", name), _ratio(n, F.size(changed))).otherwise(0.0)

    return {
        "file_path_relevance": F.when(F.size(hints) > 0, _ratio(fitting(repo_files), F.size(hints))).otherwise(0.0),
        "changed_files_relevance": F.when(F.size(hints) > 0, _ratio(fitting(changed), F.size(changed))).otherwise(0.0),
        "dependency_change_relevance": class_share("dependency"),
        "runtime_toolchain_change_relevance": class_share("runtime_toolchain"),
        "ci_config_change_relevance": class_share("ci_config"),
    }


def _classed(files: DataFrame) -> DataFrame:
    """Classes of the changed files once per list, not once per candidate."""
    return files.withColumn("changed_classes", F.transform(F.coalesce("changed_files", F.array().cast("array<string>")), pt.changed_file_class))


def score_features(
    ranked: DataFrame,
    rule_set: RuleSet,
    counts: DataFrame,
    context: DataFrame,
    boosts: DataFrame | None = None,
    log_id: str = "log_id",
    weights: Mapping[str, float] = FEATURE_WEIGHTS,
    delta_requested: bool = False,
    files: DataFrame | None = None,
) -> DataFrame:
    """Candidates with ``prior`` and their non-zero ``features`` (name, value, weight, reason).

    ``ranked`` comes from :func:`culprit.operators.match.match_rules`. ``context`` has the log id, the
    arrays of ``CONTEXT_COLUMNS``, ``command``, ``step`` and ``top_cause``. ``boosts(rule_id, kind,
    signal, weight, required)`` lists change and ownership boosts; a row without a signal only
    states that the rule requires that kind of context. File lists that many logs share come as ``files(context_id,
    changed_files, recent_files)``; ``context`` then has a ``context_id`` in their place, and each list meets each rule once.
    """
    none = F.array().cast("array<string>")
    profiles = rule_profiles(rule_set)
    rows = ranked.join(profiles, "rule_id")
    if files is None:
        rows = rows.join(_classed(context), log_id, "left")
        file_values = _file_values(rows)
    else:
        every = with_row(_classed(files), profiles.agg(F.collect_list(F.struct("rule_id", "likely_files", "classes")).alias("_rules")))
        pairs = every.select("context_id", *FILE_COLUMNS, "changed_classes", F.explode("_rules").alias("r")).select("context_id", *FILE_COLUMNS, "changed_classes", "r.*")
        file_values = _file_values(pairs)
        pairs = pairs.select("context_id", "rule_id", *[v.alias(n) for n, v in file_values.items()])
        rows = rows.join(context, log_id, "left").join(stored(pairs), ["context_id", "rule_id"], "left")
        file_values = {n: F.coalesce(n, F.lit(0.0)) for n in file_values}
    has_delta = F.col("delta_signals").isNotNull()
    for c in CONTEXT_COLUMNS if files is None else CONTEXT_COLUMNS[len(FILE_COLUMNS) :]:
        rows = rows.withColumn(f"_{c}", F.coalesce(c, none))
    rows = prior(rows, counts, log_id)
    per_log = W.partitionBy(log_id)
    rows = rows.withColumn("_top", F.max("score").over(per_log)).withColumn("_second", F.max(F.when(F.col("rank") == 2, F.col("score"))).over(per_log))
    score = F.col("score")
    separation = F.when(
        (F.col("rank") != 1) | (score <= 0), 0.0
    ).when(F.col("_second").isNull(), 1.0).when(F.col("_second") >= score, 0.0).otherwise(clamp01((score - F.col("_second")) / score))
    haystack = F.lower(F.array_join(F.concat("evidence", F.array(F.coalesce("command", F.lit("")), F.coalesce("step", F.lit("")))), " "))
    # columns of their own: inside a lambda they would be computed once per element
    rows = rows.withColumn("_tokens", F.transform("evidence", tx.token_set)).withColumn("_haystack", haystack)
    ev_tokens, haystack = F.col("_tokens"), F.col("_haystack")
    pts = F.coalesce("pattern_tokens", F.array().cast("array<array<string>>"))
    exact = F.exists(ev_tokens, lambda e: F.exists(pts, lambda p: e == p))
    fuzzy = F.coalesce(F.array_max(F.flatten(F.transform(ev_tokens, lambda e: F.transform(pts, lambda p: tx.jaccard(e, p))))), F.lit(0.0))
    drift = clamp01(F.size("_drift_signals") * 0.2 + F.size("_hotfix_signals") * 0.1)
    values = {
        "detector_score": F.when(F.col("_top") > 0, clamp01(score / F.col("_top"))).otherwise(0.0),
        "detector_confidence": clamp01(F.col("confidence")),
        "candidate_separation": separation,
        "log_match_coverage": _ratio(F.col("n_matched"), F.coalesce("n_listed", F.lit(0))),
        "error_exact_match": exact.cast("double"),
        "error_fuzzy_overlap": clamp01(fuzzy),
        "stage_hint_match": ((F.col("stage") != "") & F.exists("stage_hints", lambda h: F.lower(h) == F.col("stage"))).cast("double"),
        "tool_or_stack_match": F.when(
            F.trim(haystack) != "", _ratio(F.size(F.filter("tokens", lambda t: F.contains(haystack, t))), F.size("tokens"))
        ).otherwise(0.0),
        **file_values,
        "environment_drift_relevance": drift,
        "repo_delta_agreement": F.coalesce(F.array_contains("classes", F.col("top_cause")), F.lit(False)).cast("double"),
        "historical_fixture_support": F.col("history_support"),
    }
    if "n_mitigations" in ranked.columns:  # candidates of a source scan
        values["mitigation_presence"] = clamp01(F.col("n_mitigations") / F.greatest(F.col("n_triggers"), F.lit(1)))

    def feature(name, value: Column, weight: Column, reason) -> Column:
        return F.struct(name.alias("name"), value.alias("value"), weight.alias("weight"), reason.alias("reason"))

    features = F.array(
        *[feature(F.lit(n), round2(v), F.lit(float(weights.get(n, 0.0))), F.lit(REASONS[n])) for n, v in values.items()]
    )
    if boosts is not None:
        per_rule = boosts.groupBy("rule_id").agg(
            F.array_sort(F.collect_list(F.when(F.coalesce("signal", F.lit("")) != "", F.struct("kind", "signal", F.coalesce("weight", F.lit(0.0)).alias("w"))))).alias("_boosts"),
            F.max(F.when(F.col("kind") == "delta", F.col("required"))).alias("_needs_delta"),
            F.max(F.when(F.col("kind") == "topology", F.col("required"))).alias("_needs_topology"),
        )
        rows = rows.join(per_rule, "rule_id", "left")
        listed = F.coalesce("_boosts", F.array().cast("array<struct<kind:string,signal:string,w:double>>"))
        needs = {k: F.coalesce(f"_needs_{k}", F.lit(False)) for k in ("delta", "topology")}
        requested = F.lit(delta_requested)

        def active(kind: str) -> Column:
            return F.filter(listed, lambda b: (b["kind"] == kind) & F.array_contains(F.col(f"_{kind}_signals"), b["signal"]))

        def one(cond: Column, name: str, weight: float, reason: str) -> Column:
            empty = F.slice(F.array(feature(F.lit(""), F.lit(0.0), F.lit(0.0), F.lit(""))), 1, 0)
            return F.when(cond, F.array(feature(F.lit(name), F.lit(1.0), F.lit(weight), F.lit(reason)))).otherwise(empty)

        def boosted(cond: Column, kind: str) -> Column:
            empty = F.slice(F.array(feature(F.lit(""), F.lit(0.0), F.lit(0.0), F.lit(""))), 1, 0)
            rows_ = F.transform(
                active(kind),
                lambda b: feature(
                    F.concat(F.lit(f"{kind}_boost:"), b["signal"]), F.lit(1.0), round2(F.when(b["w"] == 0, 1.0).otherwise(b["w"])),
                    F.concat(F.lit(f"{kind} signal "), b["signal"], F.lit(" aligns with the candidate")),
                ),
            )
            return F.when(cond, rows_).otherwise(empty)

        delta_missing = requested & needs["delta"] & ~has_delta
        has_boosts = F.exists(listed, lambda b: b["kind"] == "delta")
        unmatched = requested & ~delta_missing & needs["delta"] & has_boosts & (F.size(active("delta")) == 0)
        topology_missing = needs["topology"] & (F.size("_topology_signals") == 0)
        features = F.concat(
            features,
            one(delta_missing, "delta_required_missing", DELTA_MISSING, "candidate requires delta context but no change delta was available"),
            one(unmatched, "delta_required_unmatched", DELTA_UNMATCHED, "candidate requires delta support but the observed change does not match its delta signals"),
            boosted(requested & ~delta_missing, "delta"),
            one(topology_missing, "topology_required_missing", TOPOLOGY_MISSING, "candidate requires topology context but no topology signals were observed"),
            boosted(~topology_missing, "topology"),
        )
    kept = F.filter(features, lambda f: (f["value"] != 0) & (f["weight"] != 0))
    return rows.select(*ranked.columns, "prior", kept.alias("features"))


EVIDENCE_LINES = 5  # that a source finding shows as a candidate


def with_source_candidates(ranked: DataFrame, findings: DataFrame, evidence: DataFrame, rules: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Log candidates and source findings of the same logs in one ranking, for :func:`score_features`.

    ``findings(log id, repo, ...)`` are rows of :func:`culprit.operators.source_scan.scan_sources` with the logs of their
    repository, ``evidence`` the rows of ``scan_evidence``, ``rules(rule_id, title, category, severity)`` describe the
    source rules. A log candidate has no triggers or mitigations in code; a finding has no stage.
    """
    first = W.partitionBy("repo", "rule_id").orderBy("path", "line", "evidence")
    shown = evidence.filter("kind = 'trigger'").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= EVIDENCE_LINES)
    lists = shown.groupBy("repo", "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "evidence"))), lambda x: x["evidence"]).alias("evidence"))
    source = findings.join(lists, ["repo", "rule_id"], "left").join(rules.select("rule_id", "title", "category", "severity"), "rule_id")
    own = {
        "evidence": F.coalesce("evidence", F.array().cast("array<string>")), "stage": F.lit(""), "n_matched": F.lit(0), "compound_bonus": F.coalesce("compound_bonus", F.lit(0.0)),
        "stage_bonus": F.lit(0.0), "detector": F.lit("source"), "n_triggers": F.col("n_triggers").cast("bigint"), "n_mitigations": F.col("n_mitigations").cast("bigint"),
    }
    logs = ranked.withColumns({"detector": F.lit("log"), "n_triggers": F.lit(0).cast("bigint"), "n_mitigations": F.lit(0).cast("bigint")}).drop("rank")
    both = logs.unionByName(source.select(*[own.get(c, F.col(c)).alias(c) for c in logs.columns]))
    order = W.partitionBy(log_id).orderBy(F.desc("score"), F.desc("confidence"), F.desc(F.size("evidence")), F.asc("rule_id"))
    return both.withColumn("rank", F.row_number().over(order))


def rerank(scored: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Final score, contributions, strongest reasons, recalibrated confidence and new rank."""
    parts = F.transform(
        "features",
        lambda f: F.struct(
            f["name"].alias("feature"), f["value"].alias("value"), round2(f["weight"]).alias("weight"),
            round2(f["value"] * f["weight"]).alias("contribution"), f["reason"].alias("reason"),
        ),
    )
    d = scored.withColumn("contributions", F.filter(parts, lambda c: c["contribution"] != 0))
    final = F.aggregate("contributions", F.col("score") + F.col("prior"), lambda a, c: a + c["contribution"])
    ordered = F.transform(
        F.array_sort(F.transform("contributions", lambda c: F.struct((-F.abs(c["contribution"])).alias("a"), c["feature"].alias("f"), c.alias("c")))),
        lambda x: x["c"],
    )

    def strongest(positive: bool) -> Column:
        sign = F.filter("contributions", lambda c: (c["contribution"] > 0) if positive else (c["contribution"] < 0))
        return F.slice(F.array_distinct(F.transform(sign, lambda c: c["reason"])), 1, 3)

    d = d.withColumn("final_score", round2(final)).withColumn("contributions", ordered)
    d = d.withColumn("strongest_positive", strongest(True)).withColumn("strongest_negative", strongest(False))
    order = W.partitionBy(log_id).orderBy(F.desc("final_score"), F.desc("score"), F.desc("confidence"), F.asc("rule_id"))
    d = d.withColumn("new_rank", F.row_number().over(order))
    d = d.withColumn("_next", F.coalesce(F.lead("final_score").over(order), F.lit(0.0)))
    d = d.withColumn("_best", F.max("final_score").over(W.partitionBy(log_id)))
    s = F.col("final_score")
    coverage = clamp01(s / (s + 1))
    separation = clamp01((s - F.col("_next")) / F.greatest(s, F.lit(1.0)))
    mixed = round2((coverage + separation + F.col("confidence")) / 3)
    alone = (s == F.col("_best")) & (F.col("_next") == 0)
    d = d.withColumn("new_confidence", F.when(alone, round2(F.greatest(mixed, F.col("confidence")))).otherwise(mixed))
    return d.drop("_next", "_best")
