"""Statistics over labelled logs: accuracy, baseline gate, mode comparison, review of duplicates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from culprit.functions import text as tx
from culprit.functions.storage import stored
from culprit.functions.tables import with_row

# --- fixed values: confidence floor of real fixtures, default ranks, near-duplicate threshold ---
REAL_CONFIDENCE_FLOOR = 0.55
DEFAULT_TOP_N = 3
NEAR_DUPLICATE = 0.82
# --- end of fixed values ---------------------------------------------------------------------------
LEVELS = (0.4, 0.0)  # bounds under which a set without a near-duplicate looks for its best partner
COMMON = 128  # lines that more sets hold are looked at once for all sets that hold the same of them
GRID = 2_000  # groups in a row or column of the grid of a common line


def prepare_fixtures(fixtures: DataFrame) -> DataFrame:
    """Effective log text, class and fingerprint of raw fixture rows."""
    text = F.coalesce(
        F.when(tx.trim_space(F.col("normalized_log")) != "", F.col("normalized_log")), F.col("raw_log"), F.lit("")
    )
    out = fixtures.withColumn("text", tx.canonicalize_log(text))
    out = out.withColumn("fixture_class", F.coalesce(F.nullif("fixture_class", F.lit("")), F.lit("minimal")))
    known = F.nullif(F.trim(F.coalesce("fingerprint", F.lit(""))), F.lit(""))
    return out.withColumn("fingerprint", F.coalesce(known, tx.fixture_fingerprint(F.col("text"))))


def evaluate_fixtures(diagnosed: DataFrame, fixtures: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Expected rank and verdicts of each labelled log.

    ``diagnosed`` comes from :func:`culprit.operators.match.diagnose`; ``fixtures`` has the log id,
    ``fixture_class``, ``expected_rule``, ``top_n``, ``strict_top1``, ``expected_stage``,
    ``disallowed``, ``max_unexpected``, ``min_confidence``.
    """
    minimal = F.col("fixture_class") == "minimal"
    allowed = F.when(F.col("top_n") > 0, F.col("top_n")).when(minimal, 1).otherwise(DEFAULT_TOP_N)
    floor = (
        F.when(F.col("min_confidence") > 0, F.col("min_confidence"))
        .when(F.col("fixture_class") == "real", REAL_CONFIDENCE_FLOOR)
        .otherwise(0.0)
    )
    f = fixtures.withColumns({"allowed_rank": allowed, "floor": floor, "strict": F.col("strict_top1") | minimal})
    columns = [c for c in f.columns if c != log_id]
    rows = f.join(diagnosed.select(log_id, "rule_id", "rank", "confidence", "stage", "is_empty", "live"), log_id)
    expected = F.col("live") & (F.col("rule_id") == F.col("expected_rule"))
    in_top = F.col("live") & (F.col("rank") <= F.greatest(F.col("allowed_rank"), F.lit(3)))
    g = rows.groupBy(log_id).agg(
        *[F.any_value(c).alias(c) for c in columns],
        F.coalesce(F.min(F.when(expected, F.col("rank"))), F.lit(0)).alias("expected_rank"),
        F.max(F.when(expected, F.col("confidence"))).alias("expected_confidence"),
        F.max(F.when(F.col("live") & (F.col("rank") == 1), F.col("rule_id"))).alias("top_rule"),
        F.any_value("stage").alias("stage"),
        F.any_value("is_empty").alias("is_empty"),
        F.sum((in_top & (F.col("rule_id") != F.col("expected_rule"))).cast("bigint")).alias("unexpected_top_n"),
        F.sum((in_top & F.array_contains("disallowed", F.col("rule_id"))).cast("bigint")).alias("disallowed_hits"),
    )
    labelled = F.coalesce(F.col("expected_rule"), F.lit("")) != ""
    error = F.col("is_empty")
    r = F.col("expected_rank")
    by_rank = F.when(F.col("strict"), r == 1).otherwise((r > 0) & (r <= F.col("allowed_rank")))
    mismatch = (F.coalesce(F.col("expected_stage"), F.lit("")) != "") & (F.col("stage") != F.col("expected_stage"))
    success = F.when(~labelled, F.col("top_rule").isNotNull()).otherwise(~error & by_rank & ~mismatch)
    false_positive = (
        F.coalesce(F.col("top_rule") != F.col("expected_rule"), F.lit(False))
        | (F.coalesce("disallowed_hits", F.lit(0)) > 0)
        | ((F.col("max_unexpected") > 0) & (F.coalesce("unexpected_top_n", F.lit(0)) > F.col("max_unexpected")))
    )
    weak = (r > 0) & ((r > 1) | (F.col("expected_confidence") < F.col("floor")))
    return g.select(
        log_id, *columns, "expected_rank", "top_rule", "stage",
        labelled.alias("labelled"),
        success.alias("success"),
        (labelled & ~success).alias("unmatched"),
        (labelled & ~error & mismatch).alias("stage_mismatch"),
        (labelled & ~error & false_positive).alias("false_positive"),
        (labelled & ~error & weak).alias("weak_match"),
        F.coalesce("unexpected_top_n", F.lit(0)).alias("unexpected_top_n"),
        F.coalesce("disallowed_hits", F.lit(0)).alias("disallowed_hits"),
    ).drop("allowed_rank", "floor", "strict")


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))


def report(evaluated: DataFrame) -> DataFrame:
    """One row of counts and rates over the labelled fixtures."""
    lab = evaluated.filter("labelled")
    out = lab.agg(
        F.count("*").alias("fixture_count"),
        _count(F.col("expected_rank") == 1).alias("top1_count"),
        _count((F.col("expected_rank") >= 1) & (F.col("expected_rank") <= 3)).alias("top3_count"),
        _count(F.col("unmatched")).alias("unmatched_count"),
        _count(F.col("false_positive")).alias("false_positive_count"),
        _count(F.col("weak_match")).alias("weak_match_count"),
    )
    for name in ("top1", "top3", "unmatched", "false_positive", "weak_match"):
        rate = F.when(F.col("fixture_count") == 0, 0.0).otherwise(F.col(f"{name}_count") / F.col("fixture_count"))
        out = out.withColumn(f"{name}_rate", rate)
    return out


def problem_ids(evaluated: DataFrame, log_id: str = "log_id") -> DataFrame:
    """(problem, fixture) rows of the report's id lists."""
    flags = F.array_compact(
        F.array(*[F.when(F.col(c), F.lit(c)) for c in ("unmatched", "false_positive", "weak_match")])
    )
    return evaluated.filter("labelled").select(F.explode(flags).alias("problem"), log_id)


def breakdowns(evaluated: DataFrame) -> DataFrame:
    """Counts by expected rule, provider and adapter in one pass (grouping sets)."""
    d = evaluated.select(
        F.when(F.col("labelled"), F.col("expected_rule")).alias("rule"),
        F.nullif(F.trim("provider"), F.lit("")).alias("provider"),
        F.nullif(F.trim("adapter"), F.lit("")).alias("adapter"),
    )
    rule, provider, adapter = F.col("rule"), F.col("provider"), F.col("adapter")
    sets = d.groupingSets([[rule], [provider], [adapter]], rule, provider, adapter).agg(
        F.count("*").alias("n"), F.grouping_id().alias("g")
    )
    kind = F.when(F.col("g") == 3, "playbook").when(F.col("g") == 5, "provider").otherwise("adapter")
    return sets.select(kind.alias("kind"), F.coalesce("rule", "provider", "adapter").alias("key"), "n").filter("key IS NOT NULL")


def report_fingerprint(report_row: DataFrame, counts: DataFrame, fixture_class: str) -> DataFrame:
    """Fingerprint of a report: its rates and its breakdown counts as one text."""
    order = F.when(F.col("kind") == "playbook", 0).when(F.col("kind") == "provider", 1).otherwise(2)
    text = F.concat_ws(":", "kind", "key", "n")
    parts = counts.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "key", text.alias("t")))), lambda x: x["t"]), "|"
        ).alias("counts_text")
    )
    head = F.format_string(
        "%s:%d|%.4f|%.4f|%.4f|%.4f|%.4f", F.lit(fixture_class), F.col("fixture_count"),
        *[F.col(f"{n}_rate") for n in ("top1", "top3", "unmatched", "false_positive", "weak_match")],
    )
    both = with_row(report_row, parts)
    return both.withColumn("fingerprint", tx.fixture_fingerprint(F.concat_ws("|", head, F.nullif("counts_text", F.lit(""))))).drop(
        "counts_text"
    )


def baseline_gate(report_row: DataFrame, baseline: Mapping[str, object]) -> DataFrame:
    """Violations of a stored baseline: count drift, thresholds, regressions, fingerprint drift."""
    limits = baseline["thresholds"]
    rates = [
        ("top-1", "top1_rate", "min_top_1", True), ("top-3", "top3_rate", "min_top_3", True),
        ("unmatched", "unmatched_rate", "max_unmatched", False),
        ("false-positive", "false_positive_rate", "max_false_positive", False),
        ("weak-match", "weak_match_rate", "max_weak_match", False),
    ]
    checks = [
        F.when(
            F.col("fixture_count") != baseline["fixture_count"],
            F.format_string("fixture count changed: baseline=%d current=%d", F.lit(baseline["fixture_count"]), F.col("fixture_count")),
        )
    ]
    for label, column, key, at_least in rates:
        limit = float(limits[key])
        c = F.col(column)
        words = "is below" if at_least else "exceeds"
        broken = c < limit if at_least else c > limit
        if label == "weak-match":
            broken = broken & F.lit(limit > 0)
        checks.append(F.when(broken, F.format_string(f"{label} rate %.3f {words} threshold %.3f", c, F.lit(limit))))
    for label, column, _, at_least in rates:
        old = float(baseline[column])
        c = F.col(column)
        checks.append(
            F.when(c < old if at_least else c > old, F.format_string(f"{label} rate regressed from %.3f to %.3f", F.lit(old), c))
        )
    if baseline.get("fingerprint"):
        checks.append(
            F.when(
                F.col("fingerprint") != baseline["fingerprint"],
                F.format_string("corpus fingerprint changed: baseline=%s current=%s", F.lit(baseline["fingerprint"]), F.col("fingerprint")),
            )
        )
    return report_row.withColumn("violations", F.array_compact(F.array(*checks))).withColumn("pass", F.size("violations") == 0)


def compare_modes(baseline: DataFrame, other: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Expected rank of each labelled fixture in two ranking modes, and what changed."""
    b = baseline.select(log_id, F.col("expected_rank").alias("baseline_rank"))
    o = other.filter("labelled").select(log_id, F.col("expected_rank").alias("other_rank"))
    r0, r1 = F.col("baseline_rank"), F.col("other_rank")
    change = (
        F.when((r1 > 0) & ((r0 == 0) | (r1 < r0)), "improved")
        .when((r0 > 0) & ((r1 == 0) | (r1 > r0)), "regressed")
        .otherwise("unchanged")
    )
    return b.join(o, log_id).withColumn("change", change)


def truncated3(c: Column) -> Column:
    """Three decimals, cut toward zero after adding half a unit (the mode comparison's own rounding)."""
    return (c * 1000 + 0.5).cast("bigint") / 1000


def mode_summary(baseline_report: DataFrame, other_report: DataFrame, changes: DataFrame) -> DataFrame:
    a = baseline_report.select(*[F.col(c).alias(f"baseline_{c}") for c in ("top1_rate", "top3_rate")])
    b = other_report.select(*[F.col(c).alias(f"other_{c}") for c in ("top1_rate", "top3_rate")])
    n = changes.agg(*[_count(F.col("change") == c).alias(c) for c in ("improved", "regressed", "unchanged")])
    out = with_row(with_row(a, b), n)
    for k in ("top1", "top3"):
        out = out.withColumn(f"{k}_delta", truncated3(F.col(f"other_{k}_rate") - F.col(f"baseline_{k}_rate")))
    return out


def metadata_issues(fixtures: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Rows ``(fixture, issue, detail)``: repeated ids or fingerprints and missing required fields."""
    def blank(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""

    def repeated(key: str, issue: str) -> DataFrame:
        # counts per key, not a list of all members: a hot key stays one row
        keyed = fixtures.filter(~blank(key)).select(F.col(key).alias("_key"), log_id)
        g = keyed.groupBy("_key").agg(F.count("*").alias("n"), F.min(log_id).alias(log_id)).filter("n > 1")
        return g.select(log_id, F.lit(issue).alias("issue"), F.concat_ws(" x", F.col("_key").cast("string"), F.col("n")).alias("detail"))

    required = {
        "real": ["title", "adapter", "provider", "url", "promoted_at"],
        "staging": ["adapter", "provider", "url"],
    }
    parts = [F.when(blank("fingerprint"), F.lit("fingerprint"))]
    for cls, names in required.items():
        parts += [F.when((F.col("fixture_class") == cls) & blank(n), F.lit(n)) for n in names]
    missing = fixtures.select(log_id, F.explode(F.array_compact(F.array(*parts))).alias("detail")).select(
        log_id, F.lit("missing field").alias("issue"), "detail"
    )
    status = fixtures.filter((F.col("fixture_class") == "real") & (F.coalesce(F.col("review_status"), F.lit("")) != "promoted"))
    wrong = status.select(log_id, F.lit("review status must be promoted").alias("issue"), F.coalesce("review_status", F.lit("")).alias("detail"))
    return missing.unionByName(wrong).unionByName(repeated("fingerprint", "duplicate fingerprint")).unionByName(
        repeated(log_id, "duplicate id")
    )


def ingest_new(batch: DataFrame, existing: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Rows of a batch whose fingerprint is neither in the existing corpora nor earlier in the batch."""
    fresh = batch.join(existing.select("fingerprint").distinct(), "fingerprint", "left_anti")
    columns = [c for c in batch.columns if c != "fingerprint"]
    first = fresh.groupBy("fingerprint").agg(F.min_by(F.struct(*columns), F.col(log_id)).alias("r"))
    return first.select("fingerprint", "r.*")


def promote(staging: DataFrame, promotions: DataFrame, promoted_at: Column, log_id: str = "log_id") -> DataFrame:
    """Staged fixtures with an accepted expectation become real ones."""
    new = [c for c in promotions.columns if c != log_id]
    kept = staging.drop(*new)
    return (
        kept.join(promotions, log_id)
        .withColumn("fixture_class", F.lit("real"))
        .withColumn("review_status", F.lit("promoted"))
        .withColumn("promoted_at", promoted_at)
    )


def rule_coverage(rules: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Per category: rules, rules with a fixture, fixtures, and the rules without one."""
    n = fixtures.filter("coalesce(expected_rule, '') <> ''").groupBy(F.col("expected_rule").alias("rule_id")).agg(
        F.count("*").alias("n")
    )
    d = rules.select("rule_id", "category").join(n, "rule_id", "left")
    return d.groupBy("category").agg(
        F.count("*").alias("rule_count"),
        _count(F.col("n") > 0).alias("covered_rules"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("fixture_count"),
        F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("rule_id")))).alias("uncovered"),
    )


def taxonomy_rollup(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Matched logs by domain, class and mode with sub-totals."""
    # count per rule first, so the roll-up sees one row per rule and not one per log
    per_rule = results.filter("matched").groupBy(F.col("failure_id").alias("rule_id")).agg(F.count("*").alias("n"))
    d = per_rule.join(rules.select("rule_id", "domain", "class", "mode"), "rule_id")
    return d.rollup("domain", "class", "mode").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))


def line_sets(texts: DataFrame, log_id: str = "log_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of lines of a corpus: ``members(log_id, fingerprint, n_lines, set_id)``, ``sets(set_id, n, hs)`` and
    ``ranked(set_id, n, h, holders, at)``, the lines that several sets hold.

    Copies share one set. ``at`` is a line's place in its set when lines are in order of the number of sets
    that hold them: lines of one set only come first and are never looked up, boilerplate is last. Lines
    are compared by their 64-bit hash.
    """
    lines = F.filter(
        F.transform(F.split(F.lower(F.col(text)), "\n"), tx.trim_space), lambda l: l != ""
    )
    base = texts.select(
        log_id, tx.fixture_fingerprint(F.col(text)).alias("fingerprint"),
        F.array_sort(F.array_distinct(F.transform(lines, lambda l: F.xxhash64(l)))).alias("hs"),
    ).withColumn("set_key", F.sha2(F.array_join(F.col("hs").cast("array<string>"), ","), 256))
    base = stored(base)
    sets = stored(base.groupBy("set_key").agg(F.min(log_id).alias("set_id"), F.any_value("hs").alias("hs")).withColumn("n", F.size("hs")))
    members = base.select(log_id, "fingerprint", "set_key", F.size("hs").alias("n_lines")).join(sets.select("set_key", "set_id"), "set_key").drop("set_key")
    each = sets.select("set_id", "n", F.explode("hs").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("holders")).filter("holders > 1")
    own = W.partitionBy("set_id")
    at = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("holders", "h"))
    ranked = stored(each.join(often, "h").withColumn("at", at))
    return members, sets.select("set_id", "n", "hs"), ranked


def _prefix(ranked: DataFrame, threshold: float) -> DataFrame:
    """The lines of each set of which one is in every set at least so similar."""
    return ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)


def _similarity(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """``set_id_a, set_id_b, similarity`` of pairs of sets."""
    lines_of = lambda s: sets.select(F.col("set_id").alias(f"set_id_{s}"), F.col("hs").alias(f"hs_{s}"))
    shared = F.size(F.array_intersect("hs_a", "hs_b"))
    similarity = shared / (F.size("hs_a") + F.size("hs_b") - shared)
    return candidates.join(lines_of("a"), "set_id_a").join(lines_of("b"), "set_id_b").select("set_id_a", "set_id_b", similarity.alias("similarity"))


def near_sets(sets: DataFrame, ranked: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """Pairs ``(set_a, set_b, similarity)`` of different line sets (see :func:`line_sets`) that are near-duplicates.

    Pairs come from prefix filtering: with any fixed order of lines, two sets at Jaccard >= t
    share a line among the first ``n - ceil(t n) + 1`` of each. The index has a set's number, size and
    the line's position, no lines; sets meet in their own size class and the next one, and size and
    position decide which of them are compared, each pair once.
    """
    size_class = F.floor(F.log("n") / F.lit(-math.log(threshold)))
    index = _prefix(ranked, threshold).withColumn("class", size_class).select("h", "class", "set_id", "n", "at")
    left = index.select("h", "class", *[F.col(c).alias(f"{c}_a") for c in ("set_id", "n", "at")])
    right = index.select("h", F.explode(F.array("class", F.col("class") - 1)).alias("class"), *[F.col(c).alias(f"{c}_b") for c in ("set_id", "n", "at")])
    na, nb = F.col("n_a"), F.col("n_b")
    once = (na < nb) | ((na == nb) & (F.col("set_id_a") < F.col("set_id_b")))
    reach = F.least(na - F.col("at_a"), nb - F.col("at_b")) + F.least("at_a", "at_b")
    near = (na >= nb * threshold - 1e-9) & (reach >= (na + nb) * (threshold / (1 + threshold)) - 1e-9)
    candidates = left.join(right, ["h", "class"]).filter(once & near).select("set_id_a", "set_id_b").distinct()
    pairs = _similarity(candidates, sets).filter(F.col("similarity") >= threshold)
    return pairs.select(F.least("set_id_a", "set_id_b").alias("set_a"), F.greatest("set_id_a", "set_id_b").alias("set_b"), "similarity")


def best_partners(sets: DataFrame, ranked: DataFrame, pairs: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """``set_id, best``: the largest similarity of each set to any other set that shares a line with it.

    ``pairs`` settle the sets that have a near-duplicate. The others look for partners under falling
    bounds: at each level only sets without a partner that good lengthen their prefixes, at the last one to
    all their lines. Lines of more than ``COMMON`` sets are left out of these prefixes; what sets share by
    such lines alone is found from groups of sets that hold the same common lines. Two groups with k of
    them in common give each member of one the smallest set of the other as a partner, so a
    group counts once, however many sets it has.
    """
    known = pairs.select(F.explode(F.array("set_a", "set_b")).alias("set_id"), "similarity").groupBy("set_id").agg(F.max("similarity").alias("best"))
    left = sets.filter("n > 0").select("set_id", "n").join(known, "set_id", "left_anti")
    open_sets = stored(left.join(_by_common_lines(ranked, left), "set_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0))))
    found = [known]
    rare = ranked.filter(F.col("holders") <= COMMON)
    for level in levels:
        prefix = _prefix(rare, level).select("h", "set_id", "n", "at")
        a = prefix.join(open_sets.select("set_id", "best"), "set_id").select("h", "best", *[F.col(c).alias(f"{c}_a") for c in ("set_id", "n", "at")])
        b = prefix.select("h", *[F.col(c).alias(f"{c}_b") for c in ("set_id", "n", "at")])
        # of a first shared line at these places, so many lines can be shared at most
        most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("at_a", "at_b")
        bound = most / (F.col("n_a") + F.col("n_b") - most)
        candidates = a.join(b, "h").filter((F.col("set_id_a") != F.col("set_id_b")) & (bound >= level - 1e-9) & (bound > F.col("best"))).select("set_id_a", "set_id_b").distinct()
        now = _similarity(candidates, sets).groupBy(F.col("set_id_a").alias("set_id")).agg(F.max("similarity").alias("now"))
        after = stored(open_sets.join(now, "set_id", "left").select("set_id", "n", F.greatest("best", F.coalesce("now", F.lit(0.0))).alias("best")))
        found.append(after.filter(F.col("best") >= level).select("set_id", "best"))
        open_sets = after.filter(F.col("best") < level)
    return reduce(DataFrame.unionByName, found)


def _by_common_lines(ranked: DataFrame, open_sets: DataFrame) -> DataFrame:
    """``set_id, best`` over partners as if only the lines of more than ``COMMON`` sets were shared."""
    common = ranked.filter(F.col("holders") > COMMON)
    held = stored(common.groupBy("set_id", "n").agg(F.array_sort(F.collect_list("h")).alias("lines")))
    two = W.partitionBy("lines").orderBy("n", "set_id")
    smallest = held.withColumn("place", F.row_number().over(two)).filter("place <= 2").groupBy("lines").agg(F.array_sort(F.collect_list(F.struct("n", "set_id"))).alias("two"))
    groups = stored(smallest.select(F.get("two", F.lit(0))["set_id"].alias("group"), "lines", "two"))
    asking = held.join(open_sets.select("set_id"), "set_id", "left_semi").join(groups.select("lines", "group"), "lines").select("set_id", "n", "group")
    asking = stored(asking)
    each = groups.select("group", F.explode("lines").alias("h"))
    # both sides of a line that very many groups hold are cut: rows and columns of a grid
    cuts = each.groupBy("h").agg(F.ceil(F.count("*") / GRID).cast("int").alias("cuts"))
    block = F.pmod(F.xxhash64("group"), F.col("cuts")).cast("int")
    placed = each.join(cuts, "h")
    rows_ = placed.join(asking.select("group").distinct(), "group", "left_semi").select("h", F.col("group").alias("group_a"), block.alias("row"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("column"))
    columns = placed.select("h", F.col("group").alias("group_b"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("row"), block.alias("column"))
    shared = rows_.join(columns, ["h", "row", "column"]).groupBy("group_a", "group_b").agg(F.count("*").alias("k"))
    partner = shared.join(groups.select(F.col("group").alias("group_b"), "two"), "group_b")
    first = partner.filter("group_a <> group_b").groupBy("group_a", "k").agg(F.min(F.get("two", F.lit(0))).alias("one"))
    own = partner.filter("group_a = group_b").select("group_a", "k", F.explode("two").alias("one"))
    offers = first.unionByName(own).select(F.col("group_a").alias("group"), "k", F.col("one.n").alias("n_b"), F.col("one.set_id").alias("set_b"))
    met = asking.join(offers, "group").filter("set_id <> set_b")
    return met.groupBy("set_id").agg(F.max(F.col("k") / (F.col("n") + F.col("n_b") - F.col("k"))).alias("best"))


def review_duplicates(
    texts: DataFrame, threshold: float = NEAR_DUPLICATE, log_id: str = "log_id", text: str = "text", diagnosed: DataFrame | None = None
) -> DataFrame:
    """Status of each text (exact duplicate, near-duplicate or candidate), its largest similarity to any other and,
    from ``diagnosed`` (see :func:`culprit.operators.match.diagnose`), its first and first three rules.

    Near-duplicates are listed as line sets (by their first member) with the number of texts
    they hold, which names the same texts without writing every pair of copies. The similarity is exact
    below the threshold too, so near misses can be ranked; a text that shares no line has 0.
    """
    members, sets, ranked = line_sets(texts, log_id, text)
    pairs = stored(near_sets(sets, ranked, threshold))
    partners = best_partners(sets, ranked, pairs)
    prints = members.groupBy("set_id", "fingerprint").agg(
        F.count("*").alias("copies"), F.min(log_id).alias("first_id"), F.any_value("n_lines").alias("n_lines")
    )
    sizes = prints.groupBy("set_id").agg(
        F.sum("copies").alias("set_size"), F.count("*").alias("n_prints"), F.any_value("n_lines").alias("n_lines")
    )
    both = pairs.unionByName(pairs.select(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b"), "similarity"))
    near = (
        both.join(sizes.select(F.col("set_id").alias("set_b"), "set_size"), "set_b")
        .groupBy(F.col("set_a").alias("set_id"))
        .agg(
            F.array_sort(F.collect_list("set_b")).alias("near_sets"),
            F.sum("set_size").alias("near_count"),
        )
    )
    second = (
        members.join(prints.filter("copies > 1").select("fingerprint", "set_id", "first_id"), ["fingerprint", "set_id"])
        .filter(F.col(log_id) != F.col("first_id"))
        .groupBy("fingerprint", "set_id")
        .agg(F.min(log_id).alias("second_id"))
    )
    groups = (
        prints.drop("n_lines").join(sizes, "set_id").join(near, "set_id", "left").join(partners, "set_id", "left").join(second, ["fingerprint", "set_id"], "left")
    )
    m = members.drop("n_lines").join(groups, ["fingerprint", "set_id"])
    duplicate = F.col("copies") > 1
    own = (F.col("n_prints") > 1) & (F.col("n_lines") > 0)  # texts without lines resemble nothing
    found = own | F.col("near_sets").isNotNull()
    near_list = F.coalesce("near_sets", F.slice(F.array("set_id"), 1, 0))
    near_list = F.when(own, F.array_sort(F.array_append(near_list, F.col("set_id")))).otherwise(near_list)
    reviewed = m.select(
        log_id,
        F.when(duplicate, "duplicate").when(found, "near-duplicate").otherwise("candidate").alias("status"),
        F.when(duplicate, F.when(F.col(log_id) == F.col("first_id"), F.col("second_id")).otherwise(F.col("first_id"))).alias("duplicate_of"),
        F.when(duplicate, 1.0).when(own, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("similarity"),
        F.when(~duplicate, near_list).alias("near_sets"),
        F.when(~duplicate, F.coalesce("near_count", F.lit(0)) + F.when(own, F.col("set_size") - 1).otherwise(0)).alias("near_count"),
    )
    if diagnosed is None:
        return reviewed
    first = F.array_sort(F.collect_list(F.struct("rank", "rule_id")))
    top = diagnosed.filter("live AND rank <= 3").groupBy(log_id).agg(F.transform(first, lambda r: r["rule_id"]).alias("predicted_top3"))
    none = F.array().cast("array<string>")
    return reviewed.join(top, log_id, "left").withColumn("predicted_top3", F.coalesce("predicted_top3", none)).withColumn("predicted_top", F.get("predicted_top3", F.lit(0)))
