"""Corpus jobs: ingest, coverage, gap clusters, comparison of two evaluations, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from culprit.functions import text as tx
from culprit.functions.classify import gap_class
from culprit.functions.storage import stored
from culprit.functions.tables import with_row


def with_content_id(
    records: DataFrame, text: str = "raw", max_bytes: int = 0, emails: bool = True, tokens: bool = True
) -> DataFrame:
    """Cap, redact and identify the text of every record."""
    out = records.withColumn(text, tx.redact(tx.cap_size(F.col(text), max_bytes), emails, tokens))
    return out.withColumn("fixture_id", tx.content_id(F.col(text)))


def dedupe_first(records: DataFrame, key: str = "fixture_id", order: str = "line_num") -> DataFrame:
    """Keep the first record of each content id.

    An aggregate, not a window: every task first reduces its own copies, so a text that is
    repeated in a third of all rows reaches the final task only once per input task.
    """
    columns = [c for c in records.columns if c != key]
    first = records.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("r"))
    return first.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in records.columns])


def ingest(records: DataFrame, max_bytes: int = 0, emails: bool = True, tokens: bool = True, dedupe: bool = True) -> DataFrame:
    """Raw records (``raw``, ``source``, ``line_num``, ...) to corpus fixtures."""
    out = with_content_id(records, "raw", max_bytes, emails, tokens)
    return dedupe_first(out) if dedupe else out


def ingest_counts(records_with_id: DataFrame, key: str = "fixture_id") -> DataFrame:
    """Total, written and skipped records of an ingest with dedupe."""
    per_id = records_with_id.groupBy("source", key).agg(F.count("*").alias("n"))
    # an id may come from several sources; it is written once, for the source that holds it first
    per_key = per_id.groupBy(key).agg(F.sum("n").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("written"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("skipped"),
    )


def coverage(results: DataFrame, by_source: bool = False) -> DataFrame:
    """Matched / unmatched / error counts and the match rate; with sources also one total row."""
    flags = results.select(
        "source", F.col("matched").cast("bigint").alias("m"), (F.col("error") != "").cast("bigint").alias("e")
    )
    grouped = flags.rollup("source") if by_source else flags.groupBy()
    out = grouped.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(1 - F.col("m")), F.lit(0)).alias("unmatched"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("errors"),
    )
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.col("matched") / F.col("total"))
    return out.withColumn("match_rate", rate)


def failure_distribution(results: DataFrame, top: int = 20) -> DataFrame:
    """Share of each failure among the matched logs, most frequent first."""
    counts = results.filter("matched").groupBy("failure_id").agg(F.count("*").alias("n"))
    # the total comes from the counts, one row for each rule, and not from a second look at the corpus
    return (
        counts.withColumn("total", F.sum("n").over(W.partitionBy()))
        .filter("failure_id <> ''")
        .select("failure_id", F.col("n").alias("count"), (F.col("n") / F.col("total") * 100).alias("pct"))
        .orderBy(F.desc("count"), "failure_id")
        .limit(top)
    )


def unmatched_clusters(results: DataFrame, top: int = 20, log_id: str = "log_id") -> DataFrame:
    """Unmatched logs grouped by first-line tag."""
    per_line = results.filter("NOT matched AND first_line_tag <> ''").groupBy("first_line_tag", "first_line_snippet").agg(
        F.count("*").alias("n"), F.min(log_id).alias("first")
    )
    return (
        per_line.groupBy(F.col("first_line_tag").alias("tag"))
        .agg(F.min_by("first_line_snippet", "first").alias("snippet"), F.sum("n").alias("count"))
        .orderBy(F.desc("count"), "tag")
        .limit(top)
    )


def number_by_count(clusters: DataFrame, count: str = "count", key: str = "signature") -> DataFrame:
    """Add ``number``: position by count descending, key ascending, without a global sort.

    Positions are built from the sizes of (count, first three key characters) buckets, so
    the only single-task step sorts those sizes, and each bucket is numbered on its own.
    """
    bucketed = clusters.withColumn("_bucket", F.substring(key, 1, 3))
    sizes = bucketed.groupBy(count, "_bucket").agg(F.count("*").alias("_size"))
    before = W.orderBy(F.desc(count), "_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    within = W.partitionBy(count, "_bucket").orderBy(key)
    return (
        bucketed.join(offsets, [count, "_bucket"])
        .withColumn("number", F.col("_offset") + F.row_number().over(within))
        .drop("_bucket", "_offset")
    )


def gap_clusters(results: DataFrame, max_samples: int = 5, log_id: str = "log_id") -> DataFrame:
    """Unmatched logs clustered by their masked first line, with samples and a suspected class."""
    rows = stored(
        results.filter("NOT matched AND error = ''")
        .select(F.col(log_id), tx.cluster_line(F.col("first_line_snippet")).alias("line"))
        .withColumn("signature", tx.cluster_signature(F.col("line")))
    )
    # lines as keys keep the large step a hash aggregate; equal signatures have equal lines
    per_line = rows.groupBy("signature", "line").agg(F.count("*").alias("n"), F.min(log_id).alias("first"))
    counts = per_line.groupBy("signature").agg(
        F.sum("n").alias("count"), F.min_by("line", "first").alias("representative_line")
    )
    # the filter on row_number lets Spark keep only the first ids of each group before the shuffle
    order = W.partitionBy("signature").orderBy(log_id)
    samples = (
        rows.select("signature", log_id)
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= max_samples)
        .groupBy("signature")
        .agg(F.array_sort(F.collect_list(log_id)).alias("sample_ids"))
    )
    cls, conf = gap_class(F.col("representative_line"))
    out = counts.join(samples, "signature").withColumn("suspected_class", cls).withColumn("confidence", conf)
    return number_by_count(out).withColumn("cluster_id", F.format_string("cluster-%03d", F.col("number")))


def label_outcome(matched: Column, failure_id: Column, expected: Column) -> Column:
    """TP / FP / FN of a labelled result; ``unlabelled`` without an expectation."""
    has = F.coalesce(expected, F.lit("")) != ""
    return (
        F.when(~has, "unlabelled")
        .when(matched & (failure_id == expected), "TP")
        .when(matched, "FP")
        .otherwise("FN")
    )


def outcome_rates(labelled: DataFrame) -> DataFrame:
    """Counts per outcome with precision and recall over the labelled rows."""
    n = {o: F.sum((F.col("outcome") == o).cast("bigint")) for o in ("TP", "FP", "FN", "unlabelled")}
    out = labelled.agg(*[F.coalesce(e, F.lit(0)).alias(o.lower()) for o, e in n.items()])
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn(
        "recall", F.try_divide("tp", F.col("tp") + F.col("fn"))
    )


COMPARED_FIELDS = ["matched", "failure_id", "confidence", "error", "evidence"]


def determinism_diff(baseline: DataFrame, compare: DataFrame, log_id: str = "log_id") -> DataFrame:
    """One row per differing field of two result sets; missing rows are reported as such."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(log_id, F.struct(*COMPARED_FIELDS).alias(p))

    both = side(baseline, "b").join(side(compare, "c"), log_id, "full_outer")

    def text(side_: str, f: str) -> Column:
        c = F.col(f"{side_}.{f}")
        return F.array_join(c, "\n") if f == "evidence" else c.cast("string")

    present = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"b.{f}").eqNullSafe(F.col(f"c.{f}")),
                    F.struct(F.lit(f).alias("field"), text("b", f).alias("baseline"), text("c", f).alias("compare")),
                )
                for f in COMPARED_FIELDS
            ]
        )
    )

    def missing(b: str, c: str) -> Column:
        return F.array(
            F.struct(F.lit("fixture_id").alias("field"), F.lit(b).alias("baseline"), F.lit(c).alias("compare"))
        )

    diffs = (
        F.when(F.col("c").isNull(), missing("present", "missing"))
        .when(F.col("b").isNull(), missing("missing", "present"))
        .otherwise(present)
    )
    return both.select(log_id, F.explode(diffs).alias("d")).select(log_id, "d.field", "d.baseline", "d.compare")


def match_rate(results: DataFrame, rate: str, total: str) -> DataFrame:
    return results.agg(
        F.coalesce(F.avg(F.col("matched").cast("double")), F.lit(0.0)).alias(rate), F.count("*").alias(total)
    )


def match_rate_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: both match rates, their difference and both sizes."""
    one = match_rate(baseline, "baseline_match_rate", "baseline_total")
    two = match_rate(current, "current_match_rate", "current_total")
    return with_row(one, two).withColumn("delta", F.col("current_match_rate") - F.col("baseline_match_rate"))


def rule_deltas(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Rules that lost or gained matches."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.filter("matched AND failure_id <> ''").groupBy("failure_id").agg(F.count("*").alias(name))

    both = counts(baseline, "baseline_count").join(counts(current, "current_count"), "failure_id", "full_outer")
    both = both.fillna(0, ["baseline_count", "current_count"])
    both = both.withColumn("delta", F.col("current_count") - F.col("baseline_count")).filter("delta <> 0")
    return both.withColumn("change", F.when(F.col("delta") < 0, "lost").otherwise("gained"))


def new_unmatched_tags(baseline: DataFrame, current: DataFrame) -> DataFrame:
    def tags(df: DataFrame) -> DataFrame:
        return df.filter("NOT matched AND first_line_tag <> ''").select(F.col("first_line_tag").alias("tag")).distinct()

    return tags(current).join(tags(baseline), "tag", "left_anti")


def quality_gate(
    baseline: DataFrame,
    current: DataFrame,
    min_match_rate: float = 0.0,
    fail_on_drop: bool = False,
    fail_on_nondeterminism: bool = False,
    log_id: str = "log_id",
) -> DataFrame:
    """One row: pass or fail of a comparison, with the reasons."""
    baseline, current = stored(baseline), stored(current)
    row = match_rate_delta(baseline, current)
    if fail_on_nondeterminism:
        changed = determinism_diff(baseline, current, log_id).filter("field <> 'fixture_id'")
        row = with_row(row, changed.agg(F.countDistinct(log_id).alias("n_unstable")))
    else:
        row = row.withColumn("n_unstable", F.lit(0).cast("bigint"))
    b, c = F.col("baseline_match_rate"), F.col("current_match_rate")
    reasons = F.array_compact(
        F.array(
            F.when(
                (F.lit(min_match_rate) > 0) & (c < min_match_rate),
                F.format_string("match rate %.4f is below minimum %.4f", c, F.lit(float(min_match_rate))),
            ),
            F.when(
                F.lit(fail_on_drop) & (F.col("delta") < 0),
                F.format_string("coverage dropped by %.4f (%.4f → %.4f)", -F.col("delta"), b, c),
            ),
            F.when(
                F.lit(fail_on_nondeterminism) & (F.col("n_unstable") > 0),
                F.format_string("%d non-deterministic fixture(s) detected", F.col("n_unstable")),
            ),
        )
    )
    return row.withColumn("fail_reasons", reasons).withColumn("pass", F.size("fail_reasons") == 0)


def tree_hash(ids: DataFrame, key: str = "fixture_id") -> DataFrame:
    """Order-free corpus hash for any size: a hash for each id prefix of 6 characters, of those for each prefix of 3,
    and of those. Not equal to :func:`corpus_hash`; the two have different names on purpose."""
    pairs_hash = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n"), 256)
    leaf = ids.groupBy(F.substring(key, 1, 6).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256).alias("h"))
    branch = leaf.groupBy(F.substring("p", 1, 3).alias("q")).agg(pairs_hash.alias("h")).withColumnRenamed("q", "p")
    return branch.agg(pairs_hash.alias("tree_hash"))


def corpus_hash(ids: DataFrame, key: str = "fixture_id") -> DataFrame:
    """Hash of all sorted ids as one text, which has to fit one row; :func:`tree_hash` is the form for any size."""
    joined = F.concat(F.array_join(F.array_sort(F.collect_list(key)), "\n"), F.lit("\n"))
    return ids.agg(F.sha2(joined, 256).alias("corpus_hash"))


def manifest(fixtures: DataFrame, key: str = "fixture_id") -> DataFrame:
    """Corpus size, sorted sources and tree hash."""
    hashes = tree_hash(fixtures, key)
    sources = fixtures.groupBy("source").agg(F.count("*").alias("n"))
    summary = sources.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("fixture_count"), F.array_sort(F.collect_list("source")).alias("sources")
    )
    return with_row(summary, hashes)


def coverage_summary(results: DataFrame, top: int = 5, log_id: str = "log_id") -> DataFrame:
    """One row: size, rate, the most frequent failures and the largest gaps (errors left out)."""
    results = stored(results)
    covered = failure_distribution(results, top).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "failure_id"))), lambda x: x["failure_id"]
        ).alias("top_covered")
    )
    gaps = unmatched_clusters(results.filter("error = ''"), top, log_id).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "tag", "snippet"))),
            lambda x: F.when(x["snippet"] == "", x["tag"]).otherwise(x["snippet"]),
        ).alias("top_gaps")
    )
    return with_row(with_row(coverage(results), covered), gaps)
