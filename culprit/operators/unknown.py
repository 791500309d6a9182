"""What to say about logs no rule explains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from culprit.functions import classify as cl
from culprit.functions import text as tx
from culprit.functions.stage import log_stage

# --- fixed values: list sizes and the confidence ladder of clusters --------------------------
MAX_PATTERNS = 8
MAX_DOMINANT = 5
FIRST_CONFIDENCE, CONFIDENCE_STEP, MIN_CONFIDENCE = 0.45, 0.08, 0.2
# --- end of fixed values ------------------------------------------------------------------------


def candidate_patterns(
    logs: DataFrame, log_id: str = "log_id", text: str = "text", top: int = MAX_PATTERNS
) -> DataFrame:
    """Best lines of each log as pattern candidates: highest weight first, then by text.

    Ranking happens inside the row, so no shuffle is needed; a log is one row already.
    """
    base = logs.select(log_id, tx.canonicalize_log(F.col(text)).alias("c"))
    # lower case once a line: a lambda computes each expression as often as it is written. An empty log is one empty line, and
    # dropped as such: a filter on its text would clean the text a second time
    both = F.transform(F.split("c", "\n"), lambda l: F.struct(F.lower(l).alias("low"), l.alias("line")))
    base = base.select(log_id, log_stage(F.lower("c")).alias("stage"), both.alias("ls"))
    lines = F.filter("ls", lambda x: (x["low"] != "") & ~cl.is_noise_line(x["low"]))
    by_text = F.array_sort(F.transform(lines, lambda x, i: F.struct(
        x["low"].alias("low"), i.alias("i"), (-cl.candidate_score(x["line"], x["low"])).alias("neg"), x["line"].alias("line")
    )))
    rows = base.select(log_id, "stage", by_text.alias("xs"))
    # first spelling of a line wins over later ones that differ in case only
    first = F.filter("xs", lambda x, i: (i == 0) | (F.get(F.col("xs"), i - 1)["low"] != x["low"]))
    best = F.slice(F.array_sort(F.transform(first, lambda x: F.struct(x["neg"].alias("neg"), x["line"].alias("line")))), 1, top)
    ranked = rows.select(log_id, "stage", F.posexplode(best).alias("at", "x"))
    return ranked.select(log_id, (F.col("at") + 1).alias("rank"), F.col("x.line").alias("pattern"), (-F.col("x.neg")).alias("score"), "stage")


def dominant_signals(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("rank") <= MAX_DOMINANT)


def candidate_clusters(candidates: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Dominant signals of a log grouped by category; confidence falls with the category's position."""
    signals = dominant_signals(candidates).withColumn("category", cl.unknown_category(F.col("pattern"), F.col("stage")))
    clusters = signals.groupBy(log_id, "category").agg(
        F.array_sort(F.collect_list(F.struct("rank", "pattern"))).alias("s")
    )
    position = F.row_number().over(W.partitionBy(log_id).orderBy("category")) - 1
    return clusters.withColumn("_i", position).select(
        log_id,
        "category",
        F.greatest(F.lit(FIRST_CONFIDENCE) - F.col("_i") * CONFIDENCE_STEP, F.lit(MIN_CONFIDENCE)).alias("confidence"),
        F.transform("s", lambda x: x["pattern"]).alias("signals"),
    )


def rule_seeds(candidates: DataFrame, log_id: str = "log_id") -> DataFrame:
    """A first draft of a rule for each unexplained log."""
    signals = dominant_signals(candidates)
    per_log = signals.groupBy(log_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", "pattern"))).alias("s"), F.any_value("stage").alias("stage")
    )
    patterns = F.transform("s", lambda x: x["pattern"])
    category = cl.unknown_category(F.get(patterns, 0), F.col("stage"))
    files = F.create_map(
        *[x for k, v in cl.UNKNOWN_LIKELY_FILES.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))]
    )
    out = per_log.select(log_id, patterns.alias("match_any"), category.alias("category"))
    return out.select(
        log_id,
        "category",
        F.format_string("Observed %s failure signature", F.replace("category", F.lit("-"), F.lit(" "))).alias("title"),
        "match_any",
        files[F.col("category")].alias("likely_files"),
    )
