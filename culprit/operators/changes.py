"""What changed between a run and its baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from culprit.functions import classify as cl
from culprit.functions import paths as pt
from culprit.functions import text as tx
from culprit.functions.text import round2
from culprit.operators.ordered import last_before, time_bucket

# --- fixed values: increments of the cause buckets and weights of the change signals -------------
HOTFIX_STEP, REVERT_STEP, DRIFT_STEP, TEST_STEP = 0.25, 0.15, 0.2, 0.9
SIGNAL_WEIGHTS = {
    "delta.dependency.changed": 1.2, "delta.error.new": 1.0, "delta.scope.changed": 1.0, "delta.test.failure.introduced": 1.2,
}
# --- end of fixed values ---------------------------------------------------------------------------


def _trimmed_lines(text: Column) -> Column:
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), tx.trim_space)
    return F.filter(lines, lambda l: l != "")


def failing_tests(text: Column) -> Column:
    """Sorted distinct failing test names of a log."""
    names = F.array_compact(F.transform(_trimmed_lines(text), cl.failing_test))
    return F.array_sort(F.array_distinct(names))


def salient_errors(text: Column) -> Column:
    """Sorted distinct error lines of a log."""
    lines = F.filter(_trimmed_lines(text), cl.is_salient)
    return F.array_sort(F.array_distinct(F.transform(lines, tx.collapse_space)))


def log_delta(pairs: DataFrame, current: str = "current_log", baseline: str = "baseline_log") -> DataFrame:
    """Newly failing tests and added errors of each run against its baseline log."""
    base = F.coalesce(baseline, F.lit(""))
    return pairs.withColumns(
        {
            "tests_newly_failing": F.array_except(failing_tests(F.col(current)), failing_tests(base)),
            "errors_added": F.array_except(salient_errors(F.col(current)), salient_errors(base)),
        }
    )


def successive_deltas(logs: DataFrame, by: Column, log_id: str = "log_id", text: str = "text") -> DataFrame:
    """Newly failing tests and added errors of each log against the one before it (by id) of the same ``by``.

    What a log fails with is taken out of its text first, so the order of a long history carries short lists and no texts."""
    found = logs.select(log_id, by.alias("_by"), failing_tests(F.col(text)).alias("tests"), salient_errors(F.col(text)).alias("errors"))
    none = F.array().cast("array<string>")
    before = lambda c: F.coalesce(F.lag(c).over(W.partitionBy("_by").orderBy(log_id)), none)
    linked = found.withColumns({"tests_before": before("tests"), "errors_before": before("errors")})
    return linked.select(log_id, F.array_except("tests", "tests_before").alias("tests_newly_failing"), F.array_except("errors", "errors_before").alias("errors_added"))


def pick_baseline(runs: DataFrame, keys: Sequence[str] = ("repo", "workflow", "branch"), bucket: str = "day") -> DataFrame:
    """For every run the newest earlier successful run with another commit.

    Runs need ``run_id``, ``sha``, ``status``, ``ts``. The newest success may carry the same
    commit; each success therefore remembers the last success before its streak of equal
    commits, and the answer is one of these two. Both look-backs are bucketed by time, so a
    workflow with very many runs is split over tasks. ``ts < current.ts`` is part of the rule
    here because a history table also holds later runs.
    """
    keys = list(keys)
    order = ["ts", "run_id"]
    # commit names and states are compared without case and outer white space
    runs = runs.withColumn("_sha", F.lower(F.trim("sha")))
    me = F.struct("run_id", "sha", "ts", "_sha")
    good = runs.filter(F.lower(F.trim("status")) == "success").select(*keys, *order, "sha", "_sha")
    b = time_bucket(F.col("ts"), bucket)
    linked = last_before(good, keys, order, b, me, "prev")
    turn = F.when(~F.col("prev._sha").eqNullSafe(F.col("_sha")), F.struct("run_id", "prev"))
    # the latest change of commit at or before a success starts its streak
    streak = last_before(linked, keys, order, b, turn, "turn_before")
    start = F.coalesce(turn, F.col("turn_before"))
    remembered = streak.select(*keys, *order, "sha", F.struct("run_id", "sha", "ts", "_sha", start["prev"].alias("other")).alias("mark"))
    rows = runs.join(remembered.select(*keys, "run_id", "mark"), [*keys, "run_id"], "left")
    seen = last_before(rows, keys, order, b, F.col("mark"), "last_good")
    other = F.col("last_good.other")
    chosen = F.when(
        F.col("last_good._sha") != F.col("_sha"),
        F.struct(F.col("last_good.run_id").alias("run_id"), F.col("last_good.sha").alias("sha"), F.col("last_good.ts").alias("ts")),
    ).otherwise(F.when(other.isNotNull(), F.struct(other["run_id"].alias("run_id"), other["sha"].alias("sha"), other["ts"].alias("ts"))))
    return seen.withColumn("baseline", chosen).drop("mark", "last_good", "_sha")


def env_diff(baseline: dict[str, Column], current: dict[str, Column]) -> Column:
    """Map of the settings that differ, each with its baseline and current value."""
    entries = []
    for name, b in baseline.items():
        old, new = F.trim(F.coalesce(b.cast("string"), F.lit(""))), F.trim(F.coalesce(current[name].cast("string"), F.lit("")))
        entries.append(
            F.when(old != new, F.struct(F.lit(name).alias("key"), F.struct(old.alias("baseline"), new.alias("current")).alias("value")))
        )
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def cause_buckets(files: DataFrame, signals: DataFrame | None = None, key: str = "change_id") -> DataFrame:
    """Ranked causes per change.

    ``files(change_id, file)`` are changed or recent files (counted once each); ``signals(change_id,
    kind, text)`` hold ``hotfix`` and ``drift`` texts and ``test`` rows for newly failing tests.
    """
    cls = pt.changed_file_class(F.col("file"))
    rows = files.select(key, "file").distinct().withColumn("kind", cls).filter("kind IS NOT NULL").select(
        key, "kind", pt.changed_file_weight(F.col("kind")).alias("w"), pt.changed_file_reason(F.col("kind")).alias("reason")
    )
    if signals is not None:
        low = F.lower("text")
        hotfix = signals.filter("kind = 'hotfix'")
        rows = (
            rows.unionByName(hotfix.select(key, F.lit("environment").alias("kind"), F.lit(HOTFIX_STEP).alias("w"), F.lit("hotfix signal present").alias("reason")))
            .unionByName(
                hotfix.filter(F.contains(low, F.lit("revert"))).select(
                    key, F.lit("environment").alias("kind"), F.lit(REVERT_STEP).alias("w"), F.lit("revert signal present").alias("reason")
                )
            )
            .unionByName(
                signals.filter("kind = 'drift'").select(key, F.lit("environment").alias("kind"), F.lit(DRIFT_STEP).alias("w"), tx.trim_space(low).alias("reason"))
            )
            .unionByName(
                signals.filter("kind = 'test'").select(key).distinct().select(
                    key, F.lit("test_data").alias("kind"), F.lit(TEST_STEP).alias("w"), F.lit("new failing tests detected").alias("reason")
                )
            )
        )
    # weights have two decimals: summing whole hundredths keeps the result free of addition order
    cents = F.sum(F.round(F.col("w") * 100).cast("bigint"))
    causes = rows.groupBy(key, "kind").agg(
        (cents / 100).alias("score"), F.array_sort(F.collect_set(F.nullif("reason", F.lit("")))).alias("reasons")
    )
    order = W.partitionBy(key).orderBy(F.desc("score"), "kind")
    return causes.filter("score > 0").withColumn("rank", F.row_number().over(order))


def change_signals(changes: DataFrame, key: str = "change_id") -> DataFrame:
    """Signals of a change row with ``files``, ``tests_newly_failing`` and ``errors_added`` arrays."""
    def clean(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")))

    d = changes.select(key, clean("files").alias("f"), clean("tests_newly_failing").alias("t"), F.coalesce("errors_added", F.array().cast("array<string>")).alias("e"))

    def signal(name: str, when: Column, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("signal"), detail.alias("detail"), F.lit(SIGNAL_WEIGHTS[name]).alias("weight")))

    dependency = F.exists("f", lambda p: F.coalesce(pt.changed_file_class(p) == "dependency", F.lit(False)))
    signals = F.array_compact(
        F.array(
            signal("delta.dependency.changed", dependency, F.lit("dependency-related files changed")),
            signal("delta.error.new", F.size("e") > 0, F.get("e", 0)),
            signal("delta.scope.changed", F.size("f") > 0, F.array_join("f", ", ")),
            signal("delta.test.failure.introduced", F.size("t") > 0, F.array_join("t", ", ")),
        )
    )
    return d.select(key, F.explode(signals).alias("s")).select(key, "s.*")


MERGED_LISTS = ["changed_files", "recent_files", "hotspot_dirs", "hotfix_signals", "drift_signals", "topology_signals",
                "tests_newly_failing", "errors_added"]


def merge_contexts(first: DataFrame, second: DataFrame, key: str = "change_id", lists: Sequence[str] = MERGED_LISTS) -> DataFrame:
    """Union of two change contexts: sets united, first non-empty scalar, later settings win."""
    both = first.alias("a").join(second.alias("b"), key, "full_outer")
    none = F.array().cast("array<string>")
    out = [F.col(key)]
    for name in ("root", "provider"):
        out.append(F.coalesce(F.nullif(f"a.{name}", F.lit("")), F.nullif(f"b.{name}", F.lit("")), F.lit("")).alias(name))
    for name in lists:
        united = F.concat(F.coalesce(f"a.{name}", none), F.coalesce(f"b.{name}", none))
        # a context on its own keeps its order; two are united and sorted
        merged = F.array_sort(F.array_distinct(F.filter(F.transform(united, F.trim), lambda x: x != "")))
        alone = F.when(F.col("b.root").isNull(), F.col(f"a.{name}")).when(F.col("a.root").isNull(), F.col(f"b.{name}"))
        out.append(F.coalesce(alone, merged).alias(name))
    env_a, env_b = F.col("a.env_diff"), F.col("b.env_diff")
    kept = F.map_filter(env_a, lambda k, _: ~F.coalesce(F.map_contains_key(env_b, k), F.lit(False)))
    out.append(
        F.when(env_a.isNull(), env_b).when(env_b.isNull(), env_a).otherwise(F.map_concat(kept, env_b)).alias("env_diff")
    )
    return both.select(*out)


def baseline_job(jobs: DataFrame, current: DataFrame) -> DataFrame:
    """Successful job of the baseline run with the name of the current job, else of its stage.

    ``jobs(run_id, job_id, name, stage, status)``; ``current(run_id, name, stage)`` names the
    baseline run and the current job. The highest job id wins.
    """
    def norm(c: str) -> Column:
        return F.lower(F.trim(F.coalesce(c, F.lit(""))))

    cur = current.select("run_id", norm("name").alias("want_name"), norm("stage").alias("want_stage"))
    good = jobs.filter(norm("status") == "success").join(cur, "run_id")
    by_name = norm("name") == F.col("want_name")
    by_stage = (F.col("want_stage") != "") & (norm("stage") == F.col("want_stage"))
    fit = good.withColumn("by_name", by_name).filter(by_name | by_stage)
    best = fit.groupBy("run_id", "want_name", "want_stage").agg(
        F.max_by(F.struct("job_id", "name", "stage"), F.struct(F.col("by_name").cast("int").alias("n"), "job_id")).alias("j")
    )
    return best.select("run_id", "want_name", "want_stage", "j.job_id", "j.name", "j.stage")


def scoped_changes(changes: DataFrame, prefix: str) -> DataFrame:
    """Changes below a directory, with paths made relative to it."""
    prefix = prefix.strip()
    if prefix in ("", "."):
        return changes
    prefix = prefix.strip("/")
    f = F.trim("file")
    return changes.filter((f == prefix) | F.startswith(f, F.lit(prefix + "/"))).withColumn(
        "file", F.when(f == prefix, F.lit(".")).otherwise(F.substring(f, F.lit(len(prefix) + 2), F.length(f)))
    )
