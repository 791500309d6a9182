"""Runs that looked successful but were not: log-level detectors given as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from culprit.functions import text as tx


@dataclass(frozen=True)
class Detector:
    """Fires when every word group hits somewhere in the log.

    ``evidence`` names the groups whose lines are shown; ``line_level`` asks for a line with
    a first-group word and no second-group word instead of any first-group hit.
    """

    name: str
    severity: str
    confidence: str
    groups: list[list[str]]
    evidence: list[int]
    limit: int = 5
    distinct: bool = True
    line_level: bool = False
    explanation: str = field(default="", compare=False)


# --- fixed values: detectors and their words, in ranking order ------------------------------
DETECTORS = [
    Detector(
        "ignored-exit-code", "high", "high",
        [["|| true", "set +e", "failed but continuing", "ignoring error", "exit 0"]], [0], limit=3, distinct=False,
        explanation="a command's failure was switched off on purpose",
    ),
    Detector(
        "continue-on-error", "high", "high",
        [["continue-on-error: true", "continueOnError: true", "allow_failure: true"]], [0], limit=3,
        explanation="a step may fail without failing the job",
    ),
    Detector(
        "zero-tests-executed", "high", "high",
        [
            ["npm test", "yarn test", "pnpm test", "go test", "pytest", "jest", "mocha", "rspec", "cargo test",
             "mvn test", "gradle test", "make test", "bundle exec rspec"],
            ["0 tests", "0 passed", "0 examples", "no tests found", "no test files found", "collected 0 items",
             "no test suites found", "tests: 0"],
        ],
        [0, 1], explanation="a test command ran but no test did",
    ),
    Detector(
        "artifact-missing", "high", "high",
        [
            ["upload artifact", "upload-artifact", "upload report", "publish artifact", "actions/upload-artifact"],
            ["no files found", "artifact not found", "skipping upload", "no matching files", "path does not exist",
             "0 files uploaded", "no artifacts"],
        ],
        [0, 1], explanation="an upload step found nothing to upload",
    ),
    Detector(
        "cache-miss-non-fatal", "medium", "medium",
        [
            ["restore cache", "save cache", "actions/cache", "cache restore", "cache hit"],
            ["cache not found", "failed to restore cache", "failed to save cache", "cache miss", "no cache found"],
        ],
        [0, 1], explanation="a cache step failed and the job went on",
    ),
    Detector(
        "skipped-critical-step", "high", "medium",
        [
            ["skipping step due to condition", "condition evaluated to false", "step was skipped",
             "##[warning]step skipped", "##[debug]step skipped"],
            ["test", "deploy", "build", "security", "coverage", "report", "publish", "scan"],
        ],
        [0], explanation="a step was skipped in a job that tests, builds or ships",
    ),
    Detector(
        "empty-deployment-target", "high", "medium",
        [
            ["kubectl apply", "helm upgrade", "helm install", "terraform apply", "serverless deploy"],
            ["nothing to deploy", "no files to deploy", "no manifests found", "no objects passed to apply",
             "0 artifacts to publish", "no packages found to publish", "no deployable artifacts"],
        ],
        [0, 1], explanation="a deploy step had nothing to deploy",
    ),
    Detector(
        "empty-quality-check", "medium", "medium",
        [
            ["eslint", "golangci-lint", "ruff", "flake8", "shellcheck", "semgrep", "trivy", "snyk", "bandit", "codeql",
             "coverage", "lint", "scan", "security scan"],
            ["no files to lint", "0 files checked", "0 files scanned", "0 packages scanned", "nothing to scan",
             "no source files found", "0 files analyzed", "coverage report not generated", "no files were analyzed"],
        ],
        [0, 1], line_level=True, explanation="a check ran over no files",
    ),
]
RANKS = {"high": 3, "medium": 2, "low": 1}
# --- end of fixed values ------------------------------------------------------------------------


def _finding(d: Detector, order: int, norm: Column, lines: Column) -> Column:
    """Struct of the finding, NULL when the detector stays quiet. ``lines`` are canonical lines."""
    lowered = [[w.lower() for w in g] for g in d.groups]
    shown = [w for i in d.evidence for w in lowered[i]]
    fired = tx.contains_any(norm, lowered[0])
    for g in lowered[1:]:
        fired = fired & tx.contains_any(norm, g)
    if d.line_level:
        plain = F.exists(
            lines, lambda l: tx.contains_any(F.lower(l), lowered[0]) & ~tx.contains_any(F.lower(l), lowered[1])
        )
        fired = fired & plain
    evidence = F.filter(lines, lambda l: tx.contains_any(F.lower(l), shown))
    if d.distinct:
        evidence = F.array_distinct(evidence)
    return F.when(
        fired,
        F.struct(
            F.lit(d.name).alias("detector"),
            F.lit(d.severity).alias("severity"),
            F.lit(d.confidence).alias("confidence"),
            F.lit(order).alias("detector_order"),
            F.lit(d.explanation).alias("explanation"),
            F.slice(evidence, 1, d.limit).alias("evidence"),
        ),
    )


def silent_findings(
    logs: DataFrame, detectors: list[Detector] | None = None, log_id: str = "log_id", text: str = "text"
) -> DataFrame:
    """One row per (log, detector that fires), ranked within the log.

    At most one row per detector leaves a log, so the ranking window stays small.
    """
    found = logs.select(log_id, tx.canonicalize_log(F.col(text)).alias("c")).select(
        log_id, F.lower("c").alias("n"), F.split("c", "\n").alias("ls")
    )
    structs = [_finding(d, i, F.col("n"), F.col("ls")) for i, d in enumerate(detectors or DETECTORS)]
    rows = found.select(log_id, F.explode(F.array_compact(F.array(*structs))).alias("f")).select(log_id, "f.*")
    rank_of = F.create_map(*[F.lit(x) for k, v in RANKS.items() for x in (k, v)])
    order = W.partitionBy(log_id).orderBy(
        F.desc(rank_of[F.col("severity")]), F.desc(rank_of[F.col("confidence")]), F.asc("detector_order")
    )
    return rows.withColumn("rank", F.row_number().over(order)).drop("detector_order")


def promote(results: DataFrame, findings: DataFrame, fail_on_silent: bool = False, log_id: str = "log_id") -> DataFrame:
    """Overall status per log: the matched rule, else the first silent finding."""
    primary = findings.filter("rank = 1").select(log_id, F.col("detector").alias("silent_id"))
    both = results.join(primary, log_id, "left")
    silent = F.col("silent_id").isNotNull()
    return both.select(
        log_id,
        F.when(F.col("matched"), F.col("failure_id")).otherwise(F.coalesce("silent_id", F.lit(""))).alias("primary_id"),
        F.when(F.col("matched"), "explicit").when(silent, "silent").otherwise("none").alias("kind"),
        F.when(F.col("matched") | silent, "failure").otherwise("unknown").alias("status"),
        (F.lit(fail_on_silent) & silent & ~F.col("matched")).alias("gate_failed"),
    )
