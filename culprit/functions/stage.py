"""Log context: build stage, step header and shell command."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from culprit.functions import text as tx
from culprit.functions.regex import jvm

# --- fixed values: stage words, most specific stage first --------------------------------
STAGE_WORDS = {
    "deploy": [
        "kubectl", "helm", "terraform", "docker push", "docker run",
        "deploy", "release", "publish", "helm upgrade", "kubectl apply",
    ],
    "test": [
        "go test", "pytest", "jest", "mocha", "rspec", "vitest",
        "phpunit", "cargo test", "npm test", "yarn test", "test",
    ],
    "build": [
        "go build", "npm run build", "yarn build", "cargo build",
        "mvn package", "gradle build", "make", "javac", "compile", "build",
    ],
}
STEP = r"(?i)(?:##\[group\]|::group::|step\s+\d+[:/]|##\s*step[:\s])\s*(.+)"
COMMAND = r"^(?:\$\s+|>\s+|RUN\s+|\+\s+)(.+)"
# --- end of fixed values -----------------------------------------------------------------


def line_stage(line: Column) -> Column:
    """Stage of one normalised line, NULL when no word hits."""
    out = None
    for stage, words in STAGE_WORDS.items():
        hit = tx.contains_any(line, words)
        out = F.when(hit, F.lit(stage)) if out is None else out.when(hit, F.lit(stage))
    return out


def log_stage(norm: Column) -> Column:
    """Stage of the first line of a normalised log that names one, else ''."""
    every = [w for words in STAGE_WORDS.values() for w in words]
    named = F.filter(F.transform(F.split(norm, "\n"), line_stage), lambda s: s.isNotNull())
    return F.when(tx.contains_any(norm, every), F.get(named, 0)).otherwise(F.lit(""))


def log_step(canonical: Column) -> Column:
    """First step header of a canonical log, else ''."""
    return tx.trim_space(F.regexp_extract(canonical, jvm(STEP.replace(r"\s", " ")), 1))


def log_command(canonical: Column) -> Column:
    """First shell command of a canonical log, else ''."""
    return tx.trim_space(F.regexp_extract(canonical, "(?m)" + jvm(COMMAND.replace(r"\s", " ")), 1))
