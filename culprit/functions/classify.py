"""Keyword classifiers of lines, subjects and signals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from culprit.functions import text as tx
from culprit.functions.regex import jvm

# --- fixed values: failure classes of unmatched lines: (class, confidence, two patterns) --
GAP_CLASSES = [
    (
        "auth-failure", 0.85,
        r"\b(?:unauthorized|unauthenticated|forbidden|401|403)\b",
        r"\b(?:auth(?:entication|orization)?|token|credential|permission|access.denied)\b",
    ),
    (
        "missing-executable", 0.85,
        r"\b(?:no such file|not found|exec format error|enoent|eacces)\b",
        r"\b(?:bin|exec|node|python|ruby|java|dotnet|runner)\b",
    ),
    (
        "dependency-resolution", 0.80,
        r"\b(?:cannot find|failed to resolve|module not found|import error|unable to load|no matching)\b",
        r"\b(?:package|module|dependency|require|npm|pip|gradle|maven|cargo)\b",
    ),
    (
        "network-timeout", 0.80,
        r"\b(?:timeout|timed.out|connection refused|connection reset|dns|unreachable|eof)\b",
        r"\b(?:http|tcp|socket|connect|dial|request|response)\b",
    ),
    (
        "container-runtime", 0.80,
        r"\b(?:docker|containerd|podman|oci|container|image|pull|push|registry)\b",
        r"\b(?:runtime|daemon|manifest|layer|overlay|cgroup)\b",
    ),
    (
        "test-assertion", 0.75,
        r"\b(?:assert|expect|should|must|fail(?:ed|ure)|panic)\b",
        r"\b(?:test|spec|suite|case|scenario|given|when|then)\b",
    ),
]
# --- fixed values: words that make a line worth a pattern (+3 each), prefixes of noise -----
ERROR_WORDS = [
    "error", "failed", "failure", "denied", "unauthorized", "forbidden", "not found", "missing", "cannot", "could not",
    "couldn't", "unable to", "invalid", "rejected", "timeout", "timed out", "exit code", "exit status",
    "permission denied", "no such", "panic", "fatal", "exception", "connection refused", "connection reset",
    "access denied", "broken pipe",
]
NOISE_PREFIXES = [
    "##", "---", "===", "+++", "running ", "building ", "downloading ", "installing ", "step ", "steps ", "task ",
    "note:", "info:", "debug:",
]
# --- fixed values: category of an unexplained signal, tested in this order -----------------
UNKNOWN_CATEGORIES = {
    "deploy": ["docker", "image pull", "kubectl", "terraform", "deployment", "helm"],
    "network": ["timeout", "dial tcp", "lookup", "certificate", "x509", "refused", "host"],
    "runtime": ["command not found", "no such file or directory", "version", "runtime", "node", "python"],
    "test": ["fixture", "assert", "expected", "snapshot", "panic", "test"],
    "auth": ["permission", "auth", "token", "login", "unauthorized", "forbidden"],
    "ci": ["workflow", "yaml", "runner", "artifact", "pipeline", "job"],
}
UNKNOWN_LIKELY_FILES = {
    "auth": [".github/workflows/*.yml", ".gitlab-ci.yml", ".npmrc", ".docker/config.json"],
    "ci": [".github/workflows/*.yml", ".gitlab-ci.yml", ".circleci/config.yml", "Makefile"],
    "deploy": ["Dockerfile", ".github/workflows/*.yml", "deploy/", "infra/"],
    "network": [".github/workflows/*.yml", ".gitlab-ci.yml", "Dockerfile", "infra/"],
    "runtime": ["Dockerfile", ".tool-versions", ".nvmrc", "package.json", "pyproject.toml"],
    "test": ["tests/", "testdata/", "fixtures/", "package.json", "pytest.ini"],
    "build": ["Makefile", "Dockerfile", ".github/workflows/*.yml", ".gitlab-ci.yml"],
}
# --- fixed values: errors worth comparing between runs, commit subjects --------------------
SALIENT_WORDS = ["error", "err!", "failed", "panic", "fatal", "exception", "traceback"]
HOTFIX_WORDS = ["hotfix", "hot-fix", "hot fix", "fix:", "fixup", "urgent fix", "quick fix", "patch:", "patch "]
REVERT_WORDS = ['revert "', "revert:", "revert ", "this reverts", "rollback", "rolled back"]
# --- fixed values: failing test lines (first format that fits wins), missing executables ----
GO_FAIL = r"(?i)^--- FAIL: ([^\s(]+)"
PYTEST_FAIL = r"(?i)^FAILED\s+([^\s]+)"
JEST_FAIL = r"^\s*[●\*]\s+(.+)$"
EXEC_PATH = r"""(?i)\bexec\s+["']?([^"'\s:]+)["']?.*no such file or directory"""
EXEC_QUOTED = r"""(?i)\bexec:\s+["']([^"']+)["']"""
COMMAND_NOT_FOUND = r"(?i)^\s*([A-Za-z0-9._+-]+):\s+command not found"
# --- fixed values: bands of the confidence text, size bands of candidate lines --------------
CONFIDENCE_BANDS = [(0.8, "High"), (0.55, "Medium")]
# --- end of fixed values ---------------------------------------------------------------------


def gap_class(clean: Column) -> tuple[Column, Column]:
    """(class, confidence) of a cluster line: the first class with any hit, halved unless both hit."""
    name = conf = None
    for cls, weight, first, second in GAP_CLASSES:
        a, b = F.rlike(clean, F.lit(jvm(first))), F.rlike(clean, F.lit(jvm(second)))
        value = F.when(a & b, weight).otherwise(weight * 0.5)
        name = F.when(a | b, F.lit(cls)) if name is None else name.when(a | b, F.lit(cls))
        conf = F.when(a | b, value) if conf is None else conf.when(a | b, value)
    return name.otherwise(F.lit("unknown")), conf.otherwise(F.lit(0.3))


def is_noise_line(lower: Column) -> Column:
    out = F.lit(False)
    for p in NOISE_PREFIXES:
        out = out | F.startswith(lower, F.lit(p))
    return out


def candidate_score(line: Column, lower: Column | None = None) -> Column:
    """Diagnostic weight of a trimmed line. ``lower``: its lower case, where that is known."""
    lower = F.lower(line) if lower is None else lower
    score = F.lit(0)
    for w in ERROR_WORDS:
        score = score + F.when(F.contains(lower, F.lit(w)), 3).otherwise(0)
    n = F.octet_length(line)
    return score + F.when((n >= 20) & (n <= 100), 2).when(n < 15, -2).when(n > 200, -1).otherwise(0)


def unknown_category(signal: Column, stage: Column) -> Column:
    v = F.lower(tx.trim_space(signal))
    out = None
    for name, words in UNKNOWN_CATEGORIES.items():
        hit = tx.contains_any(v, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.when(stage == "deploy", "deploy").when(stage == "test", "test").otherwise("build")


def failing_test(line: Column) -> Column:
    """Name of the failing test a trimmed line reports, else NULL."""
    def got(p: str) -> Column:
        return F.nullif(F.regexp_extract(line, jvm(p), 1), F.lit(""))

    return F.coalesce(got(GO_FAIL), got(PYTEST_FAIL), tx.trim_space(got(JEST_FAIL)))


def is_salient(line: Column) -> Column:
    return tx.contains_any(F.lower(line), SALIENT_WORDS)


def is_hotfix(subject: Column) -> Column:
    return tx.contains_any(F.lower(subject), HOTFIX_WORDS)


def is_revert(subject: Column) -> Column:
    return tx.contains_any(F.lower(subject), REVERT_WORDS)


def confidence_band(confidence: Column) -> Column:
    out = None
    for floor, name in CONFIDENCE_BANDS:
        hit = confidence >= floor
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("Low"))


def missing_executable(line: Column) -> Column:
    """Map with the missing executable (base name) and its expected path, from one evidence line."""
    path = F.coalesce(
        F.nullif(F.regexp_extract(line, jvm(EXEC_PATH), 1), F.lit("")),
        F.nullif(F.regexp_extract(line, jvm(EXEC_QUOTED), 1), F.lit("")),
    )
    command = F.nullif(F.regexp_extract(line, jvm(COMMAND_NOT_FOUND), 1), F.lit(""))
    name = F.coalesce(tx.base_name(path), command)
    expected = F.when(F.contains(F.coalesce(path, F.lit("")), F.lit("/")), path)
    return F.map_filter(
        F.create_map(F.lit("missing_executable"), name, F.lit("expected_path"), expected), lambda _, v: v.isNotNull()
    )


def fix_steps(markdown: Column) -> Column:
    """Items of the bulleted and single-digit numbered lines of a markdown text."""
    lines = F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), tx.trim_space)
    items = F.filter(lines, lambda l: F.rlike(l, F.lit(r"^(?:- |[0-9]\. .)")))
    return F.transform(items, lambda l: tx.trim_space(F.regexp_replace(l, r"^(?:- |[0-9]\. )", "")))


_UNITS = {"d": "DAYS", "w": "WEEKS", "m": "MONTHS", "y": "YEARS"}


def lookback_interval(text: str) -> str:
    """``30d`` / ``2w`` / ``1m`` / ``1y`` as a SQL interval; anything unreadable means 30 days."""
    s = text.strip().lower()
    m = re.fullmatch(r"(\d+)([dwmy]?)", s)
    if not m or int(m.group(1)) <= 0:
        return "INTERVAL 30 DAYS"
    return f"INTERVAL {int(m.group(1))} {_UNITS[m.group(2) or 'd']}"


def within_lookback(ts: Column, now: Column, text: str) -> Column:
    return ts >= now - F.expr(lookback_interval(text))
