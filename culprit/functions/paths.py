"""Path classes, globs, ownership patterns and path generalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from culprit.functions.regex import glob_regex
from culprit.functions.text import base_name, contains_any

# --- fixed values: changed-file classes, tested in this order ----------------------------
DEPENDENCY_NAMES = [
    "go.mod", "go.sum", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt",
    "requirements-dev.txt", "pyproject.toml", "poetry.lock", "pipfile", "pipfile.lock", "gemfile", "gemfile.lock",
    "cargo.lock", "pom.xml", "build.gradle", "build.gradle.kts",
]
RUNTIME_NAMES = [".nvmrc", ".node-version", ".python-version", ".ruby-version", ".tool-versions", "dockerfile"]
CI_NAMES = [
    ".gitlab-ci.yml", ".drone.yml", ".travis.yml", ".woodpecker.yml", "jenkinsfile", "azure-pipelines.yml",
    "bitbucket-pipelines.yml", "appveyor.yml", "bitrise.yml", "buildspec.yml", "cloudbuild.yaml", "cloudbuild.yml",
]
CI_PREFIXES = [".github/workflows/", ".circleci/", ".buildkite/", ".semaphore/", ".tekton/"]
ENV_SUFFIXES = [".env", ".toml", ".ini", ".cfg", ".conf"]
ENV_PREFIXES = [".env", "config."]
ENV_NAMES = ["config.yaml", "config.yml", "config.json", ".config"]
DEPLOY_SUFFIXES = [".tf", ".tfvars"]
DEPLOY_PREFIXES = ["deploy/", "infra/", "k8s/", "helm/", "argocd/"]
SOURCE_SUFFIXES = [".go", ".js", ".ts", ".tsx", ".py", ".rb", ".java"]
FILE_CLASSES = {  # class: (reason, weight)
    "dependency": ("dependency file changed", 1.0),
    "runtime_toolchain": ("runtime or toolchain file changed", 1.0),
    "ci_config": ("workflow or CI config changed", 1.0),
    "environment": ("environment or config file changed", 0.9),
    "deploy_infra": ("deploy or infra file changed", 1.0),
    "test_data": ("test-only file changed", 0.8),
    "source_code": ("source file changed", 0.6),
}
# --- fixed values: configuration files of the commit signals -----------------------------
CONFIG_NAMES = [
    "go.mod", "go.sum", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Dockerfile",
    "pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "Pipfile.lock", "Gemfile", "Gemfile.lock", "Cargo.toml",
    "Cargo.lock", "pom.xml",
]
CONFIG_GLOBS = ["build.gradle*", "requirements*.txt", "docker-compose*", ".env*"]
CI_CONFIG_PREFIXES = [".github/", ".circleci/", ".gitlab", ".buildkite/", ".semaphore/", ".tekton/"]
CI_CONFIG_NAMES = [
    "Makefile", "Jenkinsfile", "azure-pipelines.yml", "bitbucket-pipelines.yml", ".gitlab-ci.yml", ".drone.yml",
    ".travis.yml", ".woodpecker.yml", "appveyor.yml", "bitrise.yml", "buildspec.yml", "cloudbuild.yaml", "cloudbuild.yml",
]
# --- fixed values: classes of source paths ------------------------------------------------
PATH_CLASSES = {
    "fixture": ["/testdata/", "/fixtures/", "/fixture/"],
    "example": ["/examples/", "/example/"],
    "migration": ["/migrations/", "/migration/"],
    "script": ["/scripts/", "/bin/"],
    "admin": ["/admin/", "/internal/tools/"],
    "test": ["_test.", "/tests/", "/test/", ".spec.", ".test."],
}
# --- fixed values: roots of generalised paths, tested in this order: (label, roots, kept) -
PATH_ROOTS = [
    ("<tmp>", ["/tmp/", "/var/folders/", "/private/var/folders/"], 2),
    ("<runner>", ["/__e/", "/opt/hostedtoolcache/", "c:/hostedtoolcache/", "d:/a/_temp/"], 3),
    (
        "<workspace>",
        ["/home/runner/work/", "/__w/", "/workspace/", "/builds/", "/github/workspace/", "d:/a/", "c:/users/runneradmin/work/"],
        3,
    ),
    ("<home>", ["/home/", "/users/", "c:/users/"], 3),
]
PATH_EDGE = "\"'()[]{}<>,;:"
# --- end of fixed values -------------------------------------------------------------------


def any_prefix(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.startswith(c, F.lit(w))
    return out


def any_suffix(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.endswith(c, F.lit(w))
    return out


def changed_file_class(path: Column) -> Column:
    """Class of a changed file, NULL when it tells nothing."""
    p = F.lower(path)
    b = base_name(p)
    return (
        F.when(b.isin(DEPENDENCY_NAMES) | contains_any(p, ["requirements", "poetry.lock"]), "dependency")
        .when(b.isin(RUNTIME_NAMES) | contains_any(p, ["dockerfile", "runtime"]), "runtime_toolchain")
        .when(b.isin(CI_NAMES) | any_prefix(p, CI_PREFIXES), "ci_config")
        .when(
            any_prefix(b, ENV_PREFIXES)
            | any_suffix(b, ENV_SUFFIXES)
            | b.isin(ENV_NAMES)
            | contains_any(b, ["secret", "vault"])
            | contains_any(p, ["/config/", "/secrets/"]),
            "environment",
        )
        .when(
            any_suffix(b, DEPLOY_SUFFIXES) | any_prefix(p, DEPLOY_PREFIXES) | contains_any(p, ["kubernetes", "terraform"]),
            "deploy_infra",
        )
        .when(
            F.endswith(b, F.lit("_test.go"))
            | contains_any(b, [".spec.", ".test."])
            | contains_any(p, ["/tests/", "/testdata/", "/fixtures/"]),
            "test_data",
        )
        .when(any_suffix(b, SOURCE_SUFFIXES), "source_code")
    )


def changed_file_weight(file_class: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, (_, w) in FILE_CLASSES.items() for x in (k, w)])
    return F.coalesce(table[file_class], F.lit(0.0))


def changed_file_reason(file_class: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (r, _) in FILE_CLASSES.items() for x in (k, r)])[file_class]


def is_config_file(path: Column) -> Column:
    b = base_name(path)
    out = b.isin(CONFIG_NAMES)
    for g in CONFIG_GLOBS:
        out = out | F.rlike(b, F.lit(glob_regex(g)))
    return out


def is_ci_config_file(path: Column) -> Column:
    return any_prefix(path, CI_CONFIG_PREFIXES) | base_name(path).isin(CI_CONFIG_NAMES)


def source_path_class(path: Column) -> Column:
    p = F.lower(path)
    out = None
    for name, words in PATH_CLASSES.items():
        hit = contains_any(p, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("production"))


def glob_match(path: Column, glob: str) -> Column:
    """Glob against the base name, the full path or any one path segment."""
    rx = F.lit(glob_regex(glob))
    return F.rlike(path, rx) | F.exists(F.split(path, "/"), lambda s: F.rlike(s, rx))


def glob_match_any(path: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | glob_match(path, g)
    return out


def glob_to_regex(pattern: Column) -> Column:
    """Column form of :func:`glob_regex` for glob patterns that are data."""
    quoted = F.regexp_replace(pattern, r"([.^$+{}\[\]()|\\])", r"\\$1")
    return F.concat(
        F.lit("^"),
        F.replace(F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")),
        F.lit("$"),
    )


def owner_regex(pattern: Column) -> Column:
    """Ownership pattern as one anchored regex over a path without leading slash.

    ``dir/`` is a plain prefix; a pattern without a slash may match the base name; one
    without wildcards also owns everything below it; ``**`` crosses directories.
    """
    p = F.regexp_replace(pattern, "^/", "")
    quoted = F.regexp_replace(p, r"([.^$+{}\[\]()|\\])", r"\\$1")
    body = F.replace(quoted, F.lit("**"), F.lit("\u0000"))
    body = F.replace(F.replace(body, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    body = F.replace(body, F.lit("\u0000"), F.lit("(?s:.*)"))
    base = F.when(F.contains(p, F.lit("/")), F.lit("")).otherwise(F.lit("(?:(?s:.*)/)?"))
    below = F.when(F.rlike(p, F.lit("[*?]")), F.lit("")).otherwise(F.lit("(?:/(?s:.*))?"))
    exact = F.concat(F.lit("^(?:"), base, body, F.lit("|"), body, below, F.lit(")$"))
    prefix = F.concat(F.lit("^"), F.regexp_replace(quoted, "/$", ""))
    return F.when(F.endswith(p, F.lit("/")), prefix).otherwise(exact)


def generalize_path(token: Column) -> Column:
    """Replace the run-specific head of an absolute path by its kind and keep the last parts."""
    edge = r"[\"'()\[\]{}<>,;:]+"
    trimmed = F.regexp_replace(token, f"^{edge}|{edge}$", "")
    suffix = F.regexp_extract(trimmed, r"^.[^\n]*?((?::[0-9]+)+)$", 1)
    numbers = F.regexp_replace(suffix, ":[0-9]+", ":<n>")
    path = F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(suffix))
    path = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")
    low = F.lower(path)

    def tail(keep: int) -> Column:
        parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
        parts = F.when(F.endswith(F.get(parts, 0), F.lit(":")), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
        return F.array_join(F.slice(parts, F.greatest(F.size(parts) - keep + 1, F.lit(1)), F.lit(keep)), "/")

    def labelled(label: str, keep: int) -> Column:
        t = tail(keep)
        return F.concat(F.when(t == "", F.lit(label)).otherwise(F.concat(F.lit(label + "/"), t)), numbers)

    windows_temp = F.startswith(low, F.lit("c:/users/")) & F.contains(low, F.lit("/appdata/local/temp/"))
    out = None
    for label, roots, keep in PATH_ROOTS:
        hit = any_prefix(low, roots) | (windows_temp if label == "<tmp>" else F.lit(False))
        out = F.when(hit, labelled(label, keep)) if out is None else out.when(hit, labelled(label, keep))
    absolute = F.startswith(path, F.lit("/")) | F.rlike(path, F.lit("^.:/"))
    return out.when(absolute, labelled("<path>", 3)).otherwise(F.concat(path, numbers))


def looks_like_path(token: Column) -> Column:
    trimmed = F.replace(F.regexp_replace(token, r"^[\"'()\[\]{}<>,;:]+|[\"'()\[\]{}<>,;:]+$", ""), F.lit("\\"), F.lit("/"))
    return F.startswith(trimmed, F.lit("/")) | F.rlike(trimmed, F.lit("^.:/"))
