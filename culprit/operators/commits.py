"""Commit-history analytics and the repository context of failures.

``commits(repo, hash, ts, subject, author, files)``: newest commits come first by
``(ts desc, hash)``. Failure patterns are a table ``(failure_id, pattern)`` of globs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from culprit.functions import classify as cl
from culprit.functions import paths as pt
from culprit.functions.storage import stored
from culprit.functions.tables import small_table, with_row
from culprit.functions.text import dir_name
from culprit.operators.globs import glob_hits

# --- fixed values: list sizes and thresholds ------------------------------------------------------
LARGE_COMMIT = 10
TOP_AUTHORS = 5
RECENT_FILES, RELATED_COMMITS, HOTSPOT_DIRS, CO_CHANGE_HINTS, SIGNAL_HINTS = 10, 5, 5, 3, 5
# --- fixed values: path globs of a failure category ------------------------------------------------
COMMON_CI = [".github*", ".gitlab-ci*", ".circleci*", "ci*", "Makefile", "*.sh"]
CATEGORY_PATTERNS = {
    "auth": COMMON_CI + [".env*", "deploy*", "Dockerfile", "*.yaml", "*.yml", "vault*", "secrets*"],
    "build": COMMON_CI + [
        "Dockerfile", "go.mod", "go.sum", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "pom.xml",
        "build.gradle", "pyproject.toml", "Gemfile", "requirements*.txt", "CMakeLists.txt",
    ],
    "ci": COMMON_CI + [
        ".gitlab-ci.yml", ".gitlab*", ".circleci*", "Jenkinsfile", "azure-pipelines.yml", "bitbucket-pipelines.yml",
        "*.yml", "*.yaml",
    ],
    "deploy": COMMON_CI + [
        "deploy*", "k8s*", "kubernetes*", "helm*", "kustomize*", "argocd*", "*.yaml", "*.yml", "Dockerfile", "*.tf",
    ],
    "test": [
        "*_test.go", "testdata*", "fixtures*", "migrations*", "*.sql", "db*", "internal/*test*", "pkg/*test*",
        "playwright.config.*", "cypress.config.*", "*.spec.ts", "*.spec.js",
    ],
    "runtime": COMMON_CI + ["Dockerfile", "*.yaml", "*.yml", "*.json", "*.toml", "config*"],
    "network": COMMON_CI + ["*.pem", "*.crt", "*.key", "nginx*", "tls*", "cert*", "deploy*"],
}
DEFAULT_PATTERNS = COMMON_CI + ["Dockerfile", "deploy*", "*.yaml", "*.yml"]
# --- fixed values: path globs of single failures, which come before those of their category ---------
FAILURE_PATTERNS = {
    "docker-auth": COMMON_CI + ["Dockerfile", ".docker*", ".env*", "deploy*", "scripts/*deploy*"],
    "git-auth": COMMON_CI + [".gitconfig", ".git-credentials", ".netrc"],
    "kubectl-auth": COMMON_CI + ["k8s*", "kubernetes*", "helm*", "*.yaml", "*.yml", "deploy*"],
    "oidc-token-failure": COMMON_CI + [".env*", "deploy*", "*.yaml", "*.yml", "infra*", "terraform*"],
    "vault-secret-missing": COMMON_CI + ["vault*", ".env*", "deploy*", "*.yaml", "*.yml", "infra*"],
    "missing-env config-mismatch secrets-not-available": COMMON_CI + [
        ".env*", "*.env", "*.json", "*.toml", "*.yaml", "*.yml", "config*", "deploy*",
    ],
    "runtime-mismatch": COMMON_CI + [
        "Dockerfile", "docker-compose*", "package.json", "go.mod", "go.sum", "pyproject.toml", "Gemfile",
        "*.tool-versions", ".nvmrc",
    ],
    "node-version-mismatch": COMMON_CI + [".nvmrc", ".node-version", "package.json", "Dockerfile"],
    "java-version-mismatch": COMMON_CI + [
        "pom.xml", "build.gradle", "build.gradle.kts", ".java-version", ".tool-versions", "Dockerfile",
    ],
    "gradle-build gradle-wrapper-missing": COMMON_CI + [
        "pom.xml", "build.gradle", "build.gradle.kts", "gradlew", "gradle*", ".java-version",
    ],
    "health-check-failure": COMMON_CI + [
        "Dockerfile", "cmd/*", "internal/*", "server*", "api*", "routes*", "deploy*", "k8s*", "*.yaml", "*.yml",
    ],
    "flaky-test parallelism-conflict order-dependency": [
        "*_test.go", "testdata*", "fixtures*", "migrations*", "db*", "internal/*test*", "pkg/*test*", "*.sql",
    ],
    "mock-assertion-failure": [
        "*_test.go", "*.test.ts", "*.spec.ts", "*.test.js", "*.spec.js", "*_test.py", "testdata*", "fixtures*",
    ],
    "e2e-browser-failure": [
        "playwright.config.*", "cypress.config.*", "cypress*", "e2e*", "tests/e2e*", "*.spec.ts", "*.spec.js",
    ],
    "testcontainer-startup": COMMON_CI + ["docker-compose*", "src/test*", "*Test.java", "*_test.go", "Dockerfile"],
    "database-migration-test": ["migrations*", "db*", "database*", "*.sql", "alembic*", "flyway*", "Gemfile", "*.rb"],
    "go-sum-missing": ["go.mod", "go.sum"],
    "npm-ci-lockfile yarn-lockfile dependency-drift": [
        "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".npmrc", ".nvmrc",
    ],
    "pnpm-lockfile": ["pnpm-lock.yaml", "package.json", ".npmrc"],
    "ruby-bundler": ["Gemfile", "Gemfile.lock", ".ruby-version"],
    "python-module-missing": ["requirements*.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile*", "poetry.lock"],
    "node-out-of-memory": [
        "package.json", "webpack.config.*", "next.config.*", "jest.config.*", ".babelrc", "tsconfig.json",
    ],
    "cmake-configure-error": COMMON_CI + ["CMakeLists.txt", "cmake*", "CMake*", "conanfile*", "vcpkg.json"],
    "protobuf-compile": COMMON_CI + ["*.proto", "buf.gen.yaml", "buf.work.yaml", "Makefile"],
    "terraform-state-lock": ["*.tf", "*.tfvars", "terraform*", "infra*", "deploy*"],
    "container-crash oom-killed resource-limits": COMMON_CI + [
        "Dockerfile", "k8s*", "kubernetes*", "deploy*", "*.yaml", "*.yml",
    ],
    "container-entrypoint-missing": COMMON_CI + ["Dockerfile", "docker-compose*", "deploy*", "*.yaml", "*.yml"],
    "shared-library-missing": COMMON_CI + ["Dockerfile", "CMakeLists.txt", "*.c", "*.cpp", "*.h", "Makefile"],
    "file-descriptor-limit": COMMON_CI + ["Dockerfile", "*.yaml", "*.yml", "config*"],
    "port-conflict port-in-use": COMMON_CI + ["Dockerfile", "docker-compose*", "*.yaml", "*.yml", "*.json", "*.toml"],
    "database-lock": ["migrations*", "db*", "database*", "*.sql", "*.yaml", "*.yml", "deploy*"],
    "ssl-cert-error": COMMON_CI + ["*.pem", "*.crt", "*.csr", "*.key", "tls*", "cert*", "nginx*"],
    "http-auth-failure": COMMON_CI + [".env*", "*.yaml", "*.yml", "config*", "deploy*"],
    "webhook-delivery-failure": COMMON_CI + ["*.yaml", "*.yml", ".github*", "deploy*", "scripts*"],
    "github-actions-syntax": [".github/workflows/*.yml", ".github/workflows/*.yaml", ".github*"],
    "gitlab-ci-yaml-invalid": [".gitlab-ci.yml", ".gitlab*", "*.gitlab-ci.yml"],
    "circleci-config-invalid": [".circleci/config.yml", ".circleci*"],
    "jenkins-pipeline-syntax": ["Jenkinsfile", "vars/*.groovy", "src/**/*.groovy", "jenkins*"],
    "azure-pipeline-task-failure": ["azure-pipelines.yml", ".azure*", "*.azure-pipelines.yml"],
    "bitbucket-pipeline-failure": ["bitbucket-pipelines.yml"],
    "cache-restore-miss artifact-upload-failure": COMMON_CI + [
        "Makefile", "package.json", "go.sum", "Cargo.lock", "pom.xml", "build.gradle",
    ],
    "runner-disk-full": COMMON_CI + ["Dockerfile", ".dockerignore", "docker-compose*"],
    "k8s-configmap-missing k8s-insufficient-resources k8s-rbac-forbidden": COMMON_CI + [
        "k8s*", "kubernetes*", "helm*", "kustomize*", "deploy*", "*.yaml", "*.yml",
    ],
    "helm-upgrade-failed helm-chart-failure": COMMON_CI + ["helm*", "Chart.yaml", "values*.yaml", "templates*", "deploy*"],
    "argocd-sync-failed": COMMON_CI + ["argocd*", "manifests*", "deploy*", "*.yaml", "*.yml"],
    "image-pull-backoff": COMMON_CI + ["Dockerfile", "deploy*", "k8s*", "helm*", "*.yaml", "*.yml"],
    "ecs-deployment-failed": COMMON_CI + ["*.tf", "*.json", "ecs*", "task-definition*", "deploy*"],
}
# --- end of fixed values -----------------------------------------------------------------------------


def patterns_of(failure_id: str, category: str, own: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """The globs of a failure: a list given for it, else its fixed list, else that of its category."""
    given = (own or {}).get(failure_id)
    fixed = next((globs for ids, globs in FAILURE_PATTERNS.items() if failure_id in ids.split()), None)
    return list(dict.fromkeys(given or fixed or CATEGORY_PATTERNS.get(category.strip().lower(), DEFAULT_PATTERNS)))


def failure_patterns(spark: SparkSession, failures: list[tuple[str, str]], own: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Pattern rows of (failure id, category) pairs (see :func:`patterns_of`)."""
    rows = [{"failure_id": f, "pattern": g} for f, category in failures for g in patterns_of(f, category, own)]
    return small_table(spark, rows, {"failure_id": "string", "pattern": "string"})


def newest_first(prefix: str = "") -> list[Column]:
    return [F.desc(f"{prefix}ts"), F.asc(f"{prefix}hash")]


def commit_files(commits: DataFrame) -> DataFrame:
    return commits.select("repo", "hash", "ts", "subject", F.posexplode("files").alias("pos", "file"))


def file_churn(commits: DataFrame) -> DataFrame:
    return commits.select("repo", F.explode("files").alias("file")).groupBy("repo", "file").agg(F.count("*").alias("count"))


def dir_churn(commits: DataFrame) -> DataFrame:
    # count files first: a busy directory reaches the second step as one row per file
    by_file = file_churn(commits).withColumn("dir", dir_name(F.col("file")))
    return by_file.filter("dir <> ''").groupBy("repo", "dir").agg(F.sum("count").alias("count"))


def repeated(churn: DataFrame) -> DataFrame:
    return churn.filter("count >= 2")


def hotfix_commits(commits: DataFrame) -> DataFrame:
    return commits.filter(cl.is_hotfix(F.col("subject")))


def revert_commits(commits: DataFrame) -> DataFrame:
    return commits.filter(cl.is_revert(F.col("subject")))


def large_commits(commits: DataFrame) -> DataFrame:
    return commits.filter(F.size("files") >= LARGE_COMMIT)


def config_churn(churn: DataFrame) -> DataFrame:
    """Churn of dependency, build and CI configuration files."""
    f = F.col("file")
    flagged = churn.withColumns({"is_config": pt.is_config_file(f), "is_ci_config": pt.is_ci_config_file(f)})
    return flagged.filter("is_config OR is_ci_config")


def author_counts(commits: DataFrame) -> DataFrame:
    return commits.filter("author <> ''").groupBy("repo", "author").agg(F.count("*").alias("count"))


def top_authors(commits: DataFrame, n: int = TOP_AUTHORS) -> DataFrame:
    order = W.partitionBy("repo").orderBy(F.desc("count"), "author")
    return author_counts(commits).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def distinct_authors(commits: DataFrame) -> DataFrame:
    return author_counts(commits).groupBy("repo").agg(F.count("*").alias("author_count"))


PAIR_BLOCK = 2_000


def co_change_pairs(commits: DataFrame) -> DataFrame:
    """Pairs of files changed together in at least two commits.

    Only files that occur in two or more commits can be in such a pair, so the rest is dropped
    before pairing. The files of a commit fall into blocks, and blocks meet in the cells of a triangular grid:
    a task holds two blocks, never a whole large commit.
    """
    blocks = F.ceil(F.size("files") / PAIR_BLOCK).cast("int")
    files = commits.select("repo", "hash", blocks.alias("blocks"), F.explode("files").alias("file"))
    again = repeated(file_churn(commits)).select("repo", "file")
    sized = stored(files.join(again, ["repo", "file"], "left_semi"))  # both sides of the pairing read it
    own = sized.withColumn("block", F.pmod(F.xxhash64("file"), F.col("blocks")).cast("int"))
    placed = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["repo", "hash", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    a, b = (placed.select(*cell, F.col("file").alias(f"file_{x}"), F.col("block").alias(f"block_{x}")) for x in ("a", "b"))
    met = a.join(b, ["repo", "hash", "low", "high"]).filter("file_a < file_b AND (low = high OR block_a <> block_b)")
    return met.groupBy("repo", "file_a", "file_b").agg(F.count("*").alias("count")).filter("count >= 2")


def recent_files(commits: DataFrame, n: int = RECENT_FILES) -> DataFrame:
    """First distinct files, newest commit first."""
    newest = commit_files(commits).groupBy("repo", "file").agg(
        F.min(F.struct((-F.unix_micros("ts")).alias("t"), "hash", "pos")).alias("at")
    )
    order = W.partitionBy("repo").orderBy("at.t", "at.hash", "at.pos")
    return newest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("repo", "rank", "file")


def matched_files(files: DataFrame, patterns: DataFrame, file: str = "file") -> DataFrame:
    """Distinct (repo, file) x failure whose glob fits the base name, the path or one segment (see
    :mod:`culprit.operators.globs`). A path that many repositories hold is compared once."""
    named = stored(files.select("repo", F.col(file).alias("file")).distinct())
    hits = glob_hits(named, patterns.select("failure_id", "pattern")).select("file", "failure_id").distinct()
    return named.join(hits, "file").select("repo", "file", "failure_id")


def _repos_and_failures(commits: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every (repo, failure): fallbacks need the pairs without a direct hit too."""
    ids = patterns.agg(F.collect_set("failure_id").alias("ids"))
    return with_row(commits.select("repo").distinct(), ids).select("repo", F.explode("ids").alias("failure_id"))


def _top(rows: DataFrame, order: list[Column], n: int, keys: tuple[str, ...] = ("repo", "failure_id")) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _with_fallback(direct: DataFrame, fallback: DataFrame, pairs: DataFrame) -> DataFrame:
    """``direct`` rows, and per-repo ``fallback`` rows for the (repo, failure) pairs that have none."""
    direct = stored(direct)  # a short list per pair, needed twice
    missing = pairs.join(direct.select("repo", "failure_id").distinct(), ["repo", "failure_id"], "left_anti")
    return direct.unionByName(missing.join(fallback, "repo").select(*direct.columns))


def relevant_files(commits: DataFrame, patterns: DataFrame, n: int = RECENT_FILES) -> DataFrame:
    """Matching files, newest commit first; without any match the files with the highest churn."""
    hits = matched_files(commits.select("repo", F.explode("files").alias("file")), patterns)
    newest = commit_files(commits).groupBy("repo", "file").agg(F.min(F.struct((-F.unix_micros("ts")).alias("t"), "hash")).alias("at"))
    direct = _top(hits.join(newest, ["repo", "file"]), [F.col("at.t"), F.col("at.hash"), F.col("file")], n)
    churn = _top(file_churn(commits), [F.desc("count"), F.col("file")], n, ("repo",))
    return _with_fallback(
        direct.select("repo", "failure_id", "rank", "file"), churn.select("repo", "rank", "file"), _repos_and_failures(commits, patterns)
    )


def _matching_commits(commits: DataFrame, patterns: DataFrame) -> DataFrame:
    """(failure, commit) pairs whose commit touches a matching file, without the file list."""
    files = commit_files(commits).select("repo", "hash", "ts", "subject", "file")
    hits = matched_files(files, patterns)
    return files.join(hits, ["repo", "file"]).select("repo", "failure_id", "hash", "ts", "subject").distinct()


def related_commits(commits: DataFrame, patterns: DataFrame, n: int = RELATED_COMMITS) -> DataFrame:
    top = _top(_matching_commits(commits, patterns), newest_first(), n)
    return top.select(
        "repo", "failure_id", "rank", F.substring("hash", 1, 7).alias("hash"), "subject", F.date_format("ts", "yyyy-MM-dd").alias("date")
    )


def hotspot_dirs(commits: DataFrame, patterns: DataFrame, n: int = HOTSPOT_DIRS) -> DataFrame:
    """Directories of matching files by churn; without any the busiest directories."""
    hits = matched_files(commits.select("repo", F.explode("files").alias("file")), patterns)
    counted = hits.join(file_churn(commits), ["repo", "file"]).withColumn("dir", dir_name(F.col("file"))).filter("dir <> ''")
    dirs = counted.groupBy("repo", "failure_id", "dir").agg(F.sum("count").alias("count"))
    direct = _top(dirs, [F.desc("count"), F.col("dir")], n)
    busy = _top(dir_churn(commits), [F.desc("count"), F.col("dir")], n, ("repo",))
    return _with_fallback(
        direct.select("repo", "failure_id", "rank", "dir"), busy.select("repo", "rank", "dir"), _repos_and_failures(commits, patterns)
    )


def co_change_hints(pairs: DataFrame, patterns: DataFrame, n: int = CO_CHANGE_HINTS) -> DataFrame:
    """Co-change pairs with a matching file on either side."""
    pairs = stored(pairs)  # read for the files and for both sides
    files = pairs.select("repo", F.explode(F.array("file_a", "file_b")).alias("file"))
    hits = matched_files(files, patterns)
    sides = [pairs.join(hits.withColumnRenamed("file", c), ["repo", c]) for c in ("file_a", "file_b")]
    both = sides[0].select("repo", "failure_id", "file_a", "file_b", "count").unionByName(
        sides[1].select("repo", "failure_id", "file_a", "file_b", "count")
    )
    top = _top(both.distinct(), [F.desc("count"), F.col("file_a"), F.col("file_b")], n)
    return top.select("repo", "failure_id", "rank", F.concat_ws(" <-> ", "file_a", "file_b").alias("hint"))


def hotfix_hints(commits: DataFrame, patterns: DataFrame, n: int = SIGNAL_HINTS) -> DataFrame:
    """Subjects of hotfix commits on matching files; without any the newest hotfixes."""
    fixes = hotfix_commits(commits)
    direct = _top(_matching_commits(fixes, patterns), newest_first(), n).select("repo", "failure_id", "rank", F.col("subject").alias("hint"))
    recent = _top(fixes, newest_first(), n, ("repo",)).select("repo", "rank", F.col("subject").alias("hint"))
    return _with_fallback(direct, recent, _repos_and_failures(commits, patterns))


def drift_hints(commits: DataFrame, patterns: DataFrame, n: int = SIGNAL_HINTS) -> DataFrame:
    """Reverts on matching files, then repeated directories and files; without any the newest reverts."""
    reverts = revert_commits(commits)
    on_files = _matching_commits(reverts, patterns).select(
        "repo", "failure_id", F.lit(0).alias("part"), (-F.unix_micros("ts")).alias("o1"), F.col("hash").alias("o2"), F.col("subject").alias("hint")
    )
    churn = file_churn(commits)
    hits = matched_files(churn, patterns)
    # a directory is relevant when a matching file lies anywhere below it
    above = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda i: F.array_join(F.slice(F.split("file", "/"), F.lit(1), i), "/")),
        lambda d: d != F.col("file"),
    )
    relevant = hits.select("repo", "failure_id", F.explode(above).alias("dir")).distinct()
    dirs = relevant.join(repeated(dir_churn(commits)), ["repo", "dir"]).select(
        "repo", "failure_id", F.lit(1).alias("part"), (-F.col("count")).alias("o1"), F.col("dir").alias("o2"),
        F.concat(F.lit("Repeated edits in "), "dir").alias("hint"),
    )
    files = hits.join(repeated(churn), ["repo", "file"]).select(
        "repo", "failure_id", F.lit(2).alias("part"), (-F.col("count")).alias("o1"), F.col("file").alias("o2"),
        F.concat(F.lit("Repeated edits in "), "file").alias("hint"),
    )
    direct = _top(on_files.unionByName(dirs).unionByName(files), [F.col("part"), F.col("o1"), F.col("o2")], n)
    recent = _top(reverts, newest_first(), n, ("repo",)).select("repo", "rank", F.col("subject").alias("hint"))
    return _with_fallback(direct.select("repo", "failure_id", "rank", "hint"), recent, _repos_and_failures(commits, patterns))


def change_hints(commits: DataFrame, n: int = SIGNAL_HINTS) -> DataFrame:
    """Per repo: configuration files, CI files and large commits as hints, each list on its own."""
    churn = config_churn(file_churn(commits))
    parts = []
    for kind in ("is_config", "is_ci_config"):
        top = _top(churn.filter(kind), [F.desc("count"), F.col("file")], n, ("repo",))
        parts.append(top.select("repo", F.lit(kind[3:]).alias("kind"), "rank", F.col("file").alias("hint")))
    big = _top(large_commits(commits), newest_first(), n, ("repo",))
    parts.append(
        big.select("repo", F.lit("large_commit").alias("kind"), "rank", F.format_string("%s (%d files)", F.col("subject"), F.size("files")).alias("hint"))
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def plain_context(commits: DataFrame) -> DataFrame:
    """Repository context without a matched rule: ``(repo, kind, rank, value)`` rows."""
    dirs = _top(dir_churn(commits), [F.desc("count"), F.col("dir")], HOTSPOT_DIRS, ("repo",))
    fixes = _top(hotfix_commits(commits), newest_first(), SIGNAL_HINTS, ("repo",))
    newest = _top(commits, newest_first(), RELATED_COMMITS, ("repo",))
    reverts = revert_commits(commits).select(
        "repo", F.lit(0).alias("part"), (-F.unix_micros("ts")).alias("o1"), F.col("hash").alias("o2"), F.col("subject").alias("value")
    )
    again = repeated(dir_churn(commits)).select(
        "repo", F.lit(1).alias("part"), (-F.col("count")).alias("o1"), F.col("dir").alias("o2"),
        F.concat(F.lit("Repeated edits in "), "dir").alias("value"),
    )
    drift = _top(reverts.unionByName(again), [F.col("part"), F.col("o1"), F.col("o2")], SIGNAL_HINTS, ("repo",))

    def rows(df: DataFrame, kind: str, value: Column) -> DataFrame:
        return df.select("repo", F.lit(kind).alias("kind"), "rank", value.alias("value"))

    out = rows(recent_files(commits), "recent_file", F.col("file"))
    for df, kind, value in (
        (dirs, "hotspot_dir", F.col("dir")),
        (fixes, "hotfix", F.col("subject")),
        (drift, "drift", F.col("value")),
        (newest, "commit", F.concat_ws(" ", F.substring("hash", 1, 7), F.date_format("ts", "yyyy-MM-dd"), "subject")),
    ):
        out = out.unionByName(rows(df, kind, value))
    return out
