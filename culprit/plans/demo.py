"""Rules and parameters that fit the driver's tables.

The tables hold invented prose, not build logs, so the queries use small rule tables that
hit it. The operators themselves know nothing about these rules.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.operators.rules import RuleSet

RULES = [
    {
        "rule_id": "license-notice", "title": "License notice found", "category": "build", "severity": "low",
        "base_score": 0.5, "stage_hints": ["deploy"], "pack": "starter", "domain": "legal", "class": "license",
        "mode": "notice", "likely_files": ["LICENSE"], "tags": ["license", "notice"],
        "fix": "1. Read the notice\n2. Keep it\n- Ask the owner",
        "any": ["licensed under", "Apache  License", "version 2.0", "MIT License"], "none": ["CC BY-NC"],
    },
    {
        "rule_id": "license-restricted", "title": "Restricted license found", "category": "build", "severity": "high",
        "base_score": 0.5, "stage_hints": [], "pack": "starter", "domain": "legal", "class": "license",
        "mode": "restricted", "likely_files": ["LICENSE", "NOTICE"], "tags": ["license"],
        "fix": "- Remove the text", "any": ["licensed under"], "all": ["cc by-nc", "4.0"],
    },
    {
        "rule_id": "contact-address", "title": "Contact address in text", "category": "auth", "severity": "medium",
        "base_score": 0.25, "stage_hints": ["test"], "pack": "privacy", "domain": "privacy", "class": "personal",
        "mode": "contact", "likely_files": [".env", "config/*.yml"], "tags": ["mail", "phone"],
        "fix": "- Mask the address", "any": ["@mail", ".example.", "555-"], "none": [],
    },
    {
        "rule_id": "credential-text", "title": "Credential in text", "category": "auth", "severity": "critical",
        "base_score": 1.0, "stage_hints": ["test", "build"], "pack": "privacy", "domain": "privacy", "class": "secret",
        "mode": "token", "likely_files": [".env", "src/*.py"], "tags": ["token", "secret"],
        "fix": "- Revoke it\n- Rotate it", "all": ["token =", "\""],
    },
    {
        "rule_id": "mixed-markup", "title": "Markup left in text", "category": "runtime", "severity": "low",
        "base_score": 0.0, "stage_hints": [], "pack": "starter", "domain": "format", "class": "markup", "mode": "table",
        "likely_files": ["*.html"], "tags": ["markup"], "fix": "",
        "any": ["|", "###"], "partial": [{"minimum": 2, "patterns": ["|", "###", "***", "%%%"]}],
    },
    {
        "rule_id": "german-text", "title": "German prose", "category": "test", "severity": "low", "base_score": 0.0,
        "stage_hints": ["build"], "pack": "language", "domain": "language", "class": "prose", "mode": "german",
        "likely_files": ["*.md"], "tags": ["german"], "fix": "", "any": [" und ", " der ", "sch", "keit"],
        "none": ["tion the"], "partial": [{"minimum": 2, "patterns": ["ung", "lich", "ß"]}, {"minimum": 3, "patterns": ["ä", "ö", "ü"]}],
    },
    {
        "rule_id": "french-text", "title": "French prose", "category": "test", "severity": "low", "base_score": 0.0,
        "stage_hints": [], "pack": "language", "domain": "language", "class": "prose", "mode": "french",
        "likely_files": ["*.md"], "tags": ["french"], "fix": "", "any": [" les ", "que ", "la des", "tion", " der "],
        "all": ["eau", "é"],
    },
    {
        "rule_id": "spanish-text", "title": "Spanish prose", "category": "test", "severity": "low", "base_score": 0.0,
        "stage_hints": ["test"], "pack": "language", "domain": "language", "class": "prose", "mode": "spanish",
        "likely_files": ["*.md"], "tags": ["spanish"], "fix": "", "any": [" los ", "ción", "que ", "mente"],
        "none": ["eaux"],
    },
    {
        "rule_id": "boilerplate-line", "title": "Boilerplate line", "category": "ci", "severity": "medium",
        "base_score": 0.0, "stage_hints": ["test", "deploy"], "pack": "starter", "domain": "format", "class": "repeat",
        "mode": "boilerplate", "likely_files": [".github/workflows/*.yml"], "tags": ["line"], "fix": "* none",
        "any": ["the and attion to thanedble", "and therhean is the is", "nicht aulich", "and ornd."],
        "all": ["thanedble the, anea."],
    },
    {
        "rule_id": "stutter", "title": "Repeated word", "category": "runtime", "severity": "medium", "base_score": 0.1,
        "stage_hints": ["deploy"], "pack": "starter", "domain": "format", "class": "repeat", "mode": "stutter",
        "likely_files": ["*.txt"], "tags": ["repeat"], "fix": "", "any": ["the the", "de de", "is is", "ha ha"],
    },
]


@lru_cache(maxsize=4)
def rules(spark: SparkSession) -> RuleSet:
    return RuleSet.from_records(spark, RULES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """In local mode only: the test tables are single row groups, which Spark cannot split over the cores.

    On a cluster file splits spread the read and texts are not shuffled.
    """
    context = df.sparkSession.sparkContext
    return df.repartition(context.defaultParallelism, key) if context.master.startswith("local[") else df


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` as a log corpus."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("log_id"), "text", "source")
    return spread(docs, "log_id")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """`events` with a time-zone aware timestamp."""
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# One log line per event, written in SQL that both engines read alike.
EVENT_TIME = "substring(CAST(ts AS STRING), 1, 19)"
EVENT_LINE = f"""CASE event_type
 WHEN 'error' THEN CASE event_id % 5
  WHEN 0 THEN concat({EVENT_TIME}, ' ERROR: failed to restore cache /tmp/u', user_id, '/c', event_id, ': timed out')
  WHEN 1 THEN concat('--- FAIL: TestUser', user_id, ' (0.0', event_id % 10, 's)')
  WHEN 2 THEN concat('npm ERR! connection refused by 10.0.', user_id, '.', event_id % 250, ' pid ', event_id)
  WHEN 3 THEN concat('Error: permission denied /home/runner/work/app/u', user_id, '/main.go:', event_id, ':7')
  ELSE concat('exec: "/usr/local/bin/tool', user_id % 7, '": no such file or directory') END
 WHEN 'click' THEN CASE event_id % 4
  WHEN 0 THEN concat('$ go test ./pkg', user_id, '/...')
  WHEN 1 THEN 'collected 0 items'
  WHEN 2 THEN concat('Step ', event_id % 9, ': kubectl apply -f deploy/app', user_id, '.yaml')
  ELSE concat('   golangci-lint run   --timeout ', event_id % 60, 's') END
 WHEN 'view' THEN CASE event_id % 4
  WHEN 0 THEN concat('upload artifact report-', event_id)
  WHEN 1 THEN concat('no files found at C:\\build\\out', user_id)
  WHEN 2 THEN 'skipping upload because condition evaluated to false'
  ELSE '' END
 WHEN 'signup' THEN CASE event_id % 4
  WHEN 0 THEN concat('FAILED tests/test_user', user_id, '.py::case_', event_id % 7)
  WHEN 1 THEN concat('make build || true # run ', event_id)
  WHEN 2 THEN concat('continue-on-error: true for job ', user_id)
  ELSE concat('AssertionError: expected ', value, ' at https://ci.example.com/runs/', event_id) END
 ELSE CASE event_id % 4
  WHEN 0 THEN concat('cache hit for key 0a1b2c3d4e5f6789', user_id)
  WHEN 1 THEN concat('0 files checked in /opt/hostedtoolcache/go/1.2', user_id % 3, '/x64')
  WHEN 2 THEN concat('password=hunter', event_id, ' user', user_id, '@example.com')
  ELSE 'nothing to deploy' END
END"""


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, user_id, ts, line): `events` told as build-log lines."""
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
        F.expr(EVENT_LINE.replace("\\", "\\\\")).alias("line"),
    )


def event_logs(spark: SparkSession, sf: str) -> DataFrame:
    """One log per user and day: the day's lines in event order."""
    day = F.to_date("ts")
    return (
        event_lines(spark, sf)
        .groupBy("user_id", day.alias("day"))
        .agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("ls"))
        .select(
            F.concat(F.lit("u"), "user_id", F.lit("-"), F.col("day").cast("string")).alias("log_id"),
            F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"),
            F.concat(F.lit("p"), F.col("user_id") % 10).alias("source"),
        )
    )


EVENT_LOGS_SQL = f"""event_lines AS (
  SELECT event_id, user_id, ts, event_type, value, {EVENT_LINE} AS line FROM events
), event_logs AS (
  SELECT concat('u', user_id, '-', CAST(CAST(ts AS DATE) AS STRING)) AS log_id,
    string_agg(line, chr(10) ORDER BY event_id) AS text, concat('p', user_id % 10) AS source
  FROM event_lines GROUP BY user_id, CAST(ts AS DATE)
)"""

# Parts as files of a source tree.
FILE_PATH = """concat(
 CASE p_partkey % 8 WHEN 0 THEN 'src/api/' WHEN 1 THEN 'deploy/' WHEN 2 THEN 'src/tests/' WHEN 3 THEN '.github/workflows/'
  WHEN 4 THEN 'docs/' WHEN 5 THEN 'app/config/' WHEN 6 THEN '' ELSE 'src/core/' END,
 CASE WHEN p_partkey % 8 = 6 THEN '' ELSE concat(lower(p_type), '/') END,
 CASE p_partkey % 50 WHEN 7 THEN 'Dockerfile' WHEN 14 THEN 'go.mod' WHEN 21 THEN 'package.json' WHEN 28 THEN 'Makefile'
  WHEN 35 THEN 'requirements-ci.txt' WHEN 42 THEN '.env.local'
  ELSE concat(replace(p_name, ' ', '_'), p_partkey % 40, CASE p_size % 6 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.yml'
   WHEN 3 THEN '.tf' WHEN 4 THEN '_test.go' ELSE '.toml' END) END)"""
FILES_SQL = f"files AS (SELECT p_partkey, {FILE_PATH} AS path FROM part)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """(p_partkey, path): `part` told as a file listing; several parts may share a path."""
    return table(spark, sf, "part").select("p_partkey", F.expr(FILE_PATH).alias("path"))


# Rules for the event logs.
CI_RULES = [
    {
        "rule_id": "cache-restore", "title": "Cache could not be restored", "category": "ci", "severity": "medium",
        "base_score": 0.5, "stage_hints": ["build"], "pack": "starter", "domain": "platform", "class": "cache",
        "mode": "restore", "likely_files": [".github/workflows/*.yml", "go.mod"], "tags": ["cache"],
        "fix": "- Clear the cache\n- Run again", "any": ["failed to restore cache", "timed out", "error:"],
        "hypothesis": {"support": [("cache.restore.detected", 0.0, ""), ("log.contains:timed out", 0.3, "")],
                       "contradict": [("log.contains:permission denied", 0.0, "")],
                       "discriminator": [("log.absent:connection refused", 0.0, "no network refusal")], "exclude": []},
        "boosts": {"delta": [("delta.dependency.changed", 0.8)], "topology": []},
    },
    {
        "rule_id": "npm-network", "title": "Registry refused the connection", "category": "network", "severity": "high",
        "base_score": 0.5, "stage_hints": [], "pack": "starter", "domain": "network", "class": "registry",
        "mode": "refused", "likely_files": ["package.json", ".env*"], "tags": ["npm", "network"],
        "fix": "1. Check the mirror", "any": ["connection refused", "npm err!"], "all": ["npm err!", "refused by"],
        "hypothesis": {"support": [("log.contains:npm err!", 0.0, "")], "contradict": [("test.failed", 0.2, "")],
                       "discriminator": [("network.refused", 0.5, "")], "exclude": [("context.stage:deploy", 0.0, "")]},
        "boosts": {"delta": [], "topology": [("topology.boundary.crossed", 0.5)]}, "requires_topology": True,
    },
    {
        "rule_id": "file-permission", "title": "Permission denied on a file", "category": "auth", "severity": "high",
        "base_score": 0.5, "stage_hints": ["deploy", "test"], "pack": "security", "domain": "access", "class": "file",
        "mode": "denied", "likely_files": ["main.go", "deploy/*"], "tags": ["permission"], "fix": "- chmod",
        "any": ["permission denied", "error:"], "none": ["nothing to deploy"],
        "hypothesis": {"support": [("any.failure", 0.0, "")], "contradict": [], "discriminator": [],
                       "exclude": [("log.contains:collected 0 items", 0.0, "")]},
        "boosts": {"delta": [("delta.scope.changed", 0.0)], "topology": []},
    },
    {
        "rule_id": "missing-executable", "title": "Executable is missing", "category": "runtime", "severity": "critical",
        "base_score": 1.0, "stage_hints": ["build", "test"], "pack": "starter", "domain": "platform", "class": "runtime",
        "mode": "missing", "likely_files": ["Dockerfile"], "tags": ["exec", "tool"], "fix": "- Install the tool",
        "any": ["no such file or directory"], "all": ["exec:", "/usr/local/bin"],
        "hypothesis": {"support": [], "contradict": [("cache.absent", 0.0, "")], "discriminator": [], "exclude": []},
        "boosts": {"delta": [("delta.error.new", 0.4)], "topology": []}, "requires_delta": True,
    },
    {
        "rule_id": "go-test-failure", "title": "Go test failed", "category": "test", "severity": "medium",
        "base_score": 0.25, "stage_hints": ["test"], "pack": "starter", "domain": "test", "class": "unit", "mode": "go",
        "likely_files": ["*_test.go", "src/core/*"], "tags": ["go", "test"], "fix": "* see log", "any": ["--- fail:", "go test"],
        "partial": [{"minimum": 2, "patterns": ["--- fail:", "go test", "testuser"]}],
        "hypothesis": {"support": [("test.failed", 0.0, ""), ("context.stage:test", 0.15, "")], "contradict": [],
                       "discriminator": [("delta.signal:delta.test.failure.introduced", 0.6, "a new failing test")], "exclude": []},
        "boosts": {"delta": [("delta.test.failure.introduced", 1.1)], "topology": []},
    },
    {
        "rule_id": "pytest-failure", "title": "Python test failed", "category": "test", "severity": "medium",
        "base_score": 0.25, "stage_hints": ["test"], "pack": "starter", "domain": "test", "class": "unit", "mode": "pytest",
        "likely_files": ["tests/*.py"], "tags": ["python", "test"], "fix": "", "any": ["failed tests/", "assertionerror", ".py::"],
        "hypothesis": {"support": [("test.failed", 0.0, "")], "contradict": [("context.stage.absent:test", 0.1, "")],
                       "discriminator": [], "exclude": []},
        "boosts": {"delta": [], "topology": [("topology.failure.clustered", 0.3)]},
    },
]


@lru_cache(maxsize=4)
def ci_rules(spark: SparkSession) -> RuleSet:
    return RuleSet.from_records(spark, CI_RULES)


# `events` as a run history: user = pipeline, event type = failure, `view` = a run without a match.
RUNS_SQL = """runs AS (
  SELECT event_id AS run_id, user_id AS pipeline, event_type <> 'view' AS matched, CASE WHEN event_type <> 'view' THEN event_type END AS failure_id,
    ts AS completed_at, sha256(concat('in', user_id % 50, '-', event_id % 7)) AS input_hash, sha256(concat(event_type, CASE WHEN user_id % 50 < 3 THEN '' ELSE props END)) AS output_hash
  FROM events
), findings AS (
  SELECT event_id AS run_id, 1 AS rank, event_type AS failure_id, concat('Title of ', event_type, ' v', event_id % 3) AS title,
    CASE event_type WHEN 'error' THEN 'build' WHEN 'click' THEN 'test' ELSE 'ci' END AS category, (event_id % 100) / 100.0E0 AS confidence,
    sha256(concat(event_type, ':', user_id % 40, ':', event_id % 60)) AS signature_hash, ts AS seen_at
  FROM events WHERE event_type <> 'view'
), matches AS (
  SELECT event_id AS run_id, 1 AS rank, event_type AS rule_id FROM events WHERE event_type <> 'view'
  UNION ALL SELECT event_id, 2, CASE event_type WHEN 'error' THEN 'click' WHEN 'click' THEN 'purchase' ELSE 'error' END FROM events
  WHERE event_type <> 'view' AND event_id % 3 = 0
), hooks AS (
  SELECT event_id AS run_id, event_type AS rule_id, sha256(concat(event_type, ':', user_id % 40, ':', event_id % 60)) AS signature_hash,
    concat('hook-', event_id % 4) AS hook_id, CASE event_id % 3 WHEN 0 THEN 'verify' WHEN 1 THEN 'collect' ELSE 'remediate' END AS category,
    CASE user_id % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' ELSE 'executed' END AS status,
    CASE WHEN user_id % 5 > 2 THEN event_id % 2 = 0 END AS passed, (event_id % 30) / 100.0E0 AS confidence_delta, ts AS executed_at
  FROM events WHERE event_type <> 'view'
)"""


def history(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the history tables derived from `events`."""
    view = "events_" + "".join(c if c.isalnum() else "_" for c in sf)
    events(spark, sf).createOrReplaceTempView(view)
    text = RUNS_SQL.replace("sha256(", "sha2_256(").replace("FROM events", f"FROM {view}")
    text = text.replace("sha2_256(concat(", "sha2(concat(").replace("event_id % 7)) AS", "event_id % 7), 256) AS")
    text = text.replace("props END)) AS", "props END), 256) AS").replace("event_id % 60)) AS", "event_id % 60), 256) AS")
    return spark.sql(f"WITH {text} SELECT * FROM {name}")


# `orders` as commits and `lineitem` x `part` as the files they touch.
COMMIT_COLUMNS = """concat('repo', o_custkey % 5) AS repo, concat('c', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS hash, o_orderdate AS ts,
 CASE o_orderkey % 12 WHEN 0 THEN concat('Hotfix: part ', o_orderkey) WHEN 1 THEN concat('Revert "change ', o_orderkey, '"')
  WHEN 2 THEN concat('fixup! step ', o_orderkey) WHEN 3 THEN concat('Rolled back ', o_orderpriority)
  ELSE concat('Update ', o_orderpriority, ' ', o_orderkey) END AS subject, CASE WHEN o_custkey % 31 = 0 THEN '' ELSE concat('dev', o_custkey % 97) END AS author"""
COMMITS_SQL = f"""{FILES_SQL}, commit_lists AS (
  SELECT l_orderkey, list(path ORDER BY l_linenumber, path) AS fl FROM lineitem JOIN files ON p_partkey = l_partkey GROUP BY 1
), commits AS (
  SELECT {COMMIT_COLUMNS}, list_filter(fl, lambda x, i: NOT list_contains(fl[1:i - 1], x)) AS files
  FROM orders JOIN commit_lists ON l_orderkey = o_orderkey
), cf AS (
  SELECT repo, hash, ts, subject, unnest(files) AS file, generate_subscripts(files, 1) AS pos FROM commits
)"""


def commits(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    lists = (
        lines.join(files(spark, sf), "p_partkey")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "path"))).alias("fl"))
        .select("l_orderkey", F.array_distinct(F.transform("fl", lambda x: x["path"])).alias("files"))
    )
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", *[c.strip() for c in _split_columns(COMMIT_COLUMNS)])
    out = orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"))
    return out.select("repo", "hash", F.col("ts").cast("timestamp").alias("ts"), "subject", "author", "files")


def _split_columns(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        elif not quoted and c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


FAILURES = [("tests", "test"), ("ship", "deploy"), ("compile", "build"), ("lock", ""), ("nothing", ""), ("go-sum-missing", "build"), ("port-in-use", "")]
OWN_PATTERNS = {"lock": ["go.mod", "package.json"], "nothing": ["no-such-*"]}


# `part` and `lineitem` as source files: one file per part, one line per line item.
SOURCE_PATH = """concat('mod', p_partkey % 25, CASE p_partkey % 7 WHEN 0 THEN '/handlers/h' WHEN 1 THEN '/tests/t' WHEN 2 THEN '/scripts/s' WHEN 3 THEN '/examples/e'
 ELSE '/core/c' END, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '.js' ELSE '.go' END)"""
SOURCE_LINE = """CASE l_linenumber WHEN 1 THEN concat('func handle', l_orderkey % 9, '(input string) {') WHEN 2 THEN concat('\tdb.Query("select ', l_suppkey, '" + input)')
 WHEN 3 THEN concat('\tif ok', l_orderkey % 3, ' { http.Get(input) }') WHEN 4 THEN CASE WHEN l_orderkey % 4 = 0 THEN '\tvalidate(input)' ELSE '}' END
 WHEN 5 THEN CASE WHEN l_orderkey % 90 = 0 THEN '// culprit:ignore raw-query reason=legacy until=2025-01-01' WHEN l_orderkey % 5 = 0 THEN 'const limit = 10' ELSE '}' END
 WHEN 6 THEN CASE WHEN l_orderkey % 2 = 0 THEN '\t// reviewed  by Security' ELSE '\tloop { db.Query(x) }' END ELSE '\tlog.Print("Hot Path")' END"""
SOURCES_SQL = f"""sources AS (
  SELECT concat('r', p_partkey % 3) AS repo, {SOURCE_PATH} AS path, l_orderkey, l_linenumber, l_suppkey, {SOURCE_LINE} AS text
  FROM lineitem JOIN part ON p_partkey = l_partkey
), src AS (
  SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY l_orderkey, l_linenumber, l_suppkey, text) AS line, text AS original FROM sources
)"""


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("r"), F.col("p_partkey") % 3).alias("repo"), F.expr(SOURCE_PATH).alias("path"))
    rows = lines.select("p_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.expr(SOURCE_LINE).alias("text")).join(parts, "p_partkey")
    ordered = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "text")))
    return rows.groupBy("repo", "path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("content"))
