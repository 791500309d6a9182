"""Exported repository data: commit logs, diffs, status lines, owner files, source trees, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.functions.text import trim_space
from culprit.sources.files import whole_texts

# --- fixed values: source files and skipped folders, hunk header -------------------------------------------
SOURCE_EXTENSIONS = [".go", ".js", ".jsx", ".ts", ".tsx", ".py", ".java", ".rb", ".php", ".cs", ".kt", ".yaml", ".yml"]
SKIPPED_DIRS = [".git", "node_modules", "vendor", ".venv", "venv"]
HUNK = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
RECORD_SEPARATOR, FIELD_SEPARATOR = "\x1f", "\x1e"
# --- end of fixed values --------------------------------------------------------------------------------------


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Commit-log text with record separators, one commit per row before parsing."""
    d = spark.read.option("lineSep", RECORD_SEPARATOR).text(path)
    return parse_commits(d.withColumnRenamed("value", "block"))


def parse_commits(blocks: DataFrame) -> DataFrame:
    """``block`` texts (header line, then files) to commits; blocks without a valid header are dropped."""
    others = [c for c in blocks.columns if c != "block"]
    b = trim_space(F.col("block"))
    lines = F.split(b, "\n")
    head = F.split(trim_space(F.get(lines, 0)), FIELD_SEPARATOR, 4)
    files = F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda l: F.replace(trim_space(l), F.lit("\\"), F.lit("/"))), lambda f: f != "")
    d = blocks.filter(b != "").select(*others, head.alias("h"), F.array_distinct(files).alias("files"))
    seconds = F.expr("try_cast(trim(get(h, 1)) AS BIGINT)")
    return d.filter(F.size("h") >= 3).withColumn("s", seconds).filter("s IS NOT NULL").select(
        *others, trim_space(F.get("h", 0)).alias("hash"), F.timestamp_seconds("s").alias("ts"),
        trim_space(F.get("h", 2)).alias("subject"), F.coalesce(trim_space(F.get("h", 3)), F.lit("")).alias("author"), "files",
    )


def diff_lines(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """Changed lines of unified diffs: one row per (file, new line number)."""
    others = [c for c in diffs.columns if c != text]
    t = F.regexp_replace(F.concat(F.lit("\n"), F.col(text)), "\r\n?", "\n")
    parts = F.split(t, r"\n\+\+\+ ")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    d = diffs.select(*others, F.explode(parts).alias("p"))
    path = trim_space(F.substring_index("p", "\n", 1))
    path = F.regexp_replace(F.regexp_replace(path, "^a/", ""), "^b/", "")
    starts = F.regexp_extract_all("p", F.lit(HUNK), F.lit(1))
    counts = F.regexp_extract_all("p", F.lit(HUNK), F.lit(2))
    d = d.select(*others, path.alias("file"), F.explode(F.arrays_zip(starts.alias("s"), counts.alias("c"))).alias("h"))
    d = d.filter("file NOT IN ('', '/dev/null')").select(
        *others, "file", F.col("h.s").cast("bigint").alias("s"), F.when(F.col("h.c") == "", 1).otherwise(F.col("h.c").cast("bigint")).alias("c")
    )
    rows = d.filter("s > 0 AND c > 0").select(*others, "file", F.explode(F.sequence("s", F.col("s") + F.col("c") - 1)).alias("line"))
    return rows.distinct()


def status_files(lines: DataFrame, line: str = "line") -> DataFrame:
    """Short status lines to ``(file, status)``; a rename counts under its new name."""
    others = [c for c in lines.columns if c != line]
    l = F.regexp_replace(F.col(line), "\r+$", "")
    code = F.trim(F.substring(l, 1, 2))
    path = trim_space(F.substring(l, F.lit(4), F.length(l)))
    path = F.replace(F.substring_index(path, " -> ", -1), F.lit("\\"), F.lit("/"))
    status = F.when(F.rlike(code, F.lit("[?A]")), "added").when(F.contains(code, F.lit("D")), "deleted").otherwise("modified")
    kept = lines.filter((trim_space(l) != "") & (F.octet_length(l) >= 4))
    return kept.select(*others, path.alias("file"), status.alias("status")).filter("file <> ''")


def change_set(status: DataFrame, diff: DataFrame) -> DataFrame:
    """``changes(repo, file, status, line)``: files of the status list and of the diff; a file without
    changed lines keeps one row with a NULL line."""
    both = status.join(diff, ["repo", "file"], "full_outer")
    return both.select("repo", "file", F.coalesce("status", F.lit("modified")).alias("status"), "line")


def owner_rules(texts: DataFrame, text: str = "text") -> DataFrame:
    """Owner files to ordered rules; blank lines, comments and lines without an owner are skipped."""
    others = [c for c in texts.columns if c != text]
    d = texts.select(*others, F.posexplode(F.split(F.col(text), "\r?\n")).alias("idx", "l")).withColumn("l", trim_space(F.col("l")))
    d = d.filter("l <> ''").filter(~F.startswith("l", F.lit("#"))).withColumn("f", F.split("l", r"[\s]+")).filter(F.size("f") >= 2)
    return d.select(*others, "idx", F.get("f", 0).alias("pattern"), F.slice("f", F.lit(2), F.size("f")).alias("owners"))


def is_source_path(path: Column) -> Column:
    """True for source files outside skipped folders."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return ext.isin(SOURCE_EXTENSIONS) & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIPPED_DIRS]))


def read_source_tree(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """``files(repo, path, content)`` below a folder, with slash paths relative to it."""
    base = root.rstrip("/").split("://")[-1].lstrip("/")

    def rel(full: Column) -> Column:
        return F.substring_index(full, base + "/", -1)

    d = whole_texts(spark, root, lambda full: is_source_path(rel(full)))
    return d.select(F.lit(repo).alias("repo"), rel(F.col("source")).alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("content"))


def join_run_parts(parts: DataFrame, key: str = "run_id") -> DataFrame:
    """Multi-part run logs ``(key, name, body)`` to one log per run, parts in name order."""
    body = F.replace("body", F.lit("\r\n"), F.lit("\n"))
    ended = F.when(F.endswith(body, F.lit("\n")), body).otherwise(F.concat(body, F.lit("\n")))
    rows = parts.select(key, "name", ended.alias("b"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", "b"))).alias("p")).select(
        key, F.array_join(F.transform("p", lambda x: x["b"]), "\n").alias("text")
    )
