"""Readers and writers of corpora, results, fixtures and histories."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from culprit.functions import text as tx
from culprit.operators.labelled import prepare_fixtures
from culprit.sources import files

HISTORY_SCHEMA = "matched BOOLEAN, failure_id STRING, severity STRING"
RESULT_SCHEMA = (
    "fixture_id STRING, source STRING, matched BOOLEAN, failure_id STRING, confidence DOUBLE, evidence ARRAY<STRING>, "
    "duration_ms BIGINT, error STRING, first_line_tag STRING, first_line_snippet STRING, expected_failure_id STRING"
)
CORPUS_SCHEMA = (
    "fixture_id STRING, raw STRING, source STRING, "
    "metadata STRUCT<timestamp: STRING, fields: MAP<STRING, STRING>, line_num: BIGINT>"
)
FIXTURE_SCHEMA = (
    "id STRING, title STRING, fixture_class STRING, raw_log STRING, normalized_log STRING, "
    "expectation STRUCT<expected_playbook: STRING, top_n: INT, expected_stage: STRING, strict_top1: BOOLEAN, "
    "disallowed_playbooks: ARRAY<STRING>, max_unexpected_top_n: INT, min_confidence: DOUBLE>, "
    "source STRUCT<adapter: STRING, provider: STRING, url: STRING, repository: STRING, issue_number: INT, comment_id: STRING>, "
    "review STRUCT<status: STRING, promoted_at: STRING>, fingerprint STRING"
)


def number_rows(df: DataFrame, name: str = "line_num") -> DataFrame:
    """1-based row number within each input file, in file order.

    A block of a file is read by one task, and row ids count up inside a task. So each block needs one number to
    add, found from the counts of the blocks before it: only those counts meet in a window, rows are not sorted.
    """
    block = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}
    d = df.withColumns({**block, "_row": F.monotonically_increasing_id()})
    counts = d.groupBy("_file", "_start").agg(F.min("_row").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1
    return d.join(counts.select("_file", "_start", shift.alias("_shift")), ["_file", "_start"]).withColumn(name, F.col("_row") + F.col("_shift")).drop("_file", "_start", "_row", "_shift")


def read_corpus_csv(
    spark: SparkSession,
    path: str,
    log_field: str,
    id_field: str = "",
    ts_field: str = "",
    join_lines: bool = False,
    source: str | None = None,
) -> DataFrame:
    """Corpus records of CSV files with a header: every other column goes into ``fields``."""
    raw = spark.read.csv(path, header=True, multiLine=True, ignoreLeadingWhiteSpace=True, escape='"', inferSchema=False)
    names = {c.strip(): c for c in raw.columns}
    if log_field not in names:
        raise ValueError(f"log field {log_field!r} not found in header {sorted(names)}")

    def get(name: str) -> Column:
        return F.coalesce(F.col(f"`{names[name]}`"), F.lit("")) if name in names else F.lit("")

    text = get(log_field)
    if not join_lines:
        text = F.regexp_replace(text, "\r\n|\n|\r", " ")
    extras = [n for n in names if n not in (log_field, id_field, ts_field)]
    fields = F.create_map(*[x for n in extras for x in (F.lit(n), get(n))]) if extras else F.create_map().cast("map<string,string>")
    origin = F.lit(source) if source is not None else F.col("_metadata.file_path")
    d = raw.select(
        get(id_field).alias("id"), text.alias("raw"), get(ts_field).alias("timestamp"), fields.alias("fields"), origin.alias("source"), "_metadata"
    )
    return number_rows(d).drop("_metadata")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One log per file; the path is its source."""
    return files.whole_texts(spark, path).withColumnRenamed("value", "text")


def read_json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_history_lines(spark: SparkSession, path: str) -> DataFrame:
    """History lines; broken lines are skipped and a missing file is an empty history."""
    try:
        return spark.read.schema(HISTORY_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], T.StructType.fromDDL(HISTORY_SCHEMA))
        raise


def read_fixtures(spark: SparkSession, path: str, default_class: str = "minimal") -> DataFrame:
    """Labelled fixtures with their effective text, class and fingerprint."""
    d = read_json_table(spark, path, FIXTURE_SCHEMA)
    d = d.withColumn("fixture_class", F.coalesce(F.nullif("fixture_class", F.lit("")), F.lit(default_class)))
    return prepare_fixtures(d)


def write_cluster_samples(clusters: DataFrame, corpus: DataFrame, path: str, log_id: str = "log_id", text: str = "raw") -> None:
    """Texts of the clusters' sample logs, one folder with one file per cluster."""
    files.write_lines(cluster_samples(clusters, corpus, log_id, text), path, "cluster_id", "value")


def read_cluster_samples(spark: SparkSession, path: str) -> DataFrame:
    """``cluster_id, value``: the lines of :func:`write_cluster_samples`."""
    texts = files.whole_texts(spark, path)
    return texts.select(files.key_of(F.col("source"), "cluster_id").alias("cluster_id"), F.explode(files.lines_of(F.col("value"))).alias("value"))


def cluster_samples(clusters: DataFrame, corpus: DataFrame, log_id: str = "log_id", text: str = "raw") -> DataFrame:
    samples = clusters.select("cluster_id", F.explode("sample_ids").alias(log_id))
    return samples.join(corpus.select(log_id, F.col(text).alias("value")), log_id).select("cluster_id", "value")


def input_hashes(logs: DataFrame, log_id: str = "log_id", text: str = "text") -> DataFrame:
    return logs.select(log_id, tx.input_hash(F.col(text)).alias("input_hash"))
