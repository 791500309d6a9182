"""Incremental forms of the batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from culprit.functions import text as tx
from culprit.functions.storage import is_folder
from culprit.operators.match import evaluate_logs
from culprit.operators.rules import RuleSet


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few files per batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream; in one batch unless ``files_per_batch`` says otherwise."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)  # a stream reads folders only
    return reader.option("pathGlobFilter", name).parquet(folder)


def dedupe_stream(logs: DataFrame, text: str = "text", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First log of each content id; ids are forgotten once the watermark passes them."""
    keyed = logs.withColumn("fixture_id", tx.content_id(F.col(text)))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["fixture_id"])


def evaluate_stream(
    logs: DataFrame, rule_set: RuleSet, sink: Callable[[DataFrame, int], None], log_id: str = "log_id", text: str = "text", source: str | None = None
) -> DataStreamWriter:
    """Diagnose each micro-batch with the static rules; ``sink(results, batch_id)`` stores it.

    Ranking needs windows that a stream refuses, so it happens per batch; a log is one row and
    never crosses batches, which makes the result equal to the batch answer.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        sink(evaluate_logs(batch, rule_set, log_id, text, source), batch_id)

    return logs.writeStream.foreachBatch(run)


def recurrence_stream(findings: DataFrame) -> DataFrame:
    """Running first seen, last seen and count per signature (update mode)."""
    return (
        findings.filter("rank = 1")
        .groupBy("signature_hash")
        .agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count("*").alias("occurrence_count"))
    )


def upsert_versions(folder: str) -> Callable[[DataFrame, int], None]:
    """Sink for :func:`recurrence_stream`: append changed rows with their batch number.

    A replayed batch overwrites its own folder, so a restart does not add rows twice;
    :func:`latest_versions` reads the merged table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def latest_versions(spark: SparkSession, folder: str, key: str = "signature_hash") -> DataFrame:
    d = spark.read.parquet(folder).drop("batch")
    others = [c for c in d.columns if c not in (key, "version")]
    return d.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("r")).select(key, "r.*")


def windowed_counts(runs: DataFrame, ts: str = "ts", length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Runs and matched runs per time window and failure; windows appear once the watermark closes them."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        runs.withWatermark(ts, delay)
        .groupBy(w.alias("w"), "failure_id")
        .agg(F.count("*").alias("n"), F.sum(F.col("matched").cast("bigint")).alias("n_matched"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failure_id", "n", "n_matched")
    )


def failure_sessions(findings: DataFrame, ts: str = "seen_at", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Bursts of one signature separated by quiet gaps."""
    return (
        findings.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("s"), "signature_hash")
        .agg(F.count("*").alias("n"))
        .select("signature_hash", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
    )


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything there is, then stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def drain_to_table(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run an append-mode stream to its end into Parquet and read the result."""
    run_available(stream.writeStream.format("parquet").outputMode("append").option("path", folder), checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
