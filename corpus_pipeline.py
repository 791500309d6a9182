"""The training-data pipeline: documents in, tokenised documents out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.functions.storage import release, stored
from culprit.llm import bpe_transducer, entropy_mix, line_dedup, quality_crf, rows, shingle_sets

WORDS, BITS = 5, 4  # of the near-duplicate stage: 60 of 64 bits agree, or four fifths of the shingles


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(rows.packed(docs).alias("row"), rows.doc_number(docs).alias("doc"), F.xxhash64(rows.body(docs)).alias("key"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Without labels of both kinds all stay."""
    labels = rows.table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_crf.train(docs.select("doc_id", "text"), labels.filter(~rows.held_out(F.col("doc_id"))))
    if model is None:
        return docs
    scored = docs.select(rows.packed(docs).alias("row"), quality_crf.score(rows.body(docs).cast("binary"), model).alias("score"))
    return scored.filter(F.col("score") >= quality_crf.CUT).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document already has go; what is left of a text stays."""
    done = line_dedup.dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return done.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays; of several rows of that id the one with the
    smallest text hash, of those with one text the smallest row by its columns in order."""
    groups = shingle_sets.near_copies(docs, WORDS, BITS)
    first = groups.groupBy("group").agg(F.min(F.struct("doc", "key")).alias("one")).select("one.doc", "one.key")
    return _keyed(docs).join(first, ["doc", "key"], "left_semi").groupBy("doc", "key").agg(F.min("row").alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    copies = entropy_mix.mixed(docs).groupBy("doc", "key", "source").agg(F.max("copies").alias("copies")).filter("copies > 0")
    keyed = _keyed(docs).withColumn("from", F.col("row.source").cast("string"))
    same = (keyed["doc"] == copies["doc"]) & (keyed["key"] == copies["key"]) & keyed["from"].eqNullSafe(copies["source"])
    return keyed.join(copies, same).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of what they decode to, for each row."""
    return docs.select("doc_id", bpe_transducer.digests(F.col("text"), keep=False).alias("r")).select("doc_id", "r.*")


STAGES = [("quality", keep_good), ("line_dedup", dedup_lines), ("near_copies", drop_near_copies), ("mix", mix_sources), ("bpe", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = rows.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
            release(*before)
            before = [docs]
    return docs
