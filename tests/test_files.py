"""Folders of very many small files."""

import gzip

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from culprit.plans import io as plans_io
from culprit.sources import corpus, files
from culprit.sources import repository as rp

ODD_NAMES = ["a b.go", "p%20.go", "ü.go", "x+y=z&a,b;c@d!~'()*$.go", "q#r?.go", "br[a]{c}.go", "back\\s^`|<>\".go", "nb sp.go", "t\tab.go", "_hid.go", "_h=1.go", ".dot.go", "e.go._COPYING_",
             "_metadata.go", "_metadata_d/in.go", "_hd/in.go", "s/.git/x.py", "s/vendor/v.py", "s/deep/er/c.py", "s/_x=1/d.py"]


def both_ways(monkeypatch, run):
    """Rows by way of tasks, and by way of Spark's own readers and writers."""
    out = [sorted(map(str, run().collect()))]
    with monkeypatch.context() as m:
        m.setattr(files, "local_path", lambda *_: None)
        out.append(sorted(map(str, run().collect())))
    return out


def test_texts_of_a_folder_are_those_that_spark_reads(spark, tmp_path, monkeypatch):
    for n in ODD_NAMES:
        (tmp_path / "in" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / n).write_bytes(n.encode() + b"\r\n\r\x00\xff last")
    (tmp_path / "in/empty.go").write_text("")
    root = str(tmp_path / "in")
    for spread in (files.SPREAD, 3):
        monkeypatch.setattr(files, "SPREAD", spread)
        for run in (lambda: corpus.read_logs(spark, root).withColumn("n", F.hex("text")), lambda: rp.read_source_tree(spark, root + "/", "r"), lambda: corpus.read_logs(spark, root + "/s*")):
            mine, sparks = both_ways(monkeypatch, run)
            assert mine == sparks and len(mine) > 2
    with gzip.open(tmp_path / "in/s/packed.log.gz", "wb") as f:
        f.write(b"unpacked")
    assert "unpacked" in {r["text"] for r in corpus.read_logs(spark, root).collect()}
    with pytest.raises(AnalysisException):
        corpus.read_logs(spark, root + "/none")


def test_lines_by_key_are_those_that_spark_writes(spark, tmp_path, monkeypatch):
    texts = [None, "", "  a b ", 'q"uo\\te', "#c", "a\nb\r\nc\rd\n", "x\r", "ü\t", "é f", "\n"]
    keys = [None, "", "a/b", "%41=é ", "x y+z", "plain", "p#?", "-1"]
    df = spark.createDataFrame([(k, t, i) for k in keys for i, t in enumerate(texts)] + [("only null", None, 0)], "k string, t string, o int").repartition(5)
    for extension in ("", "php"):
        at = iter([f"{tmp_path}/{extension}{i}" for i in range(2)])

        def run(extension=extension, at=at):
            path = next(at)
            files.write_lines(df, path, "k", "t", ["o"], extension)
            d = files.whole_texts(spark, path)
            return d.select(files.key_of(F.col("source"), "k").alias("k"), F.hex("value"), files.lines_of(F.col("value")).alias("l"))

        mine, sparks = both_ways(monkeypatch, run)
        assert mine == sparks and len({r.split(", hex")[0] for r in mine}) == 8 - bool(extension)  # "" and NULL share a folder; of NULLs alone a CSV file is empty
        lines = spark.read.text(f"{tmp_path}/{extension}0").filter("k = 'plain'").select("value")
        mine = files.whole_texts(spark, f"{tmp_path}/{extension}0", lambda s: files.key_of(s, "k") == "plain")
        assert sorted(map(str, lines.collect())) == sorted(map(str, mine.select(F.explode(files.lines_of(F.col("value"))).alias("value")).collect()))
        assert not list(tmp_path.rglob(".part*"))
        with pytest.raises(FileExistsError):
            files.write_lines(df, f"{tmp_path}/{extension}0", "k", "t")


def test_very_many_files_are_not_listed_on_the_driver(spark, tmp_path, monkeypatch):
    """Nor written by Hadoop's file system, which starts processes for each."""

    def no(*_, **__):
        raise AssertionError

    docs, part = [(i, f"text {i}\nof {i % 7}") for i in range(60)], [(i, f"part {i}") for i in range(45)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(part, "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    clusters = spark.createDataFrame([("cluster-001", [1, 2]), ("cluster-002", [3])], "cluster_id string, sample_ids array<bigint>")
    for name in ("text", "csv"):
        monkeypatch.setattr(DataFrameWriter, name, no)
    logs, tree = plans_io.log_files(spark, str(tmp_path)), plans_io.source_tree_files(spark, str(tmp_path))
    corpus.write_cluster_samples(clusters, spark.createDataFrame(docs, "log_id bigint, raw string"), str(tmp_path / "out"))
    samples = corpus.read_cluster_samples(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, logs.collect())) == [(i, t + "\n") for i, t in docs]
    assert sorted(map(tuple, tree.collect())) == [(k, "".join(f"{t}\n" for i, t in part if i // 10 == k)) for k in range(5)]
    assert sorted(map(tuple, samples.collect())) == sorted((f"cluster-{c:03d}", l) for c, i in ((1, 1), (1, 2), (2, 3)) for l in docs[i][1].split("\n"))
    for d in (logs, tree, samples):
        assert "FileScan" not in d._jdf.queryExecution().executedPlan().toString()
