"""What near copies of long texts cost, and what a run leaves behind."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from culprit.llm import shingle_sets


def sets(rng):
    """Sets in threes: one, one nearly like it, one of its own; of sizes about the powers of two."""
    for n in (3, 900, 1024, 1025, 1200, 2047, 2048, 2049, 3000, 4100, 9000):
        one = np.array(rng.sample(range(1 << 62), n), np.uint64)
        near = np.concatenate([one[: n - n // 12], np.array(rng.sample(range(1 << 62), n // 12), np.uint64)])
        fewer = one[: -(-4 * n // 5)]
        for s in (one, near, fewer, np.array(rng.sample(range(1 << 62), n + n // 9), np.uint64)):
            yield np.unique(s)


def alike(s, t):
    both = len(np.intersect1d(s, t))
    return 10 * both >= 8 * (len(s) + len(t) - both)


def test_marks_leave_few_pairs_of_long_texts_open(spark):
    """Each pair that is open has two whole sets shuffled; pairs of unlike sets grow with the square of the texts."""
    every = list(sets(random.Random(5)))
    rows = [(i, len(s), *([int(x) for x in m(s)] for m in (shingle_sets.mark, shingle_sets.wide_mark))) for i, s in enumerate(every)]
    nodes = spark.createDataFrame(rows, "node bigint, n int, mark array<bigint>, wide array<bigint>")
    near = [(i, j) for i in range(len(every)) for j in range(i) if 4 * len(every[i]) <= 5 * len(every[j]) and 4 * len(every[j]) <= 5 * len(every[i])]
    pairs = spark.createDataFrame(near, "a bigint, b bigint")
    open_pairs = {tuple(r) for r in shingle_sets._roomy(pairs, nodes).collect()}
    wanted = {(i, j) for i, j in near if alike(every[i], every[j])}
    assert len(wanted) >= 20 and wanted <= open_pairs
    unlike = {(i, j) for i, j in near if not len(np.intersect1d(every[i], every[j])) and len(every[i]) > 64 * shingle_sets.MARK < len(every[j])}
    assert len(unlike) > 30 and not unlike & open_pairs


def test_long_near_copies_are_grouped(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(50_000)}" for _ in range(1500)] for _ in range(4)]
    texts = [" ".join(w) for w in base]
    texts += [" ".join([*w[:700], "changed", *w[701:], f"tail{i}"]) for i, w in enumerate(base[:3])] + ["short text of few words", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    groups = {r["doc"]: r["group"] for r in shingle_sets.near_copies(docs, 5, 0).collect()}
    together = {frozenset(d for d in groups if groups[d] == g) for g in groups.values()}
    assert together == {frozenset(x) for x in ((0, 4), (1, 5), (2, 6), (3,), (7,), (8, 9))}


def test_a_stage_that_is_done_leaves_no_table_behind(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"t{i}") for i in range(9)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tables, real = [], corpus_pipeline.stored
    monkeypatch.setattr(corpus_pipeline, "stored", lambda d: tables.append(real(d)) or tables[-1])
    stage = lambda spark, docs, sf: docs.filter(F.col("doc_id") > 0).withColumn("doc_id", F.col("doc_id") - 1)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{i}", stage) for i in range(4)])
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["text"] for r in done.collect()) == [f"t{i}" for i in range(4, 9)]
    assert [os.path.exists(t.stored_at.removeprefix("file:")) for t in tables] == [False, False, True]
