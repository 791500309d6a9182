"""Exact top-k by inner product over a pivot-distance index.

Vectors get one more coordinate, the root of ``M^2 - |x|^2`` with M the largest norm, and queries a
zero there; then the nearest vectors are those of the largest inner product. Every vector is keyed
by its nearest pivot and its distance to it, and the sorted keys are cut into annuli: blocks of
neighbouring distances around one pivot. Queries are blocks of the same order, so the queries of a
block lie near each other. Each query block first takes the annuli around its own place, which gives
every query a k-th distance; then only annuli whose triangle-inequality bound reaches that
distance are read, nearest bound first, and the scan of a block stops when no later annulus can
hold anything better.

The index holds every vector, so results are exact (recall 1); only the pivots come from a sample of
bounded size. Components are ``floor(scale * x)`` in double precision and scores are whole numbers.

Rules: vectors that are null, empty or hold null or non-finite components take no part; shorter
vectors count as filled with zeros; rows that share an id count once, with their smallest vector;
ties go to the smaller id; a query never finds its own id; with fewer candidates than k all come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from culprit.functions.storage import stored
from culprit.functions.tables import small_table
from culprit.llm import rows

K, SCALE, EVERY = 20, 64, 20
PIVOTS = 32  # and the sample that they are chosen from
SAMPLE = 2_000
BLOCK = 4_096  # vectors in an annulus
QUERY_BLOCK = 1_024
SLICE = 16  # annuli that one task takes for a query block
_SLACK = 1e-6


def usable(embedding: Column) -> Column:
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~odd & (F.size(embedding) > 0), F.lit(False))


def whole_numbers(df: DataFrame, scale: int = SCALE, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, v``: usable vectors, one for each id, as arrays of whole numbers."""
    v = F.transform(df[column], lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return df.filter(usable(df[column]) & df[id_column].isNotNull()).select(df[id_column].cast("bigint").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist() if isinstance(column, pa.Array) else column):
        out[i, : len(v)] = v
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Far-apart members of the sample: each next pivot is the one farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        far = int(nearest.argmax())
        if nearest[far] <= 0:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, ((sample - sample[far]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T))


class Space:
    """Width, largest squared norm and pivots: what every task needs, of fixed size."""

    def __init__(self, width: int, square: float, pivots: np.ndarray):
        self.width, self.square, self.pivots = width, square, pivots
        #: How whole numbers travel: no component is larger than the root of ``square``.
        self.kind = np.int16 if square < 2**30 else np.int32 if square < 2**62 else np.float64

    def packed(self, v: np.ndarray) -> bytes:
        return v.astype(self.kind).tobytes()

    def unpacked(self, data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(n, -1).astype(np.float64)

    def points(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(0.0, self.square - (v**2).sum(1)))[:, None]])

    def queries(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.zeros((len(v), 1))])


def _keyed(space: Space, is_query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), space.width)
            d = distances(space.queries(v) if is_query else space.points(v), space.pivots)
            pivot = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot]), b.column("vec_id"), pa.array([space.packed(x) for x in v], pa.binary())], names=["pivot", "distance", "vec_id", "v"])

    return run


_BLOCK = "block bigint, pivot int, near double, far double, n int, ids binary, vectors binary, low array<double>, high array<double>"


def _blocks(space: Space, size: int, is_query: bool):
    """Cuts sorted rows into blocks. For queries ``low`` and ``high`` are their distances to every pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(pivot: int, members: list) -> dict:
            nonlocal number
            number += 1
            data = b"".join(m[2] for m in members)
            d = distances(space.queries(space.unpacked(data, len(members))), space.pivots) if is_query else None
            return {
                "block": (part << 32) | number, "pivot": pivot, "near": members[0][0], "far": members[-1][0], "n": len(members), "ids": np.array([m[1] for m in members], np.int64).tobytes(), "vectors": data,
                "low": d.min(0).tolist() if is_query else [], "high": d.max(0).tolist() if is_query else [],
            }

        schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        for b in batches:
            done = []
            for p, d, i, v in zip(b.column("pivot").to_pylist(), b.column("distance").to_pylist(), b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
                if p not in held:
                    done += [block(k, m) for k, m in held.items()]
                    held = {p: []}
                held[p].append((d, i, v))
                if len(held[p]) == size:
                    done.append(block(p, held.pop(p)))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([block(k, m) for k, m in held.items()], schema=schema)

    return run


class Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, kth: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score = np.full((len(ids), 0), -np.inf)
        self.found = np.zeros((len(ids), 0), np.int64)
        self.kth = np.full(len(ids), -np.inf) if kth is None else kth  # a score that k candidates are known to reach

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        score = self.vectors @ vectors.T
        score[self.ids[:, None] == ids[None, :]] = -np.inf
        score = np.hstack([self.score, score])
        found = np.hstack([self.found, np.broadcast_to(ids, (len(self.ids), len(ids)))])
        if score.shape[1] > self.k:
            edge = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1]
            # all that reach the k-th score, then the smaller ids among its ties
            order = np.lexsort((found, -score), axis=1)[:, : self.k] if score.shape[1] <= 4 * self.k else None
            if order is None:
                keep = score >= edge[:, None]
                most = int(keep.sum(1).max())
                first = np.argsort(~keep, axis=1, kind="stable")[:, :most]
                score, found = np.take_along_axis(score, first, 1), np.take_along_axis(found, first, 1)
                order = np.lexsort((found, -score), axis=1)[:, : self.k]
            score, found = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)
            self.kth = np.maximum(self.kth, score[:, -1])
        self.score, self.found = score, found

    def rows(self) -> dict[str, np.ndarray]:
        ok = np.isfinite(self.score) & (self.score >= self.kth[:, None])
        q, _ = np.nonzero(ok)
        return {"query_id": self.ids[q], "vec_id": self.found[ok], "score": self.score[ok].astype(np.int64)}


def _search(space: Space, k: int, seeding: bool):
    """Over rows sorted by (query block, slice, bound). Seeding gives ``query_id, kth``; else candidates."""
    names = ["query_id", "kth"] if seeding else ["query_id", "vec_id", "score"]

    def radius(best: Best) -> float:
        """No candidate farther than this from its query can matter to any query of the block."""
        square = (best.vectors**2).sum(1) + space.square - 2 * best.kth
        return math.sqrt(max(0.0, float(square.max()))) if np.isfinite(best.kth).all() else math.inf

    def out(best: Best) -> pa.RecordBatch:
        data = {"query_id": best.ids, "kth": best.kth} if seeding else best.rows()
        return pa.RecordBatch.from_arrays([pa.array(data[n]) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, reach = None, None, math.inf
        for b in batches:
            for r in b.to_pylist():
                if (r["q"], r["slice"]) != at:
                    if best is not None:
                        yield out(best)
                    at = r["q"], r["slice"]
                    kth = None if r["kths"] is None else np.array(r["kths"])
                    ids = np.frombuffer(r["q_ids"], np.int64)
                    best = Best(ids, space.unpacked(r["q_vectors"], len(ids)), k, kth)
                    reach = radius(best)
                if r["bound"] > reach * (1 + _SLACK) + _SLACK:
                    continue  # as all later annuli of this slice
                ids = np.frombuffer(r["ids"], np.int64)
                best.add(ids, space.unpacked(r["vectors"], len(ids)))
                reach = radius(best)
        if best is not None:
            yield out(best)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for tables ``vec_id, v`` (see ``whole_numbers``)."""
    spark = vectors.sparkSession
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    seen = vectors.agg(F.max(F.size("v")).alias("width"), F.max(squared).alias("square")).first()
    width, square = seen["width"] or 1, seen["square"] or 0.0
    sample = _matrix(pd.Series([r["v"] for r in vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").collect()]), width)
    space = Space(width, square, np.zeros((1, width + 1)))
    if len(sample):
        space.pivots = choose_pivots(space.points(sample), PIVOTS)

    def index(df: DataFrame, size: int, is_query: bool) -> DataFrame:
        keyed = df.mapInArrow(_keyed(space, is_query), "pivot int, distance double, vec_id bigint, v binary")
        return stored(keyed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id").mapInArrow(_blocks(space, size, is_query), _BLOCK))

    annuli, asked = index(vectors, block, False), index(queries, query_block, True)
    # bounds of blocks only: one row for each BLOCK vectors meets one row for each QUERY_BLOCK queries
    a = annuli.select(F.col("block").alias("a"), "pivot", "near", "far")
    q = asked.select(F.col("block").alias("q"), "low", "high")
    lows = q.select("q", F.posexplode("low").alias("pivot", "low"), "high").select("q", "pivot", "low", F.get("high", F.col("pivot")).alias("high"))
    bound = F.greatest(F.lit(0.0), F.col("near") - F.col("high"), F.col("low") - F.col("far"))
    bounds = stored(a.join(lows, "pivot").select("a", "q", bound.alias("bound")))
    body = annuli.select(F.col("block").alias("a"), "ids", "vectors")
    side = asked.select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def scan(pairs: DataFrame, kths: DataFrame, seeding: bool) -> DataFrame:
        own = side.join(kths, "q", "left")
        ready = pairs.join(body, "a").join(own, "q").repartition("q", "slice").sortWithinPartitions("q", "slice", "bound", "a")
        return ready.mapInArrow(_search(space, k, seeding), "query_id bigint, kth double" if seeding else "query_id bigint, vec_id bigint, score bigint")

    order = F.row_number().over(W.partitionBy("q").orderBy("bound", "a"))
    none = small_table(spark, [], {"q": "bigint"}).withColumn("kths", F.expr("cast(null as array<double>)"))
    first = bounds.withColumn("at", order).filter(F.col("at") <= 2).select("a", "q", "bound", F.lit(0).alias("slice"))
    seeds = stored(scan(first, none, True))
    # of each query its k-th score so far, in the order of its block
    q_ids = asked.select(F.col("block").alias("q"), F.posexplode(F.arrow_udf(lambda x: pa.array([np.frombuffer(i, np.int64) for i in x.to_pylist()], pa.list_(pa.int64())), "array<bigint>")("ids")).alias("at", "query_id"))
    kths = stored(q_ids.join(seeds, "query_id").groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "kth"))), lambda x: x["kth"]).alias("kths")))
    norms = queries.select(F.col("vec_id").alias("query_id"), squared.alias("square"))
    reach = stored(q_ids.join(seeds, "query_id").join(norms, "query_id").groupBy("q").agg(F.max(F.sqrt(F.greatest(F.lit(0.0), F.col("square") + square - 2 * F.col("kth")))).alias("reach")))
    wanted = bounds.join(reach, "q").filter(F.col("bound") <= F.col("reach") * (1 + _SLACK) + _SLACK)
    sliced = wanted.withColumn("slice", F.pmod(F.xxhash64("a"), F.ceil(F.count("*").over(W.partitionBy("q")) / SLICE)).cast("int")).select("a", "q", "bound", "slice")
    found = scan(sliced, kths, False)
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    vectors = stored(whole_numbers(rows.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


OP7_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20
"""
