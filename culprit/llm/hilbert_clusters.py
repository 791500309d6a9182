"""Centroid clustering over blocks of a space-filling curve.

Vectors of whole numbers are put in the order of a Hilbert curve through their widest directions and cut
into blocks; every block keeps the smallest and largest value of each component (its box) and the
sum of its vectors. In a round a centroid can own a vector of a block only if its distance to the
box is not above what some centroid surely gives: first the distance to the box's farthest corner,
then, with the vectors read, the largest distance to the centroid nearest to the box. What is left
are the block's candidates, and all its vectors meet them in one exact matrix product. A block with
one candidate adds its stored sum without being unpacked.

A round moves one row of sums for each task and centroid; only the centroids (k times ``dims``
numbers) pass the driver. The directions come from a sample of ``SAMPLE`` vectors and only decide the order of
rows; every vector is in a block and results do not depend on the blocks.

Rules: vectors with another number of components, or with a null or non-finite one, take no part.
Rows with equal ids count each for itself. Equal distances go to the smaller centroid; a centroid
without vectors stays. Start: the ``k`` rows of smallest hash, equal hashes by the vector, null ids
last; fewer rows give fewer centroids. Distances are ``long``: a component beyond 2^27 after scaling
is an error, not a wrong number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culprit.functions.storage import stored
from culprit.llm import rows

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK = 2_048  # vectors in a block
SAMPLE = 4_000
AXES, BITS = 8, 7  # of the curve; their product fits a long
_LARGEST = 1 << 27
_IN_DOUBLES = 1 << 22  # below it all sums of a matrix product of doubles are exact


def kept(df: DataFrame, dims: int = DIMS, scale: int = SCALE, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, v``: usable vectors as arrays of whole numbers."""
    odd = F.exists(df[column], lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = F.coalesce((F.size(df[column]) == dims) & ~odd, F.lit(False))
    v = F.transform(df[column], lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return df.filter(good).select(df[id_column].cast("bigint").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if values.size and np.abs(values).max() >= _LARGEST:
        raise ValueError(f"a component is beyond {_LARGEST} after scaling: squared distances would not fit a long")
    return values.astype(np.int64)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows) whose coordinates have so many bits (Skilling's transform)."""
    x = cells.T.astype(np.int64).copy()
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for row in x:
            flip = (row & high) != 0
            swap = np.where(flip, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(flip, low, swap)
            row ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros_like(turn)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            place = place << 1 | row >> bit & 1
    return place


class Curve:
    """The widest directions of a sample and the range of each, cut into ``2^BITS`` cells."""

    def __init__(self, sample: np.ndarray):
        self.middle = sample.mean(0)
        spread = np.cov((sample - self.middle).T) if len(sample) > 1 else np.eye(sample.shape[1])
        self.axes = np.linalg.eigh(np.atleast_2d(spread))[1][:, ::-1][:, :AXES]
        at = (sample - self.middle) @ self.axes
        self.low, self.width = at.min(0), np.maximum(np.ptp(at, axis=0), 1e-9)

    def places(self, v: np.ndarray) -> np.ndarray:
        at = ((v - self.middle) @ self.axes - self.low) / self.width
        return hilbert((np.clip(at, 0, 1 - 1e-12) * (1 << BITS)).astype(np.int64), BITS)


_BLOCKS = "n int, ids array<bigint>, vectors binary, low array<bigint>, high array<bigint>, total array<bigint>"
_ARROW = pa.schema([("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("total", pa.list_(pa.int64()))])


def blocks(vectors: DataFrame, dims: int = DIMS, size: int = BLOCK) -> DataFrame:
    """The stored zone map of a table ``vec_id, v``."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect()
    curve = Curve(np.array([r["v"] for r in sample]) if sample else np.zeros((1, dims)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            v = matrix(b.column("v"), dims)
            packed = pa.array([x.tobytes() for x in v.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(curve.places(v)), pa.array(np.full(len(v), part, np.int32)), b.column("vec_id"), packed], names=["place", "part", "vec_id", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        data: list = []

        def block() -> dict:
            v = np.frombuffer(b"".join(data), np.int32).reshape(-1, dims)
            return {"n": len(v), "ids": list(ids), "vectors": v.tobytes(), "low": v.min(0).tolist(), "high": v.max(0).tolist(), "total": v.sum(0, dtype=np.int64).tolist()}

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
                ids.append(i)
                data.append(v)
                if len(ids) == size:
                    yield pa.RecordBatch.from_pylist([block()], schema=_ARROW)
                    ids, data = [], []
        if ids:
            yield pa.RecordBatch.from_pylist([block()], schema=_ARROW)

    # equal vectors are told apart by the task that read them, so no place holds more than one range can take
    order = ("place", "part", "vec_id")
    placed = vectors.mapInArrow(keyed, "place bigint, part int, vec_id bigint, v binary")
    return stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _BLOCKS))


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: products of doubles where all sums stay below 2^53, else of integers."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < _IN_DOUBLES * (64 / max(64, v.shape[1])) ** 0.5:
        v, centroids = v.astype(np.float64), centroids.astype(np.float64)
    else:
        v, centroids = v.astype(np.int64), centroids.astype(np.int64)
    return ((v**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2 * v @ centroids.T).astype(np.int64)


def nearest_corner(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (np.maximum(np.maximum(low - centroids, centroids - high), 0) ** 2).sum(1)


def farthest_corner(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (np.maximum(np.abs(low - centroids), np.abs(high - centroids)) ** 2).sum(1)


class Zone:
    """A block next to the centroids."""

    def __init__(self, block: dict, centroids: np.ndarray):
        low, high = np.array(block["low"]), np.array(block["high"])
        self.block, self.centroids = block, centroids
        self.bound = nearest_corner(low, high, centroids)
        self.candidates = np.flatnonzero(self.bound <= farthest_corner(low, high, centroids).min())

    def assign(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vectors, the centroid of each and its distance."""
        v = np.frombuffer(self.block["vectors"], np.int32).reshape(self.block["n"], -1)
        if len(self.candidates) > 1:
            near = self.candidates[self.bound[self.candidates].argmin()]
            reach = distances(v, self.centroids[[near]]).max()
            self.candidates = self.candidates[self.bound[self.candidates] <= reach]
        d = distances(v, self.centroids[self.candidates])
        best = d.argmin(1)  # candidates ascend, so ties go to the smaller centroid
        return v, self.candidates[best], d[np.arange(len(v)), best]


def sums(table: DataFrame, centroids: np.ndarray, inertia: bool = False) -> dict[int, tuple[int, int, list[int]]]:
    """Of every centroid that owns vectors: how many, their distances' sum (if asked for) and their sum."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, far, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for block in b.to_pylist():
                zone = Zone(block, centroids)
                if len(zone.candidates) == 1 and not inertia:
                    count[zone.candidates] += block["n"]
                    total[zone.candidates] += np.array(block["total"])
                    continue
                v, owner, distance = zone.assign()
                for c in np.unique(owner):
                    mine = owner == c
                    count[c] += mine.sum()
                    far[c] += distance[mine].sum()
                    total[c] += v[mine].sum(0, dtype=np.int64)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(far[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "far", "total"])

    parts = table.mapInArrow(run, "cluster int, n bigint, far bigint, total array<bigint>")
    exact = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(dims)]
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("far").cast("decimal(38,0)")).alias("far"), *exact).collect()
    return {r["cluster"]: (r["n"], int(r["far"]), [int(r[f"t{i}"]) for i in range(dims)]) for r in found}


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED, dims: int = DIMS) -> np.ndarray:
    """The vectors of smallest ``sha256("<seed>:<vec_id>")``."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(by.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in first], np.int64).reshape(-1, dims)


def lloyd(table: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds."""
    for _ in range(rounds if len(centroids) else 0):
        after = centroids.copy()
        for c, (n, _, total) in sums(table, centroids).items():
            after[c] = [t // n for t in total]
        if (after == centroids).all():
            break  # so do all later rounds
        centroids = after
    return centroids


_RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Of every vector: ``vec_id, cluster, distance``, and of its centroid the sums of distances and the digest."""
    found = sums(table, centroids, inertia=True) if len(centroids) else {}
    own = np.array([found[c][1] if c in found else 0 for c in range(len(centroids))], np.int64)
    digest = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pylist():
                _, owner, distance = Zone(block, centroids).assign()
                data = [pa.array(block["ids"], pa.int64()), pa.array(owner.astype(np.int32)), pa.array(distance), pa.array(own[owner]), pa.array(np.full(len(owner), own.sum())), pa.array(digest[owner], pa.string())]
                yield pa.RecordBatch.from_arrays(data, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return table.mapInArrow(run, _RESULT)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> DataFrame:
    """Clusters of a table ``vec_id, v`` of whole-number vectors of ``dims`` components."""
    table = blocks(vectors, dims)
    return assigned(table, lloyd(table, first_centroids(vectors, k, seed, dims), rounds))


def op12(spark, sf_dir: str) -> DataFrame:
    return cluster(kept(rows.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def _sql() -> str:
    steps = [
        """WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS MATERIALIZED (SELECT r, vec_id, unnest(v) AS x, unnest(range(64)) AS d FROM k
), c0 AS MATERIALIZED (
  SELECT c, unnest(v) AS x, unnest(range(64)) AS d
  FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM k) WHERE c < 8
)"""
    ]
    for i in range(11):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, arg_min(c, (s, c)) AS c, min(s) AS s
  FROM (SELECT r, vec_id, c, sum((e.x - c{i}.x) * (e.x - c{i}.x))::BIGINT AS s FROM e JOIN c{i} USING (d) GROUP BY ALL) GROUP BY r, vec_id
)""")
        if i < 10:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, d, coalesce(m.x, o.x) AS x
  FROM c{i} o LEFT JOIN (
    SELECT c, d, ((s - ((s % n + n) % n)) // n)::BIGINT AS x FROM (SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM e JOIN a{i} USING (r) GROUP BY c, d)
  ) m USING (c, d)
)""")
    return (
        ", ".join(steps)
        + """, h AS (SELECT c, sha256(string_agg(x, ',' ORDER BY d)) AS centroid_sha256 FROM c10 GROUP BY c)
SELECT vec_id, c::INT AS cluster, s AS distance, (sum(s) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(s) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a10 JOIN h USING (c)
"""
    )


OP12_SQL = _sql()
