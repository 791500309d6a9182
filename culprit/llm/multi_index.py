"""Hard negatives by exact search in an inverted multi-index.

Vectors are cut into two halves, each half has a codebook, and a pair of codewords is a cell. The inner
product of an anchor with any vector of a cell is at most the sum of two half scores: anchor half by
codeword, plus length of the anchor half times radius of the cell in that half. A heap walks the two
sorted lists of half bounds (the multi-sequence walk), so cells come in falling order of the sum.
The walk of a block of anchors stops when no later cell can reach any of its open windows: each
window has its rows and the last of them is not below the bound, or the bound is below the window.

The rows of a cell are cut into blocks, neighbouring blocks form a shard of bounded size. Anchor
blocks travel to the shards that hold cells they need; a shard with many of them is repeated for groups
of anchor blocks. Each search runs twice: at the one best shard first, which gives thresholds, then
wherever these leave something open. The first search finds the positives of all anchors, the second
one the negatives of all windows.

The index holds every row, so results are exact; only the codebooks come from a sample of ``SAMPLE`` rows.
The driver sees that sample and one row for each cell: at most ``WORDS`` times ``WORDS``.

Rules: rows with a null id or label, a null vector or a null or non-finite component take no part.
Shorter vectors count as filled with zeros. Rows with equal ids, and equal rows, count each for
itself: an anchor never meets its own row, but may meet another row of its id. Ties go to the
smaller id. With fewer rows all are given. Scores are exact integers: a component beyond 2^26 after
scaling is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from culprit.functions.storage import stored
from culprit.llm import rows

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
LOW, HIGH = 50, 95  # hundredths of the positive's score
WORDS = 256
CELL = 512  # rows that a cell should have on average; fewer words for small tables
SAMPLE = 8_000
BLOCK = 2_048
SHARD = 32  # blocks
ANCHORS = 256  # in an anchor block
GROUP = 256  # anchor blocks that one copy of a shard serves
_LARGEST = 1 << 26


def usable(df: DataFrame, label: Column, scale: int = SCALE, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, vectors as whole numbers."""
    odd = F.exists(df[column], lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    v = F.transform(df[column], lambda x: F.floor(x.cast("double") * scale).cast("double"))
    good = F.coalesce(~odd, F.lit(False)) & df[id_column].isNotNull() & label.isNotNull()
    return df.filter(good).select(df[id_column].cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), v.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if values.size and np.abs(values).max() >= _LARGEST:
        raise ValueError(f"a component is beyond {_LARGEST} after scaling: scores would not be exact")
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def codebook(sample: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """Codewords of the halves of a sample: means of the members next to each, from far-apart members on."""
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < words and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    code = sample[chosen]
    for _ in range(rounds):
        own = nearest(sample, code)[0]
        code = np.array([sample[own == c].mean(0) if (own == c).any() else code[c] for c in range(len(code))])
    return code


def nearest(x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codeword next to each row and how far it is."""
    own = ((code**2).sum(1)[None, :] - 2 * x @ code.T).argmin(1)
    return own, np.sqrt(((x - code[own]) ** 2).sum(1))


def falling_sums(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All ``first[i] + second[j]`` in falling order, with i and j: the multi-sequence walk."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)] if len(a) and len(b) else []
    while heap:
        bound, x, y = heapq.heappop(heap)
        yield -bound, int(a[x]), int(b[y])
        if y + 1 < len(b):
            heapq.heappush(heap, (-(first[a[x]] + second[b[y + 1]]), x, y + 1))
        if y == 0 and x + 1 < len(a):
            heapq.heappush(heap, (-(first[a[x + 1]] + second[b[0]]), x + 1, 0))


class Space:
    """Width, longest vector and codebooks: what every task needs, of bounded size."""

    def __init__(self, width: int, longest: float, first: np.ndarray, second: np.ndarray):
        self.width, self.half, self.longest = width, (width + 1) // 2, longest
        self.first, self.second = first, second
        self.kind = np.int16 if longest < 2**15 else np.int32

    def unpacked(self, data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(n, self.width).astype(np.float64)


class Windows:
    """The open windows of a block of anchors: each has an anchor, a lowest and highest score, and the best rows so far."""

    def __init__(self, block: dict, state: list | None, width: int, keep: int):
        n = block["n"]
        self.keep = keep
        #: Without a state everything is open; with one, only what it names.
        self.low = np.full((n, width), np.inf if state is not None else -np.inf)
        self.high = np.full((n, width), -np.inf if state is not None else np.inf)
        for s in state or ():
            self.low[s["pos"], s["w"]], self.high[s["pos"], s["w"]] = s["low"], s["high"]
        self.last = np.full((n, width), np.iinfo(np.int64).max)  # id of the last row that counts, at score ``low``
        self.found = {k: np.zeros(0, np.int64) for k in ("pos", "w", "vec_id", "rid", "score")}

    def floor(self) -> np.ndarray:
        """The score below which an anchor needs nothing more; infinite where no window is open."""
        return np.where(self.low <= self.high, self.low, np.inf).min(1)

    def ceiling(self) -> np.ndarray:
        return self.high.max(1)

    def add(self, at: np.ndarray, score: np.ndarray, fits: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        """Scores of some anchors (rows) with the rows of an index block (columns)."""
        new: dict[str, list] = {k: [] for k in self.found}
        for w in range(self.low.shape[1]):
            low = self.low[at, w][:, None]
            inside = fits & (score <= self.high[at, w][:, None]) & ((score > low) | (score == low) & (ids[None, :] < self.last[at, w][:, None]))
            if score.shape[1] > self.keep:  # no more than those that reach the last score that can count here
                edge = np.partition(np.where(inside, score, -np.inf), -self.keep, axis=1)[:, -self.keep]
                inside &= score >= edge[:, None]
            a, c = np.nonzero(inside)
            for k, v in zip(new, (at[a], np.full(len(a), w), ids[c], rids[c], score[a, c].astype(np.int64)), strict=True):
                new[k].append(v)
        if not sum(map(len, new["pos"])):
            return
        all_rows = {k: np.concatenate([self.found[k], *new[k]]) for k in new}
        order = np.lexsort((all_rows["rid"], all_rows["vec_id"], -all_rows["score"], all_rows["w"], all_rows["pos"]))
        all_rows = {k: v[order] for k, v in all_rows.items()}
        group = all_rows["pos"] * self.low.shape[1] + all_rows["w"]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
        self.found = {k: v[rank < self.keep] for k, v in all_rows.items()}
        full = rank == self.keep - 1
        pos, w = all_rows["pos"][full], all_rows["w"][full]
        self.low[pos, w], self.last[pos, w] = all_rows["score"][full], all_rows["vec_id"][full]


class Walk:
    """A block of anchors on its way through cells."""

    def __init__(self, space: Space, block: dict, windows: Windows):
        self.space, self.windows = space, windows
        self.v = space.unpacked(block["vectors"], block["n"])
        a, b = self.v[:, : space.half], self.v[:, space.half :]
        self.at = a @ space.first.T, b @ space.second.T
        self.lengths = np.sqrt((a**2).sum(1)), np.sqrt((b**2).sum(1))
        self.slack = 1e-6 + 1e-9 * np.sqrt((self.v**2).sum(1)) * space.longest

    def cells(self, radius: dict[tuple[int, int], tuple[float, float]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        """The cells that some anchor needs, most promising sum first, each with the anchors that need it."""
        words = sorted({i for i, _ in radius}), sorted({j for _, j in radius})
        least = np.maximum(self.windows.floor(), -1.0 - 2 * np.sqrt((self.v**2).sum(1)) * self.space.longest)
        if not np.isfinite(least).any():
            return
        open_ = np.isfinite(least)
        bounds = []
        for half in (0, 1):
            widest = {}
            for cell, r in radius.items():
                widest[cell[half]] = max(widest.get(cell[half], 0.0), r[half])
            r = np.array([widest[x] for x in words[half]])
            bounds.append(self.at[half][open_][:, words[half]] + self.lengths[half][open_][:, None] * r)
        first, second = (bounds[0] - least[open_][:, None]).max(0), bounds[1].max(0)
        slack = self.slack.max()
        for excess, x, y in falling_sums(first, second):
            floor = self.windows.floor()
            if excess + slack < (floor - least)[open_].min():
                return  # every window is settled: no later cell reaches any
            cell = words[0][x], words[1][y]
            if cell in radius:
                middle = self.at[0][:, cell[0]] + self.at[1][:, cell[1]]
                reach = self.lengths[0] * radius[cell][0] + self.lengths[1] * radius[cell][1] + self.slack
                needing = np.flatnonzero((middle + reach >= floor) & (middle - reach <= self.windows.ceiling()))
                if len(needing):
                    yield cell, needing


_INDEX = "block bigint, shard bigint, i int, j int, r1 double, r2 double, n int, ids array<bigint>, labels array<bigint>, vectors binary"
_ANCHORS = "q bigint, n int, rids array<bigint>, ids array<bigint>, labels array<bigint>, vectors binary"


def _arrow(spec: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


def make_space(vectors: DataFrame) -> Space:
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    seen = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("longest")).first()
    width = max(seen["width"] or 1, 1)
    sample = vectors.orderBy(F.xxhash64("vec_id", "label", "v")).limit(SAMPLE).select("v").collect()
    x = np.zeros((max(len(sample), 1), width))
    for at, r in enumerate(sample):
        x[at, : len(r["v"])] = r["v"]
    words = int(min(WORDS, max(4, round((seen["n"] / CELL) ** 0.5))))
    half = (width + 1) // 2
    return Space(width, seen["longest"] or 0.0, codebook(x[:, :half], words), codebook(x[:, half:], words))


def index(vectors: DataFrame, space: Space) -> DataFrame:
    """The stored blocks of all rows, each of one cell."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            v = matrix(b.column("v"), space.width)
            (i, r1), (j, r2) = nearest(v[:, : space.half], space.first), nearest(v[:, space.half :], space.second)
            data = pa.array([x.tobytes() for x in v.astype(space.kind)], pa.binary())
            columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(r1), pa.array(r2), pa.array(np.full(len(v), part, np.int32)), b.column("vec_id"), b.column("label"), data]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "r1", "r2", "part", "vec_id", "label", "v"])

    schema = _arrow(_INDEX)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, cell = TaskContext.get().partitionId(), 0, None
        held: list[dict] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            one = {"block": part << 32 | number, "shard": part << 32 | number // SHARD, "i": cell[0], "j": cell[1], "n": len(held), "vectors": b"".join(r["v"] for r in held)}
            one |= {"r1": max(r["r1"] for r in held), "r2": max(r["r2"] for r in held), "ids": [r["vec_id"] for r in held], "labels": [r["label"] for r in held]}
            return pa.RecordBatch.from_pylist([one], schema=schema)

        for b in batches:
            for r in b.to_pylist():
                if held and ((r["i"], r["j"]) != cell or len(held) == BLOCK):
                    yield block()
                    held = []
                cell = r["i"], r["j"]
                held.append(r)
        if held:
            yield block()

    # the task that read a row tells equal rows of a crowded cell apart, so ranges can cut it anywhere
    order = ("i", "j", "part", "vec_id")
    placed = vectors.mapInArrow(keyed, "i int, j int, r1 double, r2 double, part int, vec_id bigint, label bigint, v binary")
    return stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _INDEX))


def anchor_blocks(table: DataFrame, space: Space, every: int) -> DataFrame:
    """The anchors among the rows of the index, in the order of the index. A row is known by its block and its place there."""
    schema = _arrow(_ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            rids, ids, labels, data = zip(*held, strict=True)
            return pa.RecordBatch.from_pylist([{"q": part << 32 | number, "n": len(held), "rids": rids, "ids": ids, "labels": labels, "vectors": b"".join(data)}], schema=schema)

        for b in batches:
            for r in b.to_pylist():
                size = len(r["vectors"]) // r["n"]
                for at, i in enumerate(r["ids"]):
                    if i % every == 0:
                        held.append((r["block"] << 12 | at, i, r["labels"][at], r["vectors"][at * size : (at + 1) * size]))
                        if len(held) == ANCHORS:
                            yield block()
                            held = []
        if held:
            yield block()

    return stored(table.select("block", "n", "ids", "labels", "vectors").mapInArrow(run, _ANCHORS))


class Search:
    """One kind of search over an index: of each window the ``keep`` best rows of the same label, or of other labels."""

    def __init__(self, space: Space, table: DataFrame, anchors: DataFrame, width: int, keep: int, same: bool):
        self.space, self.table, self.anchors = space, table, anchors
        self.width, self.keep, self.same = width, keep, same
        cells = table.groupBy("i", "j").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()
        self.radius = {(r["i"], r["j"]): (r["r1"], r["r2"]) for r in cells}

    def asked(self, state: DataFrame | None) -> DataFrame:
        """Anchor blocks with what is open for each."""
        if state is None:
            return self.anchors.withColumn("state", F.expr("cast(null as array<struct<pos:int,w:int,low:double,high:double>>)"))
        lists = state.groupBy("q").agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("w").cast("int").alias("w"), "low", "high")).alias("state"))
        return self.anchors.join(lists, "q")  # a block without open windows asks nothing

    def wanted(self, asked: DataFrame, first_only: bool) -> DataFrame:
        """``q, shard``: which anchor blocks need which shards; or the one where the most promising cell begins."""
        space, radius, width, keep = self.space, self.radius, self.width, self.keep

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    walk = Walk(space, r, Windows(r, r["state"], width, keep))
                    cells = [cell for cell, _ in zip(walk.cells(radius), range(1), strict=False)] if first_only else list(walk.cells(radius))
                    found = [c for c, _ in cells] if cells else []
                    yield pa.RecordBatch.from_arrays([pa.array([r["q"]] * len(found), pa.int64()), pa.array([c[0] for c in found], pa.int32()), pa.array([c[1] for c in found], pa.int32())], names=["q", "i", "j"])

        cells = asked.mapInArrow(run, "q bigint, i int, j int")
        shards = self.table.select("i", "j", "shard")
        if first_only:
            return cells.join(shards.groupBy("i", "j").agg(F.min("shard").alias("shard")), ["i", "j"]).select("q", "shard")
        return cells.join(shards.distinct(), ["i", "j"]).select("q", "shard").distinct()

    def scan(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """``q, pos, w, vec_id, rid, score``: the best rows of each window in each shard."""
        space, width, keep, same = self.space, self.width, self.keep, self.same
        copies = pairs.groupBy("shard").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("copies"))
        no_state = F.expr("cast(null as array<struct<pos:int,w:int,low:double,high:double>>)")
        body = self.table.join(copies, "shard").select(
            "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), F.col("block").alias("id"), "i", "j", "r1", "r2", "n",
            F.lit(None).cast("array<bigint>").alias("rids"), "ids", "labels", "vectors", no_state.alias("state"),
        )
        nothing, zero = F.lit(None).cast("int"), F.lit(None).cast("double")
        visitors = pairs.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int")).join(asked, "q").select(
            "shard", "copy", F.lit(1).alias("kind"), F.col("q").alias("id"), nothing.alias("i"), nothing.alias("j"), zero.alias("r1"), zero.alias("r2"), "n", "rids", "ids", "labels", "vectors", "state",
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, cells, radius = None, {}, {}
            for b in batches:
                for r in b.to_pylist():
                    if (r["shard"], r["copy"]) != place:
                        place, cells, radius = (r["shard"], r["copy"]), {}, {}
                    if r["kind"] == 0:
                        cell = r["i"], r["j"]
                        cells.setdefault(cell, []).append((np.array(r["ids"]), np.array(r["labels"]), (r["id"] << 12) + np.arange(r["n"]), space.unpacked(r["vectors"], r["n"])))
                        known = radius.get(cell, (0.0, 0.0))
                        radius[cell] = max(known[0], r["r1"]), max(known[1], r["r2"])
                        continue
                    windows = Windows(r, r["state"], width, keep)
                    walk = Walk(space, r, windows)
                    own, label = np.array(r["rids"]), np.array(r["labels"])
                    for cell, at in walk.cells(radius):
                        for ids, labels, rids, v in cells[cell]:
                            alike = label[at][:, None] == labels[None, :]
                            windows.add(at, walk.v[at] @ v.T, (alike & (own[at][:, None] != rids[None, :])) if same else ~alike, ids, rids)
                    f = windows.found
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f["pos"]), r["id"], np.int64)), *[pa.array(f[k].astype(np.int32)) for k in ("pos", "w")], *[pa.array(f[k]) for k in ("vec_id", "rid", "score")]], names=["q", "pos", "w", "vec_id", "rid", "score"])

        ready = body.unionByName(visitors).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind", "id")
        return ready.mapInArrow(run, "q bigint, pos int, w int, vec_id bigint, rid bigint, score bigint")

    def best(self, state: DataFrame | None) -> DataFrame:
        """``q, pos, w, rank, vec_id, score``. ``state`` (q, pos, w, low, high) names the windows; None is one open window for each anchor."""
        by = W.partitionBy("q", "pos", "w").orderBy(F.col("score").desc(), "vec_id", "rid")

        def ranked(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= self.keep)

        asked = stored(self.asked(state))
        seeds = ranked(self.scan(asked, stored(self.wanted(asked, True)))).filter(F.col("rank") == self.keep).select("q", "pos", "w", F.col("score").cast("double").alias("seed"))
        if state is None:
            every = self.anchors.select("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"), F.lit(0).alias("w"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
        else:
            every = state
        narrowed = every.join(seeds, ["q", "pos", "w"], "left").withColumn("low", F.greatest("low", F.coalesce("seed", "low"))).drop("seed")
        again = stored(self.asked(narrowed))
        return stored(ranked(self.scan(again, stored(self.wanted(again, False))))).drop("rid")


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of a table ``vec_id, label, v``."""
    space = make_space(vectors)
    table = index(vectors, space)
    anchors = anchor_blocks(table, space, every)
    good = Search(space, table, anchors, 1, positives, True).best(None)
    wanted = good.select("q", "pos", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score")
    # whole numbers n with low * p <= 100 * n <= high * p
    state = wanted.select("q", "pos", "w", F.ceil(p * low / 100).cast("double").alias("low"), F.floor(p * high / 100).cast("double").alias("high")).filter(F.col("low") <= F.col("high"))
    bad = Search(space, table, anchors, positives, negatives, False).best(state)
    ids = anchors.select("q", F.posexplode("ids").alias("pos", "anchor_id"))
    out = bad.select("q", "pos", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(wanted, ["q", "pos", "w"]).join(ids, ["q", "pos"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark, sf_dir: str) -> DataFrame:
    df = rows.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return hard_negatives(usable(df, label))


OP13_SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.r <> c.r
), p AS (
  SELECT a, anchor_id, c, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id, s.c)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""
