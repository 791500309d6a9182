"""All pairs of shingle sets with a Jaccard index of at least 0.8, up to connection.

Sets that agree in four fifths share one of the first ``n - ceil(0.8 n) + 1`` members of either in any
order that all sets follow. The order here is by frequency in a sample of documents and then by hash, so
common passages come last; the sample decides what the search costs and never what it finds.

Each different set puts its first members into a table of postings, which is shuffled once by member.
One pass over each sorted part drops members that one set holds and compares every other holder with
two leaders: the first one of its size band, for two ways to cut sizes into bands. A pair goes on if
the places of the member, and the marks of the two sets, leave room for enough common members; then it is
verified by the exact overlap of the two sets. A mark is a bitmap of 1,024 bits: each bit of one that the
other lacks is a member that is not shared. A set of more members fills it, so it has a wide mark too, of a bit
or two a member; whole sets are shuffled only for pairs that both marks leave open, and texts only if one of
``BUCKETS`` hashes, which are broadcast, is that of a text asked for. Holders of a member that are still not connected are
compared pair by pair, by size class, large groups in the blocks of a grid; there marks are compared
inside the join, so that only pairs that may be alike come out of it.

Rules for words and shingles are those of ``simhash_trie``, but sets have no repeats; a text without
words has no set. Nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from culprit.functions.storage import release, stored
from culprit.llm import rows, simhash_trie
from culprit.llm.components import components

SAMPLE, OFTEN, RANKED = 10_000, 4, 1 << 17  # documents that the order is made from; its commonest shingles
BUCKETS = 1 << 20  # hashes of the texts that are made into sets
GROWTH = 1.25  # a set's partners are at most so many times as long
MARK = 16  # numbers of 64 bits
CROWD = 32  # holders of one member and size class
GRID = 2_000  # holders in a row or column of the grid of one member and size class


def distinct_shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes."""
    parts = list(simhash_trie.shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _sets(body: Column, words: int) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([distinct_shingles(t.as_py(), words).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>").asNondeterministic()(body)  # so that the planner runs it once


def common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Commonest shingles of a sample, sorted, and how many of its documents hold them."""
    every = max(1, docs.count() // SAMPLE)
    sample = docs.select(rows.body(docs).alias("body")).filter(F.pmod(F.xxhash64("body", F.lit(1)), F.lit(every)) == 0)
    counts = sample.select(F.explode(_sets(F.col("body").cast("binary"), words)).alias("h")).groupBy("h").count().filter(F.col("count") >= OFTEN)
    top = counts.orderBy(F.desc("count"), "h").limit(RANKED).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(h)
    return h[by], top["count"].to_numpy(np.int64)[by]


def mark(s: np.ndarray) -> np.ndarray:
    """Bitmap of ``64 * MARK`` bits of the hashes, as signed numbers."""
    bits = np.zeros(64 * MARK, np.uint8)
    bits[(s >> np.uint64(40)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).view(np.int64)


def wide_mark(s: np.ndarray) -> np.ndarray:
    """Of a set that fills its mark, the bitmap of as many bits as it has members, up to a power of two. Halves laid
    over each other are the bitmap of half as many bits."""
    if len(s) <= 64 * MARK:
        return np.zeros(0, np.int64)
    bits = np.zeros(1 << (len(s) - 1).bit_length(), np.uint8)
    bits[(s >> np.uint64(20)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).view(np.int64)


def described(body: Column, words: int, often: tuple[np.ndarray, np.ndarray]) -> Column:
    """``fp``, hash of the set (``node``), its size ``n``, its ``mark``, ``wide`` mark and its first members in the order."""
    ranked, counts = often

    def run(texts: pa.Array) -> pa.Array:
        fps, nodes, sizes, marks, wides, firsts = [], [], [], [], [], []
        for t in texts:  # one text at a time in Python's memory
            hashes = list(simhash_trie.shingle_hashes(t.as_py(), words))
            fps.append(simhash_trie.majority(hashes))
            s = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
            n = len(s)
            weight = np.zeros(n, np.int64)
            if len(ranked) and n:
                at = np.minimum(np.searchsorted(ranked, s), len(ranked) - 1)
                weight = np.where(ranked[at] == s, counts[at], 0)
            first = s[np.lexsort((s, weight))[: n - (4 * n + 4) // 5 + 1 if n else 0]]
            nodes.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
            sizes.append(n)
            marks.append(mark(s))
            wides.append(wide_mark(s))
            firsts.append(first.view(np.int64))
        columns = [pa.array(fps, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(marks, pa.list_(pa.int64())), pa.array(wides, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["fp", "node", "n", "mark", "wide", "first"])

    return F.arrow_udf(run, "struct<fp: bigint, node: bigint, n: int, mark: array<bigint>, wide: array<bigint>, first: array<bigint>>")(body)


def _enough(overlap, n, m):
    """Jaccard index of at least 0.8 in whole numbers."""
    return 9 * overlap >= 4 * (n + m)


class Leader:
    """The first holder of each (member, size band) in rows that come sorted by member and size, over batches."""

    def __init__(self, shift: float):
        self.shift, self.key, self.node, self.ni = shift, None, 0, 0

    def of(self, h: np.ndarray, ni: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        band = np.floor(np.log(ni >> 32) / np.log(GROWTH) + self.shift).astype(np.int64)
        new = np.append(self.key != (h[0], band[0]), (h[1:] != h[:-1]) | (band[1:] != band[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        lead, lead_ni = np.where(at >= 0, node[at], self.node), np.where(at >= 0, ni[at], self.ni)
        self.key, self.node, self.ni = (h[-1], band[-1]), lead[-1], lead_ni[-1]
        return lead, lead_ni


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted postings those whose member another set holds too, each with the leaders to compare with."""
    leaders, held, before = (Leader(0.0), Leader(0.5)), [np.zeros(0, np.int64)] * 3, None

    def out(h: np.ndarray, ni: np.ndarray, node: np.ndarray, after: int | None) -> pa.RecordBatch:
        nonlocal before
        same = h[1:] == h[:-1]
        shared = np.append(same, h[-1] == after) | np.append(h[0] == before, same)
        before = h[-1]
        leads = []
        n, i = ni >> 32, ni & 0xFFFFFFFF
        for leader in leaders:
            lead, lead_ni = leader.of(h, ni, node)
            room = np.minimum(n - i, (lead_ni >> 32) - (lead_ni & 0xFFFFFFFF))
            ok = (lead != node) & _enough(room, n, lead_ni >> 32)
            leads.append(pa.array(lead[shared], pa.int64(), mask=~ok[shared]))
        return pa.RecordBatch.from_arrays([pa.array(h[shared]), pa.array(ni[shared]), pa.array(node[shared]), *leads], names=["h", "ni", "node", "first", "second"])

    for b in batches:
        if b.num_rows:
            all_rows = [np.concatenate([x, b.column(c).to_numpy()]) for x, c in zip(held, ("h", "ni", "node"), strict=True)]
            held = [x[-1:] for x in all_rows]  # the last row waits for the one after it
            if len(all_rows[0]) > 1:
                yield out(*[x[:-1] for x in all_rows], held[0][0])
    if len(held[0]):
        yield out(*held, None)


def _room_by_marks(n: Column, a: Column, m: Column, b: Column) -> Column:
    """Whether two sets of these sizes and marks can be alike enough."""
    alone = [sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(MARK)), F.lit(0)) for x, y in ((a, b), (b, a))]
    return _enough(F.least(n - alone[0], m - alone[1]), n, m)


def _room_by_wide_marks(n: Column, a: Column, m: Column, b: Column) -> Column:
    """The same by wide marks, the longer one folded. Sets that differ more in size are not told apart here."""

    def folded(x: Column, to: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) <= F.size(to), x).otherwise(F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q)))

    def alone(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)

    x, y = folded(a, b), folded(b, a)
    few = (F.size(a) == 0) | (F.size(b) == 0) | (F.greatest(F.size(a), F.size(b)) > 2 * F.least(F.size(a), F.size(b)))
    return F.when(few, F.lit(True)).otherwise(_enough(F.least(n - alone(x, y), m - alone(y, x)), n, m))


def _roomy(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that the marks leave open, and the wide marks of what is left."""

    def kept(open_pairs: DataFrame, mark: str, room) -> DataFrame:
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col(mark).alias(f"mark_{c}"))
        both = open_pairs.join(side("a"), "a").join(side("b"), "b")
        return both.filter(room(F.col("n_a"), F.col("mark_a"), F.col("n_b"), F.col("mark_b"))).select("a", "b")

    return kept(kept(pairs, "mark", _room_by_marks), "wide", _room_by_wide_marks)


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Pairs whose sets, made again from one text each, are alike enough."""
    asked = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(asked, "node").select("node", "doc", "key")
    texts = docs.select(rows.doc_number(docs).alias("doc"), F.xxhash64(rows.body(docs)).alias("key"), rows.body(docs).alias("body"))
    bucket = F.pmod(F.xxhash64("doc", "key"), F.lit(BUCKETS)).alias("bucket")
    some = texts.withColumn("bucket", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    found = some.join(wanted, ["doc", "key"]).dropDuplicates(["node"])
    sets = stored(found.select("node", _sets(F.col("body").cast("binary"), words).alias("s")))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
    done = stored(both.filter(_enough(F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t"))).select("a", "b"))
    release(sets)
    return done


def _apart(met: DataFrame, linked: DataFrame) -> DataFrame:
    """Postings ``h, node, n, i, part`` of members whose holders are not all connected."""
    part = components(linked).select("node", F.col("component").alias("part"))
    placed = met.select("h", "node", F.shiftright("ni", 32).alias("n"), F.col("ni").bitwiseAND(F.lit(0xFFFFFFFF)).alias("i")).join(part, "node", "left")
    placed = placed.withColumn("part", F.coalesce("part", "node"))
    same = W.partitionBy("h")
    return placed.withColumn("least", F.min("part").over(same)).withColumn("most", F.max("part").over(same)).filter("least < most").drop("least", "most")


def _every_pair(left: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of unconnected holders of a member. They meet in their size class or the next one; a class of very many
    holders is cut into rows and columns of a grid. Marks travel with the holders of ``CROWD`` and more only: there
    they keep most pairs from coming out, elsewhere they would cost more than the few pairs."""
    classed = left.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(GROWTH))))
    both = F.explode(F.array("class", F.col("class") - 1)).alias("class")
    counts = stored(classed.select("h", both).groupBy("h", "class").agg(F.count("*").alias("c")).filter("c > 1"))
    pairs = []
    for crowded in (False, True):
        cuts = counts.filter(F.col("c") >= CROWD if crowded else F.col("c") < CROWD).select("h", "class", F.ceil(F.col("c") / GRID).cast("int").alias("cuts"))
        block, all_blocks = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
        x = classed.join(cuts, ["h", "class"])
        y = classed.select("h", "node", "n", "i", "part", both).join(cuts, ["h", "class"])
        columns = ["node", "n", "i", "part"]
        if crowded:
            x, y = (side.join(nodes.select("node", "mark"), "node") for side in (x, y))
            columns.append("mark")
        x = x.select("h", "class", block.alias("row"), all_blocks.alias("column"), F.struct(*columns).alias("x"))
        y = y.select("h", "class", all_blocks.alias("row"), block.alias("column"), F.struct(*columns).alias("y"))
        room = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
        ok = (F.col("x.part") != F.col("y.part")) & _enough(room, F.col("x.n"), F.col("y.n"))
        if crowded:
            ok &= _room_by_marks(F.col("x.n"), F.col("x.mark"), F.col("y.n"), F.col("y.mark"))
        met = x.join(y, ["h", "class", "row", "column"]).filter(ok)
        pairs.append(met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")))
    return pairs[0].unionAll(pairs[1]).distinct()


def links(docs: DataFrame, firsts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``a, b``: links that join all sets with an index of at least 0.8, directly or over others. ``firsts(node, n, first)``
    has one row for each set, ``nodes(node, n, mark, wide, doc, key)`` one text for each."""
    postings = firsts.select("node", F.col("n").cast("bigint").alias("n"), F.posexplode("first").alias("i", "h"))
    packed = postings.select("h", (F.shiftleft("n", 32) + F.col("i")).alias("ni"), "node")
    met = stored(packed.repartition("h").sortWithinPartitions("h", "ni", "node").mapInArrow(_meet, "h bigint, ni bigint, node bigint, first bigint, second bigint"))
    led = met.select(F.explode(F.array("first", "second")).alias("lead"), "node").filter("lead IS NOT NULL")
    pairs = stored(_roomy(led.select(F.greatest("lead", "node").alias("a"), F.least("lead", "node").alias("b")).distinct(), nodes))
    linked = _verified(docs, nodes, pairs, words)
    left = stored(_apart(met, linked))
    release(met)
    rest = stored(_roomy(_every_pair(left, nodes).join(pairs, ["a", "b"], "left_anti"), nodes))
    release(left, pairs)
    return linked.unionAll(_verified(docs, nodes, rest, words))


def near_copies(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Rows as ``simhash_trie.near_duplicates`` has them; groups join by close fingerprints and by an index of at least 0.8."""
    often = common(docs, words)
    body = rows.body(docs)
    found = docs.select(rows.doc_number(docs).alias("doc"), F.xxhash64(body).alias("key"), described(body.cast("binary"), words, often).alias("r"))
    found = stored(found.select("doc", "key", "r.*"))
    some = found.filter("n > 0")
    nodes = some.groupBy("node").agg(F.min("fp").alias("least"), F.any_value("n").alias("n"), F.any_value("mark").alias("mark"), F.any_value("wide").alias("wide"), F.min(F.struct("doc", "key")).alias("one"))
    nodes = stored(nodes.select("node", "least", "n", "mark", "wide", "one.*"))
    # copies have one set: its members leave the rows before they are exploded
    firsts = some.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("first").alias("first"))
    alike = links(docs, firsts, nodes, words)
    fp = nodes.select("node", "least")
    alike = alike.join(fp.select(F.col("node").alias("a"), F.col("least").alias("p")), "a").join(fp.select(F.col("node").alias("b"), F.col("least").alias("q")), "b").select("p", "q")
    same = some.select("node", "fp").join(fp, "node").filter("fp != least").select(F.col("fp").alias("p"), F.col("least").alias("q"))
    more = alike.unionAll(same).select(F.col("p").alias("a"), F.col("q").alias("b"))
    return simhash_trie.grouped(found.select("doc", "key", "fp"), bits, more)
