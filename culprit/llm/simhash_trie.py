"""SimHash fingerprints and their self-join over binary tries.

Fingerprints that are equal are one class. The classes are cut into blocks by their first bits (a
prefix that many share gets several blocks), and every pair of blocks whose prefixes differ in few
enough bits is a task of bounded size. A task walks the two tries together: a trie node is a range
of the sorted fingerprints, a pair of nodes carries the bits in which they differ so far, and pairs
over the budget are dropped. A task does not report all pairs but a spanning forest of its links,
so a group of thousands of near copies costs as many rows as it has members. The links of all
tasks go through connected components.

Rules: A-Z lower-cased, words split at ASCII white space, shingles of ``words`` words with repeats,
a shorter text is one shingle, a text without words has fingerprint 0; null text is empty; a null
id counts as the smallest; rows that share an id are documents of their own. Nothing is sampled or
capped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.functions.storage import stored
from culprit.llm import rows
from culprit.llm.components import components

WORDS, BITS, SEED = 4, 4, 42
BLOCK = 1 << 18  # classes in a block
LEAF = 16  # node size at which pairs are compared one by one
AT_ONCE = 1 << 12  # node pairs worked on at a time
SHINGLES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """Hashes (unsigned) of the shingles of a UTF-8 text, in order, some at a time."""
    parts = text.lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    starts, ends = starts[: len(parts) - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), SHINGLES_AT_ONCE):
        a, b = starts[i : i + SHINGLES_AT_ONCE].tolist(), ends[i : i + SHINGLES_AT_ONCE].tolist()
        yield np.array([digest(joined[x:y], SEED) for x, y in zip(a, b, strict=True)], dtype=np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """Signed 64-bit fingerprint of hashes: the bits that more than half of them have."""
    total, n = np.zeros(64, np.int64), 0
    for h in hashes:
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big", signed=True)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    return majority(shingle_hashes(text, words))


def fingerprints(body: Column, words: int = WORDS) -> Column:
    """Fingerprint (bigint) of a binary column of UTF-8."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words) for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(run, "bigint")(body)


class _Side:
    def __init__(self, values: np.ndarray):
        self.values = values  # sorted, distinct, unsigned

    def middle(self, lo: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Where the second child of each node begins; a node's members share their first ``depth`` bits."""
        bit = np.uint64(1) << (np.uint64(63) - depth)
        return np.searchsorted(self.values, (self.values[lo] & ~((bit << np.uint64(1)) - np.uint64(1))) | bit)


def close_pairs(left: np.ndarray, right: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints that differ in at most ``bits`` bits; ``right`` None: within ``left``, i < j."""
    same = right is None
    u = _Side(left)
    v = u if same else _Side(right)
    if not len(u.values) or not len(v.values):
        return
    zero = np.zeros(1, np.int64)
    stack = [(zero, np.array([len(u.values)]), zero, np.array([len(v.values)]), np.zeros(1, np.uint64), zero)]
    while stack:
        ul, uh, vl, vh, depth, err = stack.pop()
        if len(ul) > AT_ONCE:
            stack += [tuple(x[i : i + AT_ONCE] for x in (ul, uh, vl, vh, depth, err)) for i in range(0, len(ul), AT_ONCE)]
            continue
        small = np.maximum(uh - ul, vh - vl) <= LEAF
        if small.any():
            yield from _leaves(u.values, v.values, ul[small], uh[small], vl[small], vh[small], bits, same)
        if small.all():
            continue
        ul, uh, vl, vh, depth, err = (x[~small] for x in (ul, uh, vl, vh, depth, err))
        um, vm = np.clip(u.middle(ul, depth), ul, uh), np.clip(v.middle(vl, depth), vl, vh)
        mirrored = (ul == vl) & same
        keep = np.ones(len(ul), bool)
        children = [(ul, um, vl, vm, err, keep), (um, uh, vm, vh, err, keep), (ul, um, vm, vh, err + 1, keep), (um, uh, vl, vm, err + 1, ~mirrored)]
        made = [np.concatenate(x) for x in zip(*[(a, b, c, d, depth + np.uint64(1), e, ok) for a, b, c, d, e, ok in children], strict=True)]
        ok = made.pop() & (made[0] < made[1]) & (made[2] < made[3]) & (made[5] <= bits)
        stack.append(tuple(x[ok] for x in made))


def _leaves(u, v, ul, uh, vl, vh, bits, same):
    span = np.arange(LEAF)
    i, j = ul[:, None] + span, vl[:, None] + span
    a, b = u[np.minimum(i, len(u) - 1)], v[np.minimum(j, len(v) - 1)]
    near = np.bitwise_count(a[:, :, None] ^ b[:, None, :]) <= bits
    near &= (i < uh[:, None])[:, :, None] & (j < vh[:, None])[:, None, :]
    if same:
        near &= i[:, :, None] < j[:, None, :]
    p, x, y = np.nonzero(near)
    if len(p):
        yield i[p, x], j[p, y]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that each index is linked to."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, up := root[root]):
                root = up
    return root


def _task(bits: int):
    def run(block_pair: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side in (0, 1):
            s = block_pair[block_pair["side"] == side]
            fp = s["fp"].to_numpy().view(np.uint64)
            order = np.argsort(fp)
            sides.append((fp[order], s["node"].to_numpy()[order]))
        (fa, na), (fb, nb) = sides
        one = not len(fb) and bool((block_pair["own"]).all())
        node = np.concatenate([na, nb])
        pairs = close_pairs(fa, None, bits) if one else ((i, j + len(fa)) for i, j in close_pairs(fa, fb, bits))
        root = _forest(len(node), pairs)
        linked = np.flatnonzero(root != np.arange(len(node)))
        return pd.DataFrame({"a": node[linked], "b": node[root[linked]]})

    return run


def links(classes: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """``a, b``: for distinct fingerprints ``classes(fp, node)``, links that join all nodes whose fingerprints
    differ in at most ``bits`` bits, directly or over others."""
    n = classes.count()
    width = max(4, math.ceil(math.log2(max(1, n / block))))  # 2^width prefixes: as many as there are blocks
    masks = [sum(1 << i for i in ones) for k in range(bits + 1) for ones in itertools.combinations(range(width), k)]
    prefixed = classes.withColumn("prefix", F.shiftrightunsigned("fp", 64 - width))
    sizes = stored(prefixed.groupBy("prefix").agg(F.ceil(F.count("*") / block).alias("salts")))
    # a block is a prefix or, of one that many share, a part of it; two blocks meet if their prefixes are near
    blocks = sizes.select("prefix", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    near = blocks.select(F.col("prefix").alias("p"), F.col("salt").alias("s"), F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("mask"))
    pairs = near.withColumn("prefix", F.col("p").bitwiseXOR(F.col("mask"))).join(blocks, "prefix").filter(F.struct("p", "s") <= F.struct("prefix", "salt"))
    side = lambda number, p, s: F.struct(F.lit(number).alias("side"), F.col(p).alias("prefix"), F.col(s).alias("salt"))
    own = (F.col("p") == F.col("prefix")) & (F.col("s") == F.col("salt"))
    pair = F.struct("p", "s", F.col("prefix").alias("q"), F.col("salt").alias("t"))
    tasks = pairs.select(pair.alias("pair"), own.alias("own"), F.explode(F.when(own, F.array(side(0, "p", "s"))).otherwise(F.array(side(0, "p", "s"), side(1, "prefix", "salt")))).alias("x")).select("pair", "own", "x.*")
    placed = prefixed.join(sizes, "prefix").select("fp", "node", "prefix", F.pmod(F.xxhash64("fp"), F.col("salts")).alias("salt"))
    return placed.join(tasks, ["prefix", "salt"]).groupBy("pair").applyInPandas(_task(bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``doc``, ``key`` (hash of the text), ``fp``, ``group`` (a fingerprint that stands for all in reach) and
    ``component``, the smallest document number in reach, for each row."""
    found = stored(docs.select(rows.doc_number(docs).alias("doc"), F.xxhash64(rows.body(docs)).alias("key"), fingerprints(rows.body(docs).cast("binary"), words).alias("fp")))
    return grouped(found, bits)


def grouped(found: DataFrame, bits: int, more: DataFrame | None = None) -> DataFrame:
    """Groups of ``found(doc, key, fp)``; ``more`` are further links ``a, b`` between fingerprints."""
    classes = stored(found.groupBy("fp").agg(F.min("doc").alias("least")))
    near = links(classes.select("fp", F.col("fp").alias("node")), bits)
    joined = components(near if more is None else near.unionAll(more))
    grouped = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component"))
    return found.join(grouped.join(least, "group").select("fp", "group", "component"), "fp").select("doc", "key", "fp", "group", "component")


def op10(spark, sf_dir: str) -> DataFrame:
    done = near_duplicates(rows.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(rows.doc_id(F.col("doc")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), rows.doc_id(F.col("component")).alias("component_id"))
