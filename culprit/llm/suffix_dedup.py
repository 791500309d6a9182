"""Remove passages of at least ``length`` bytes that also start anywhere else.

Shards are made by content. Each string of ``length`` bytes belongs to the smallest hash among the
``GRAM``-byte strings in it (the rightmost of equal ones), so equal strings belong to equal hashes.
Neighbouring strings of a document that belong to the same place form a segment: all bytes that
those strings cover. A hash that occurs once settles its segment (unique), and so does a hash whose
segments are all equal (everything in them is repeated). Only hashes with several different
segments need their bytes: these go, each different segment once, to shards of bounded size. There
a suffix array is built in numpy by Larsson-Sadakane refinement (only groups that are still tied
are sorted again, by the rank of the suffix ``h`` further on), and Kasai's common prefixes tell
which strings of ``length`` bytes occur twice. A hash with more segments than a shard holds is
spread over several shards; each hands on its different strings, sorted, and those of all shards
are merged by binary search in ranges of their hash.

Rules: strings never cross documents; null text is empty; rows are documents of their own, so a
repeated row of ``length`` bytes or more loses everything; texts shorter than ``length`` stay.
Strings are judged on the input, and all occurrences go, the first one too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.functions.storage import stored
from culprit.llm import rows

LENGTH = 400
GRAM = 48
AT_ONCE = 1 << 19  # positions of a text worked on at a time; with a window less than 2^20
SHARD_BYTES = 2_000_000
SHARD_SEGMENTS = 4_000  # of one hash in one shard
MERGE_ROWS = 100_000  # strings that one task merges
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ANCHOR = "key bigint, seg_hi bigint, seg_lo bigint, doc bigint, text_key bigint, start bigint, size int"
_ANCHOR_ARROW = pa.schema([("key", pa.int64()), ("seg_hi", pa.int64()), ("seg_lo", pa.int64()), ("doc", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("size", pa.int32())])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = both[0], both[1]
    a, b = _POWERS[size]
    return a[:n], b[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbouring values: prefix and suffix minima of blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])


def segments_of(text: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, first byte and end of the segments of a text, part by part."""
    whole = np.frombuffer(text, np.uint8)
    mask = np.uint64((1 << 20) - 1)
    for at in range(0, len(whole) - length + 1, AT_ONCE):
        data = whole[at : at + AT_ONCE + length - 1]
        h = gram_hashes(data, gram)
        place = mask - np.arange(len(h), dtype=np.uint64)  # of equal hashes the rightmost
        least = mask - (window_minima((h & ~mask) | place, length - gram + 1) & mask)
        starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        ends = np.concatenate((starts[1:], [len(least)])) - 1 + length
        yield h[least[starts].astype(np.int64)].view(np.int64), starts + at, ends + at


def _anchored(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, text_keys = b.column("doc").to_numpy(), b.column("text_key").to_numpy()
            keys, starts, sizes, owners, digests = [], [], [], [], []
            for i, text in enumerate(b.column("body").to_pylist()):
                for k, s, e in segments_of(text, length, gram):
                    view = memoryview(text)
                    digests += [xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                    keys.append(k)
                    starts.append(s)
                    sizes.append(e - s)
                    owners.append(np.full(len(k), i))
            if not keys:
                continue
            at = np.concatenate(owners)
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [np.concatenate(keys), d[:, 0], d[:, 1], docs[at], text_keys[at], np.concatenate(starts), np.concatenate(sizes).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=_ANCHOR_ARROW)

    return run


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of 16-bit symbols whose suffixes are all different within their own segment."""
    n = len(symbols)
    four = packed_four(symbols)
    order = np.argsort(four, kind="stable")
    s = four[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 4
    tied = _tied(new)
    while len(tied):
        who = order[tied]
        key = (rank[who] << 32) | np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[tied] = who = who[by]  # groups lie together, so every group stays in its own places
        key = key[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        new[tied] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[_tied(fresh)]
        h *= 2
    return order, rank


def packed_four(symbols: np.ndarray) -> np.ndarray:
    s = np.concatenate((symbols, np.zeros(3, symbols.dtype))).astype(np.uint64)
    return (s[:-3] << np.uint64(48)) | (s[1:-2] << np.uint64(32)) | (s[2:-1] << np.uint64(16)) | s[3:]


def _tied(new: np.ndarray) -> np.ndarray:
    """Places whose group has more than one member."""
    return np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))


def common_prefixes(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Kasai: for each position the common prefix with the suffix before it in the array. All segments are walked
    side by side, one position at a time; from a position to the next a prefix loses at most one symbol."""
    four = np.concatenate((packed_four(symbols), np.zeros(4, np.uint64)))
    before = np.full(len(symbols), -1)
    before[order[1:]] = order[:-1]
    lcp = np.zeros(len(symbols), np.int64)
    carried = np.zeros(len(starts), np.int64)
    for t in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > t)
        i = starts[on] + t
        j = before[i]
        at = np.where(j >= 0, np.maximum(carried[on] - 1, 0), 0)
        go = np.flatnonzero(j >= 0)
        while len(go):
            a, b = i[go] + at[go], j[go] + at[go]
            inside = (a < len(symbols)) & (b < len(symbols))
            d = np.where(inside, four[np.minimum(a, len(symbols))] ^ four[np.minimum(b, len(symbols))], np.uint64(1) << np.uint64(63))
            at[go] += (d < np.uint64(1 << 48)).astype(np.int64) + (d < np.uint64(1 << 32)) + (d < np.uint64(1 << 16)) + (d == 0)
            go = go[d == 0]
        lcp[i] = at
        carried[on] = at
    return lcp


def repeated_starts(segments: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment which of its strings of ``length`` bytes start anywhere else in the segments, and which are
    the first of their kind in the order of the array."""
    sizes = np.array([len(s) for s in segments])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    symbols = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
    for i, (s, at) in enumerate(zip(segments, starts.tolist(), strict=True)):
        symbols[at : at + len(s)] = np.frombuffer(s, np.uint8)
        symbols[at + len(s)] = 256 + i  # ends that differ from every other symbol
    order, rank = suffix_array(symbols)
    lcp = common_prefixes(symbols, order, rank, starts, sizes)
    long = lcp >= length
    repeated = long.copy()
    repeated[order[rank[np.flatnonzero(long)] - 1]] = True
    return [(repeated[a : a + n - length + 1], ~long[a : a + n - length + 1]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_RANGE = "key bigint, seg_hi bigint, seg_lo bigint, from_ int, to_ int, window binary, shard bigint"


def _shard(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["key", "seg_hi", "seg_lo"]).sort_values(["key", "seg_hi", "seg_lo"])
        out: list[tuple] = []
        for first in range(0, len(pdf), 60_000):  # ends are 16-bit symbols; a shard's bytes keep it far below that
            part = pdf.iloc[first : first + 60_000]
            segments = part["bytes"].tolist()
            for (k, hi, lo, n, spread, shard), seg, (mask, leads) in zip(part[["key", "seg_hi", "seg_lo", "n", "spread", "shard"]].itertuples(index=False), segments, repeated_starts(segments, length), strict=True):
                if n > 1:
                    mask = np.ones(len(mask), bool)
                out += [(k, hi, lo, a, b, None, shard) for a, b in _runs(mask)]
                if spread:  # each different string once; one that is repeated here is settled and only stands for the others
                    out += [(k, hi, lo, a, a + 1, xxhash.xxh3_128_digest(seg[a : a + length]), shard) for a in np.flatnonzero(leads).tolist()]
        return pd.DataFrame(out, columns=["key", "seg_hi", "seg_lo", "from_", "to_", "window", "shard"])

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strings of one range of hashes from several shards: found in another shard's sorted list?"""
    window = np.array(pdf["window"].tolist(), dtype="S16")
    shard = pdf["shard"].to_numpy()
    lists = {s: np.unique(window[shard == s]) for s in np.unique(shard)}
    everything = np.sort(np.concatenate(list(lists.values())))
    times = np.searchsorted(everything, window, "right") - np.searchsorted(everything, window, "left")
    return pdf[times > 1][["key", "seg_hi", "seg_lo", "from_", "to_"]]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {n: [] for n in ("key", "seg_hi", "seg_lo", "n", "shard", "spread", "bytes")}
        for text, wanted in zip(b.column("body").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            for w in wanted:
                for n in ("key", "seg_hi", "seg_lo", "n", "shard", "spread"):
                    out[n].append(w[n])
                out["bytes"].append(text[w["start"] : w["start"] + w["size"]])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("seg_hi", pa.int64()), ("seg_lo", pa.int64()), ("n", pa.int64()), ("shard", pa.int64()), ("spread", pa.bool_()), ("bytes", pa.binary())]))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """``doc, text_key, spans``: for each document with repeated bytes their spans, sorted, as ``array<struct<a, b>>``;
    spans may overlap and are merged by who uses them."""
    source = docs.select(rows.doc_number(docs).alias("doc"), F.xxhash64(rows.body(docs)).alias("text_key"), rows.body(docs).cast("binary").alias("body"))
    anchors = stored(source.filter(F.octet_length("body") >= length).mapInArrow(_anchored(length, gram), _ANCHOR))
    same = (F.min("seg_hi") == F.max("seg_hi")) & (F.min("seg_lo") == F.max("seg_lo"))
    # written, so that the join reads two shuffles of which Spark can split a large partition
    often = stored(anchors.groupBy("key").agg(F.count("*").alias("times"), same.alias("same")).filter("times > 1").select("key", "same"))
    repeated = stored(anchors.join(often, "key"))
    settled = repeated.filter("same").select("doc", "text_key", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    mixed = repeated.filter(~F.col("same"))

    segs = stored(mixed.groupBy("key", "seg_hi", "seg_lo").agg(F.count("*").alias("n"), F.min(F.struct("doc", "text_key", "start", "size")).alias("at")))
    # where every segment is there twice nothing is left to ask
    width = stored(segs.groupBy("key").agg(F.ceil(F.count("*") / shard_segments).alias("width"), F.min("n").alias("least"), F.sum("at.size").alias("bytes")))
    total = width.filter("least = 1").agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    full = segs.join(width.filter("least > 1"), "key").select("key", "seg_hi", "seg_lo", F.lit(0).alias("from_"), (F.col("at.size") - length + 1).alias("to_"))
    # shards of spread hashes lie beyond the plain ones
    spread = F.col("width") > 1
    number = F.when(spread, shards + F.pmod(F.xxhash64("key", F.pmod(F.xxhash64("seg_hi", "seg_lo"), F.col("width"))), F.lit(1 << 61))).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards)))
    wanted = segs.join(width.filter("least = 1"), "key").select("at.doc", "at.text_key", F.struct("key", "seg_hi", "seg_lo", "n", number.alias("shard"), spread.alias("spread"), "at.start", "at.size").alias("w"))
    by_doc = wanted.groupBy("doc", "text_key").agg(F.collect_list("w").alias("wanted"))
    pieces = source.join(by_doc, ["doc", "text_key"]).select("body", "wanted").mapInArrow(_cut, "key bigint, seg_hi bigint, seg_lo bigint, n bigint, shard bigint, spread boolean, bytes binary")
    ranges = stored(pieces.groupBy("shard").applyInPandas(_shard(length), _RANGE))
    strings = ranges.filter(F.col("window").isNotNull())
    buckets = max(1, math.ceil(strings.count() / MERGE_ROWS))
    across = strings.groupBy(F.pmod(F.xxhash64("window"), F.lit(buckets)).alias("bucket")).applyInPandas(_merged, "key bigint, seg_hi bigint, seg_lo bigint, from_ int, to_ int")
    found = ranges.filter(F.col("window").isNull()).select("key", "seg_hi", "seg_lo", "from_", "to_").unionAll(across).unionAll(full)
    matched = mixed.join(found, ["key", "seg_hi", "seg_lo"]).select("doc", "text_key", (F.col("start") + F.col("from_")).alias("a"), (F.col("start") + F.col("to_") - 1 + length).alias("b"))
    return settled.unionAll(matched).groupBy("doc", "text_key").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["a"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s["b"])
        else:
            out.append((s["a"], s["b"]))
    return out


def _apply(texts: pa.Array, spans: pa.Array) -> pa.Array:
    n, removed, count, kept = [], [], [], []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        gone = merged_spans(found)
        parts, at = [], 0
        for a, b in gone:
            parts.append(text[at:a])
            at = b
        parts.append(text[at:])
        kept.append(b"".join(parts))
        n.append(len(text))
        removed.append(len(text) - len(kept[-1]))
        count.append(len(gone))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, **how: int) -> DataFrame:
    """``row`` (the document), ``n_bytes, n_removed, n_spans`` and ``kept``, the bytes that remain."""
    source = docs.select(rows.packed(docs).alias("row"), rows.doc_number(docs).alias("doc"), F.xxhash64(rows.body(docs)).alias("text_key"), rows.body(docs).cast("binary").alias("body"))
    applied = F.arrow_udf(_apply, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>")
    joined = source.join(repeated_spans(docs, length, **how), ["doc", "text_key"], "left")
    return joined.select("row", applied("body", "spans").alias("r")).select("row", "r.*")


def op9(spark, sf_dir: str) -> DataFrame:
    done = without_repeats(rows.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
