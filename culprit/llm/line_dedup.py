"""Drop lines that an earlier document already has.

Lines become 128-bit hashes of their keys (stripped, A-Z lower-cased). The hashes are dealt out by
ranges of (hash, document) and sorted by hash, document and position; one pass over each sorted
partition keeps the lines of a hash's first document and reports the others. Because the document
is part of the range, a line that a third of all documents hold is spread over many tasks; only
the first and last hash of a partition can continue elsewhere, and two summary rows for each
partition settle those. What comes back is a compressed bitmap of kept lines for each document
that loses any, never text.

Rules: keys under ``min_chars`` code points are always kept; a document that holds the first copy
keeps all its own repeats; rows that share an id are one document; null or empty text is one empty
line; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culprit.functions.storage import stored
from culprit.llm import rows

MIN_CHARS = 10
_WHITE = rows.WHITE_CHARS.encode()
_LINE = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32())])
_FOUND = pa.schema([("kind", pa.int8()), *_LINE])
_DDL = "hi bigint, lo bigint, doc bigint, text_key bigint, pos int"
DROPPED, OPEN, SUMMARY = 0, 1, 2


def long_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a lower-cased line, or None if it is too short to count."""
    key = line.strip(_WHITE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _hashed(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, owner, pos = [], [], []
            for i, text in enumerate(b.column("body").to_pylist()):
                for p, line in enumerate(text.lower().split(b"\n")):
                    if (key := long_key(line, min_chars)) is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        owner.append(i)
                        pos.append(p)
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            at = np.array(owner, dtype=np.int64)
            columns = [h[:, 0], h[:, 1], b.column("doc").to_numpy()[at], b.column("text_key").to_numpy()[at], np.array(pos, dtype=np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=_LINE)

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition. ``run`` is the hash whose lines are being read and its first document."""
    run: tuple[int, int, int] | None = None
    settled = False  # False while the partition's first hash lasts
    for b in batches:
        if not b.num_rows:
            continue
        hi, lo, doc, key, pos = (b.column(n).to_numpy() for n in _LINE.names)
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        carried = run is not None and (int(hi[0]), int(lo[0])) == run[:2]
        new[0] = not carried
        starts = np.flatnonzero(new)
        number = np.cumsum(new) - 1  # -1: the run that goes on from the last batch
        firsts = np.append(doc[starts], run[2] if carried else 0)
        first = firsts[number]  # index -1 is the appended one
        if not settled:
            open_run = -1 if carried else 0
            is_open = number == open_run if (run is None or carried) else np.zeros(len(hi), bool)
        else:
            is_open = np.zeros(len(hi), bool)
        if run is None:
            yield _found(SUMMARY, hi[:1], lo[:1], doc[:1], key[:1], pos[:1])
        if not settled and not is_open.all():
            settled = True
        drop = ~is_open & (doc != first)
        for kind, m in ((OPEN, is_open), (DROPPED, drop)):
            if m.any():
                yield _found(kind, hi[m], lo[m], doc[m], key[m], pos[m])
        run = (int(hi[-1]), int(lo[-1]), int(first[-1]))
    if run is not None:
        one = [np.array([x], dtype=np.int64) for x in run]
        yield _found(SUMMARY, *one, one[0], np.zeros(1, np.int32))


def _found(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int8)), *[pa.array(np.ascontiguousarray(c)) for c in columns]], schema=_FOUND)


def _bitmap(lists: pa.Array) -> pa.Array:
    out = []
    for positions in lists.to_pylist():
        keep = np.ones((max(positions) // 8 + 1) * 8, bool)
        keep[positions] = False
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pa.array(out, pa.binary())


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc, text_key, keep`` for each document that loses lines: a zlib-compressed bitmap, one bit a line
    (1: keep); lines past its end are kept."""
    source = docs.select(rows.doc_number(docs).alias("doc"), F.xxhash64(rows.body(docs)).alias("text_key"), rows.body(docs).cast("binary").alias("body"))
    lines = stored(source.mapInArrow(_hashed(min_chars), _DDL))
    ranged = lines.repartitionByRange("hi", "lo", "doc").sortWithinPartitions("hi", "lo", "doc", "pos")
    found = stored(ranged.mapInArrow(_first_occurrences, f"kind tinyint, {_DDL}"))
    # two rows for each partition of the sort: as small as the plan, whatever the data
    first = found.filter(F.col("kind") == SUMMARY).groupBy("hi", "lo").agg(F.min("doc").alias("first"))
    late = found.filter(F.col("kind") == OPEN).join(F.broadcast(first), ["hi", "lo"]).filter(F.col("doc") != F.col("first"))
    dropped = found.filter(F.col("kind") == DROPPED).select("doc", "text_key", "pos").unionAll(late.select("doc", "text_key", "pos"))
    bitmap = F.arrow_udf(_bitmap, "binary")
    return dropped.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("positions")).select("doc", "text_key", bitmap("positions").alias("keep"))


def _kept_lines(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    gone = set(np.flatnonzero(bits == 0).tolist())
    return len(lines), len(gone), b"\n".join(x for i, x in enumerate(lines) if i not in gone)


def _apply(texts: pa.Array, keeps: pa.Array) -> pa.Array:
    done = [_kept_lines(t, k) for t, k in zip(texts.to_pylist(), keeps.to_pylist(), strict=True)]
    n, dropped, kept = ([x[i] for x in done] for i in range(3))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``row`` (the document), ``n_lines``, ``n_dropped`` and ``kept``, the remaining lines joined by a line feed."""
    source = docs.select(rows.packed(docs).alias("row"), rows.doc_number(docs).alias("doc"), F.xxhash64(rows.body(docs)).alias("text_key"), rows.body(docs).cast("binary").alias("body"))
    applied = F.arrow_udf(_apply, "struct<n_lines:bigint,n_dropped:bigint,kept:binary>")
    joined = source.join(keep_bitmaps(docs, min_chars), ["doc", "text_key"], "left")
    done = joined.select("row", applied("body", "keep").alias("r"))
    return done.select("row", "r.n_lines", "r.n_dropped", F.col("r.kept").cast("string").alias("kept"))


def op2(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(rows.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(parts, i) AS line,
         translate(trim(list_extract(parts, i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), firsts AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE l.doc_id <> f.first) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE f.first IS NULL OR l.doc_id = f.first), '')) AS kept_sha256
FROM lines l LEFT JOIN firsts f ON l.k = f.k GROUP BY l.doc_id
"""
