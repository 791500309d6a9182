"""Which of very many patterns occur in which text: an index of patterns by one short piece each.

A pattern of up to eight bytes is its own piece. A longer one is known by one piece of eight bytes, from
sixteen bytes on by one of sixteen (as a hash): of all its windows the one that fewest windows of other patterns
share. Pieces are numbers, so the index is an ordinary table and is joined like one; nothing about a pattern
is kept anywhere else.

A text is read once. Each position is tested against a filter (two bits a piece, at most ``FILTER_BITS``),
and what passes is found again as rows of (piece, line number): of a short pattern its first line in the
text, of a long one every different surrounding, as far as the longest pattern reaches and never more than the line,
which the join then verifies against the pattern. A line is kept once for all its pieces. The filter and that
reach are all that tasks get of the patterns. The filter only drops work: a wrong "maybe" finds no partner in the join.

Patterns hold no line feed and empty ones are left out; a line feed in a text ends every piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.functions.storage import release, stored

PIECE = 8
LONG, WIDE = 9, 10  # codes of pieces of 8 and of 16 bytes that stand for longer patterns; other codes are lengths
FILTER_BITS = 1 << 25  # of the largest filter; small catalogues take 64 to 128 bits a piece
_BUCKET = 1 << 15  # bits of a bitmap of Spark's bitmap functions
AT_ONCE = 1 << 18
MANY = 1 << 16  # patterns whose table is sorted and merged, however small its files are
PART = 1 << 22  # bytes of the texts of a batch that are worked on together
_FACTORS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

FOUND = "struct<at:array<struct<code:tinyint,piece:bigint,line_no:int,line_at:int,near:binary>>,lines:array<string>>"
_PIECES = pa.list_(pa.struct([("code", pa.int8()), ("piece", pa.int64())]))


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(PIECE, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for at in range(PIECE):
        n = len(out[at::PIECE])
        out[at::PIECE] = np.frombuffer(padded, "<u8", n, at)
    return out


def cut(x: np.ndarray, code: int) -> np.ndarray:
    """The piece of a code at the start of the words."""
    return x & np.uint64((1 << 8 * code) - 1) if code < PIECE else x


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One number for the sixteen bytes of two words that follow each other."""
    return x * np.uint64(_FACTORS[0]) ^ (y ^ y >> np.uint64(31)) * np.uint64(_FACTORS[1])


def place(piece: np.ndarray, code: int, which: int, width: int) -> np.ndarray:
    """One of the two bits of a piece in a filter of ``2^width``: the upper bits of a product that wraps around."""
    factor = np.uint64((_FACTORS[which] + 2 * code * 0x632BE5AB) % 2**64)
    return (piece * factor) >> np.uint64(64 - width)


def _pieces_of(patterns: pa.Array) -> pa.Array:
    """Of each pattern all pieces that it could be known by."""
    out = []
    for p in patterns.to_pylist():
        data = np.frombuffer((p or "").encode(), np.uint8)
        code = len(data) if len(data) <= PIECE else LONG if len(data) < 2 * PIECE else WIDE
        x = words(data)
        found = joined(x[: 1 - 2 * PIECE], x[PIECE : 1 - PIECE]) if code == WIDE else x[: max(1, len(data) - PIECE + 1)]
        out.append([(code, x) for x in np.unique(found).astype(np.int64).tolist()])
    return pa.array(out, _PIECES)


def _places_of(width: int):
    def run(codes: pa.Array, pieces: pa.Array) -> pa.Array:
        code, piece = codes.to_numpy(zero_copy_only=False), pieces.to_numpy(zero_copy_only=False).view(np.uint64)
        out = np.zeros((len(code), 2), np.int64)
        for c in np.unique(code).tolist():
            for which in (0, 1):
                out[code == c, which] = place(piece[code == c], c, which, width)
        return pa.array((out + 1).tolist(), pa.list_(pa.int64()))  # bitmaps count from 1

    return run


@dataclass(frozen=True)
class PatternIndex:
    """``table``: ``code, piece, norm``, one row for each pattern. ``bits``: the filled parts of the filter of ``2^width``.
    ``reach``: bytes of the longest pattern."""

    table: DataFrame
    codes: tuple[int, ...]
    width: int
    bits: Mapping[int, bytes]
    reach: int

    @staticmethod
    def build(norms: DataFrame) -> PatternIndex:
        """The index of the distinct values of a column ``norm``."""
        pieces = F.explode(F.arrow_udf(_pieces_of, "array<struct<code:tinyint,piece:bigint>>")("norm"))
        every = stored(norms.filter("norm <> ''").select("norm", pieces.alias("p")).select("norm", "p.code", "p.piece"))
        # merged: there are several pieces to each pattern, and a plan that takes them for few sends all through the driver
        shared = every.groupBy("code", "piece").agg(F.count("*").alias("shared")).hint("merge")
        rarest = every.join(shared, ["code", "piece"]).groupBy("norm").agg(F.min(F.struct("shared", "code", "piece")).alias("m"))
        table = stored(rarest.select("m.code", "m.piece", "norm"))
        release(every)
        size = table.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("norm")), F.lit(0)).alias("reach")).first()
        width = min(FILTER_BITS.bit_length() - 1, max(15, (64 * size["n"]).bit_length()))
        at = table.select("code", F.explode(F.arrow_udf(_places_of(width), "array<bigint>")("code", "piece")).alias("at"))
        bitmap = F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at")))
        # at most FILTER_BITS / 8 bytes and ten codes, however many patterns there are
        parts = at.groupBy(F.bitmap_bucket_number(F.col("at")).alias("bucket")).agg(bitmap.alias("bitmap"), F.collect_set("code").alias("codes")).collect()
        return PatternIndex(table if size["n"] <= MANY else table.hint("merge"), tuple(sorted({c for r in parts for c in r["codes"]})), width, {r["bucket"]: bytes(r["bitmap"]) for r in parts}, size["reach"])

    def filter(self) -> Filter:
        return Filter(self.codes, self.width, self.bits)

    def hits(self, norm: Column, canonical: Column) -> Column:
        """The pieces of the index in a text ``norm``, what stands ``near`` them, and their lines in ``canonical``, which has as many lines."""
        pieces, reach = self.filter(), self.reach
        return part_by_part(lambda norms, texts: surroundings(norms, texts, pieces, reach), FOUND)(norm, canonical)

    @staticmethod
    def verified(norm_line: Column) -> Column:
        """Whether a row ``_code, _piece`` with this normalised line, or the part of it around the piece, holds the pattern of an index row."""
        held = F.contains(norm_line.cast("binary"), F.col("norm").cast("binary"))
        return (F.col("_code") == F.col("code")) & (F.col("_piece") == F.col("piece")) & ((F.col("code") < LONG) | held)

    def find(self, logs: DataFrame, keep: Sequence[str], outer: bool = False) -> DataFrame:
        """``keep``, ``norm, line_no, line``: the first line of each pattern in each row of ``logs`` (with ``canonical``
        and ``norm``). With ``outer`` a row without a hit stays, and one with hits may stay besides, with NULLs.
        The result is dealt by the first column of ``keep``, so a grouping by it needs no other shuffle."""
        found = logs.select(*keep, self.hits(F.col("norm"), F.col("canonical")).alias("hits"))
        explode = F.explode_outer if outer else F.explode
        pieces = found.select(*keep, F.col("hits.lines").alias("_lines"), explode("hits.at").alias("h"))
        pieces = pieces.select(*keep, F.col("h.code").alias("_code"), F.col("h.piece").alias("_piece"), F.col("h.near").alias("_near"), "h.line_no", F.get("_lines", F.col("h.line_at")).alias("line"))
        rows = pieces.join(self.table, self.verified(F.col("_near")), "left" if outer else "inner")
        # two aggregates: lines are not carried where only their numbers are asked for
        first = rows.repartition(F.col(keep[0])).groupBy(*keep, "norm").agg(F.min("line_no").alias("n"), F.min(F.struct("line_no", "line")).alias("at"))
        some = F.col("norm").isNotNull()
        return first.select(*keep, "norm", F.when(some, F.col("n")).alias("line_no"), F.when(some, F.col("at"))["line"].alias("line"))


class Filter:
    """Which pieces may be in the index. Travels as bitmaps and is unpacked where it is used."""

    def __init__(self, codes: tuple[int, ...], width: int, bits: Mapping[int, bytes]):
        self.codes, self.width, self.bits = codes, width, bits
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def maybe(self, x: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
        """The positions of words ``x`` that may hold a piece of this code, and the pieces."""
        if self.table is None:
            packed = np.zeros(1 << self.width - 3, np.uint8)
            for bucket, bitmap in self.bits.items():
                packed[(bucket - 1) * _BUCKET // 8 : bucket * _BUCKET // 8] = np.frombuffer(bitmap, np.uint8)
            self.table = np.unpackbits(packed, bitorder="little").view(bool)
        piece = cut(x, code)
        at = np.flatnonzero(self.table[place(piece, code, 0, self.width)])
        piece = piece[at]
        ok = self.table[place(piece, code, 1, self.width)]
        return at[ok], piece[ok]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings and where each string starts in them (and the end)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, starts, data = texts.buffers()
    starts = np.frombuffer(starts, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def parts(norms: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """A few texts of a batch after the other, about ``PART`` bytes each."""
    ends = buffers(norms)[1]
    begin = 0
    while begin < len(norms):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + PART, "right")) - 1)
        yield norms.slice(begin, end - begin), texts.slice(begin, end - begin)
        begin = end


def part_by_part(run: Callable[[pa.Array, pa.Array], pa.Array], kind: str) -> Callable[[Column, Column], Column]:
    """``run`` as a function of two columns. What it makes of a part of a batch leaves the task before the next part is
    worked on, so besides the batch that Spark sends a task holds the work and the rows of one part."""

    def every(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from (run(*part) for part in parts(*batch))
            del batch  # before the next one is read

    # not deterministic for the planner only: it would run a scan a second time below, to drop rows without hits
    return F.arrow_udf(every, kind).asNondeterministic()


def in_parts(norms: pa.Array, texts: pa.Array, run: Callable[[pa.Array, pa.Array], pa.Array]) -> pa.Array:
    """``run`` on a part of a batch after the other."""
    return pa.concat_arrays([run(*part) for part in parts(norms, texts)] or [run(norms, texts)])


def _found(norms: pa.Array, pieces: Filter) -> tuple[np.ndarray, ...]:
    """``at, code, piece, row, number, begin, end`` of what may be a piece, by row, code, piece and place: ``number`` from 0,
    ``begin`` and ``end`` of the line."""
    data, starts = buffers(norms)
    found: dict[str, list[np.ndarray]] = {"at": [], "code": [], "piece": []}
    for begin in range(0, len(data), AT_ONCE):
        n = min(AT_ONCE, len(data) - begin)
        x = np.append(words(data[begin : begin + AT_ONCE + 2 * PIECE]), np.zeros(PIECE, np.uint64))
        for code in pieces.codes:
            at, piece = pieces.maybe(joined(x[:n], x[PIECE : n + PIECE]) if code == WIDE else x[:n], code)
            found["at"].append(at + begin)
            found["piece"].append(piece.view(np.int64))
            found["code"].append(np.full(len(at), code, np.int8))
    at, code, piece = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in found.values())
    feeds = np.flatnonzero(data == 10)
    row = np.searchsorted(starts, at, "right") - 1
    before = np.searchsorted(feeds, at)
    ends = np.minimum(starts[row + 1], np.append(feeds, len(data))[before])
    begins = np.maximum(starts[row], np.append(-1, feeds)[before] + 1)
    inside = at + np.where(code == WIDE, 2 * PIECE, np.minimum(code, PIECE)) <= ends  # neither the text nor the line ends within the piece
    number = before - np.searchsorted(feeds, starts[row])
    order = np.flatnonzero(inside)
    order = order[np.lexsort((at[order], piece[order], code[order], row[order]))]
    return tuple(x[order] for x in (at, code, piece, row, number, begins, ends))


def _again(*keys: np.ndarray) -> np.ndarray:
    """Which elements have the same keys as the one before."""
    same = np.ones(len(keys[0]), bool)
    for k in keys:
        same[1:] &= k[1:] == k[:-1]
    same[:1] = False
    return same


def scan(norms: pa.Array, texts: pa.Array, pieces: Filter, every: bool = False) -> pa.Array:
    """Pieces of all texts of a batch with their lines. Of a code below ``LONG`` the first line of each piece in a text,
    of others each different line; with ``every`` all lines."""
    return in_parts(norms, texts, lambda n, t: _scan(n, t, pieces, every))


def _scan(norms: pa.Array, texts: pa.Array, pieces: Filter, every: bool) -> pa.Array:
    _, code, piece, row, number, _, _ = _found(norms, pieces)
    same = _again(row, code, piece)
    again = same & ((code < LONG) & (not every) | _again(number))
    code, piece, row, number, same = code[~again], piece[~again], row[~again], number[~again], same[~again]
    lines = _lines(texts, row, number)
    wanted, seen = np.ones(len(row), bool), set()
    for i in () if every else np.flatnonzero(code >= LONG).tolist():
        if not same[i]:
            seen = set()
        if lines[i] in seen:
            wanted[i] = False
        seen.add(lines[i])
    counts = np.bincount(row[wanted], minlength=len(norms))
    line = pa.array([x for x, w in zip(lines, wanted.tolist(), strict=True) if w], pa.binary()).cast(pa.string())
    items = pa.StructArray.from_arrays([pa.array(code[wanted], pa.int8()), pa.array(piece[wanted], pa.int64()), pa.array(number[wanted] + 1, pa.int32()), line], names=["code", "piece", "line_no", "line"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), items)


def surroundings(norms: pa.Array, texts: pa.Array, pieces: Filter, reach: int) -> pa.Array:
    """Pieces of all texts of a batch, with each line that holds one once. Of a code below ``LONG`` the first line of each
    piece in a text; of others each different surrounding within ``reach`` bytes."""
    return in_parts(norms, texts, lambda n, t: _surroundings(n, t, pieces, reach))


def _surroundings(norms: pa.Array, texts: pa.Array, pieces: Filter, reach: int) -> pa.Array:
    data, _ = buffers(norms)
    at, code, piece, row, number, begins, ends = _found(norms, pieces)
    same = _again(row, code, piece)
    low = np.maximum(begins, at - reach)
    high = np.minimum(ends, at + reach)
    # where the surroundings of a piece in a line add up to the line, the line stands for them
    group = np.cumsum(~(same & _again(number))) - 1
    whole = np.bincount(group, high - low)[group] >= ends - begins if len(group) else np.zeros(0, bool)
    low, high = np.where(whole, begins, low), np.where(whole, ends, high)
    wanted = ~(same & ((code < LONG) | whole & _again(group)))
    near, seen = [], set()
    for i in np.flatnonzero(wanted).tolist():
        if code[i] < LONG:
            near.append(None)
            continue
        if not same[i]:
            seen = set()
        part = data[low[i] : high[i]].tobytes()
        if part in seen:
            wanted[i] = False
            continue
        seen.add(part)
        near.append(part)
    code, piece, row, number = code[wanted], piece[wanted], row[wanted], number[wanted]
    lines, which = np.unique(np.stack([row, number]), axis=1, return_inverse=True) if len(row) else (np.zeros((2, 0), np.int64), row)
    starts = np.append(0, np.cumsum(np.bincount(lines[0], minlength=len(norms))))
    line = pa.array(_lines(texts, lines[0], lines[1]), pa.binary()).cast(pa.string())
    counts = np.append(0, np.cumsum(np.bincount(row, minlength=len(norms))))
    items = pa.StructArray.from_arrays([pa.array(code, pa.int8()), pa.array(piece, pa.int64()), pa.array(number + 1, pa.int32()), pa.array(which.reshape(-1) - starts[row], pa.int32()), pa.array(near, pa.binary())], names=["code", "piece", "line_no", "line_at", "near"])
    out = [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), line)]
    return pa.StructArray.from_arrays(out, names=["at", "lines"])


def _lines(texts: pa.Array, row: np.ndarray, number: np.ndarray) -> list[bytes]:
    """The lines of some (text, line number from 0)."""
    data, starts = buffers(texts)
    feeds = np.append(np.flatnonzero(data == 10), len(data))
    at = np.searchsorted(feeds, starts[row]) + number
    begin = np.where(number > 0, feeds[at - 1] + 1, starts[row])
    end = np.minimum(feeds[at], starts[row + 1])
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
