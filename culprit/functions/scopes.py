"""Scopes of source lines: the name a line stands under and its brace depth, whole batches at a time.

Depth before a line is the sum of the braces above it in its file. A line belongs to the last name opened
at or above it (a func, after a receiver, a function or a binding) until the depth is back at what it was
before that name. All is worked out in the row of the file, before lines become rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from culprit.operators.pattern_index import Filter, buffers, part_by_part, scan

_CALLED = re.compile(r"(?:func (?:\([^)]*\)\s*)?|function )([^(]*)\(", re.ASCII)
_BOUND = re.compile(r"(?:const|let|var) \s*(\S+)", re.ASCII)
_BLANK = " \t\n\x0b\f\r"
_IS_BLANK = np.isin(np.arange(256), np.frombuffer(_BLANK.encode(), np.uint8))
_FIRST = np.isin(np.arange(256), np.frombuffer(b"fclv", np.uint8))


def opened_name(line: str) -> str:
    """Name that a line opens a scope with, else the empty string."""
    bare = line.strip(_BLANK)
    m = _CALLED.match(bare)
    if m and (name := m.group(1).strip(" ")):
        return name
    m = _BOUND.match(bare)
    return m.group(1).removesuffix("=") if m else ""


class Layout:
    """The lines of a batch of texts: where each begins and ends, depth and owner."""

    def __init__(self, texts: pa.Array):
        self.data, files = buffers(texts)
        feeds = np.flatnonzero(self.data == 10)
        count = 1 + np.diff(np.searchsorted(feeds, files))
        self.first = np.append(0, np.cumsum(count))  # number of the first line of each text
        opens = np.zeros(self.first[-1], bool)
        opens[self.first[:-1]] = True
        self.begin = np.empty(len(opens), np.int64)
        self.begin[opens], self.begin[~opens] = files[:-1], feeds + 1
        self.end = np.append(self.begin[1:], 0) - 1
        self.end[self.first[1:] - 1] = files[1:]
        braces = np.append(0, np.cumsum((self.data == ord("{")).astype(np.int32) - (self.data == ord("}"))))
        ground = np.repeat(braces[files[:-1]], count)
        self.depth = braces[self.begin] - ground
        self._own(braces[self.end] - ground, np.repeat(self.first[1:], count))

    def line(self, number: int) -> str:
        return self.data[self.begin[number] : self.end[number]].tobytes().decode()

    def _own(self, after: np.ndarray, last: np.ndarray) -> None:
        """``owner``: for each line the number of its name in ``names``, or -1."""
        shown = np.append(np.flatnonzero(~_IS_BLANK[self.data]), len(self.data))
        starts = shown[np.searchsorted(shown, self.begin)]
        maybe = np.flatnonzero(starts < self.end)
        maybe = maybe[_FIRST[self.data[starts[maybe]]]]
        found = [(n, name) for n in maybe.tolist() if (name := opened_name(self.line(n)))]
        self.names = [name for _, name in found]
        self.owner = np.full(len(self.begin), -1, np.int64)
        for i, (n, _) in enumerate(found):
            stop = int(last[n]) if i + 1 == len(found) else min(int(last[n]), found[i + 1][0])
            closed = np.flatnonzero(after[n:stop] <= self.depth[n])
            self.owner[n : n + int(closed[0]) + 1 if len(closed) else stop] = i

    def functions(self, lines: np.ndarray) -> list[str]:
        return [self.names[i] if i >= 0 else "" for i in self.owner[lines].tolist()]


def _all_lines(texts: pa.Array) -> pa.Array:
    at = Layout(texts)
    every = np.arange(len(at.begin))
    number = every - np.repeat(at.first[:-1], np.diff(at.first)) + 1
    original = pa.array([at.line(n) for n in every.tolist()], pa.string())
    items = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), original, pa.array(at.functions(every), pa.string()), pa.array(at.depth.astype(np.int32))], names=["line", "original", "function", "depth"])
    return pa.ListArray.from_arrays(pa.array(at.first, pa.int32()), items)


def source_lines(content: Column) -> Column:
    """All lines of a text with line feeds: ``array<struct<line, original, function, depth>>``."""
    return F.arrow_udf(_all_lines, "array<struct<line:int,original:string,function:string,depth:int>>").asNondeterministic()(content)


def lines_with_pieces(pieces: Filter, norm: Column, content: Column) -> Column:
    """Every line of a text that may hold a pattern of an index, with its scope: ``array<struct<code, piece, line_no, line,
    function, depth>>``. ``norm`` is the normalised text with as many lines."""

    def run(norms: pa.Array, texts: pa.Array) -> pa.Array:
        hits = scan(norms, texts, pieces, every=True)
        counts = np.diff(hits.offsets.to_numpy())
        at = Layout(texts.filter(pa.array(counts > 0)))  # texts without such lines need no scopes
        lines = hits.flatten()
        number = lines.field("line_no").to_numpy(zero_copy_only=False) - 1 + np.repeat(at.first[:-1], counts[counts > 0])
        fields = [*lines.flatten(), pa.array(at.functions(number), pa.string()), pa.array(at.depth[number].astype(np.int32))]
        return pa.ListArray.from_arrays(hits.offsets, pa.StructArray.from_arrays(fields, names=["code", "piece", "line_no", "line", "function", "depth"]))

    kind = "array<struct<code:tinyint,piece:bigint,line_no:int,line:string,function:string,depth:int>>"
    return part_by_part(run, kind)(norm, content)
