"""Byte-level BPE as a transducer that is built while it is used.

Two facts make merges a left-to-right machine. Every run of neighbouring tokens of an encoding is
itself the encoding of its bytes, and a sequence of tokens is an encoding if each neighbouring pair
is. So the encoding of a prefix ends in the one token that is a suffix of it and goes with the
token before. A state is therefore (right edge of the last settled token, bytes still open); reading a
byte finds the token that ends there. Positions from which a longer token could still start are alive; what the
splits of all live positions have in common is settled and emitted. Each (state, byte) is worked
out once and remembered (lazy determinisation).

The text is cut by the pattern first, and a piece that is a token itself is taken whole, as the
tiktoken library does. Decoding looks ids up and passes the bytes through a UTF-8 state machine
that holds back an unfinished character between chunks.

Null text is empty: no tokens. Memory is bounded: remembered states and pieces are dropped when
there are too many, and long texts are cut between a non-space and a space, where no match of the
pattern can lie across.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.llm import rows

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MAX_STATES = 500_000
MAX_PIECES = 200_000
MAX_PIECE_BYTES = 64
CHUNK = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """States are numbers. Of each: the right edge of the last settled token, the open bytes, the token that ends
    after each open byte, where the first open token ends on the way there, and the positions from
    which the open bytes begin a longer token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        #: For tokens and beginnings of tokens: the token or -1, and whether a longer token begins so.
        self.known = {t[:i]: (-1, True) for t in ranks for i in range(1, len(t))}
        self.known.update({t: (r, t in self.known) for t, r in ranks.items()})
        self.edges: tuple[dict[int, tuple], dict[int, tuple]] = {}, {}
        self.rights: dict[int, tuple] = {}
        self.same: dict[tuple, tuple] = {}
        self.whole: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        none = self.numbered(())
        self.states: list[tuple] = [(none, b"", (), b"", b"")]
        self.number = {none[0]: 0}
        self.step: dict[int, int] = {}  # state and byte to the next state, or to ~i where tokens are emitted:
        self.emitting: list[tuple[int, tuple[int, ...]]] = []  # the i-th next state with its tokens

    def numbered(self, edge: tuple) -> tuple[bytes, tuple]:
        """A right edge with a short name; open bytes and this name make the key of a state."""
        return self.same.setdefault(edge, (len(self.same).to_bytes(4, "little"), edge))

    def parts(self, data: bytes, below: int) -> list[bytes]:
        """What the merges with a rank under ``below`` make of the bytes of one token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(found)
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: int, side: int) -> tuple[tuple[bytes, int], ...]:
        """The parts that stood at the left (0) or right (1) end while the token was merged, each with the
        rank of the merge that took it up."""
        known = self.edges[side].get(token)
        if known is None:
            data = self.token[token]
            known = ((data, 1 << 40),)
            if len(data) > 1 and len(two := self.parts(data, token)) == 2:
                (first, _), *rest = self.edge(self.ranks[two[side]], side)
                known += ((first, token), *rest)
            self.edges[side][token] = known
        return known

    def is_whole(self, token: int) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = len(self.parts(self.token[token], 1 << 40)) == 1
        return ok

    def right_edge(self, token: int) -> tuple[bytes, tuple]:
        """The parts at the right end of a token that some merge takes as its left part. Tokens with equal right
        edges need not be told apart any more, so this stands for the settled token in a state."""
        known = self.rights.get(token)
        if known is None:
            edge = tuple([(x, until) for x, until in self.edge(token, 1) if self.known[x][1]])
            known = self.rights[token] = self.numbered(edge)
        return known

    def goes_after(self, left: tuple[tuple[bytes, int], ...], right: int) -> bool:
        """Whether a token with this right edge and ``right`` are an encoding: no merge across the boundary comes
        while both its parts stand there. Of equal ranks the leftmost merge is first."""
        rank = self.ranks.get
        edge = self.edge(right, 0)
        for x, x_until in left:
            for y, y_until in edge:
                r = rank(x + y)
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def split(self, ends: tuple[int, ...], at: int) -> list[int]:
        """The tokens that lead to position ``at``."""
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= self.size[ends[at - 1]]
        return out[::-1]

    def ending(self, state: int, data: bytes) -> tuple[int, int, list[int]]:
        """Of the open bytes and one more: the token that ends there, where it starts, and the live positions."""
        left, _, ends, _, live_before = self.states[state]
        last, start, live = -1, 0, []
        get, whole, rights = self.known.get, self.whole.get, self.rights.get
        for at in (*live_before, len(data) - 1):  # from the longest ending on
            token, begins = get(data[at:], (-1, False))
            if begins:
                live.append(at)
            if last < 0 <= token and (whole(token) or self.is_whole(token)):
                edge = left if not at else rights(ends[at - 1])
                if edge is None:
                    edge = self.right_edge(ends[at - 1])
                if not edge[1] or self.goes_after(edge[1], token):
                    last, start = token, at
        if last < 0:
            raise ValueError("a byte is missing from the vocabulary")
        return last, start, live

    def built(self, state: int, byte: int) -> int:
        left, data, ends, roots, _ = self.states[state]
        data += bytes((byte,))
        n = len(data)
        last, start, live = self.ending(state, data)
        root = roots[start - 1] if start else n
        ends, roots = (*ends, last), (*roots, root)
        emitted: tuple[int, ...] = ()
        # as long as all that can still happen begins with the same token, that token is settled
        while n and not (live and live[0] == 0):
            first = roots[-1]
            for at in live:
                if roots[at - 1] != first:
                    break
            else:
                emitted += (ends[first - 1],)
                left = self.right_edge(ends[first - 1])
                data, ends, live, n = data[first:], ends[first:], [at - first for at in live], n - first
                again: list[int] = []
                for i, token in enumerate(ends, 1):
                    before = i - self.size[token]
                    again.append(again[before - 1] if before > 0 else i)
                roots = tuple(again)
                continue
            break
        key = data + left[0]
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            pack = bytes if n < 256 else tuple  # positions, in as little memory as they fit
            self.states.append((left, data, ends, pack(roots), pack(live)))
        if emitted:
            self.emitting.append((to, emitted))
            to = ~(len(self.emitting) - 1)
        self.step[state << 8 | byte] = to
        return to

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > MAX_STATES:
            self.clear()
        state, out, get = 0, [], self.step.get
        for n, byte in enumerate(piece[:-1], 1):
            to = get(state << 8 | byte)
            if to is None:
                to = self.built(state, byte)
            if to < 0:
                state, emitted = self.emitting[~to]
                out += emitted
            else:
                state = to
            if not n % CHUNK and len(self.states) > MAX_STATES:  # one endless piece: go on from a copy of the state
                kept = self.states[state]
                self.clear()
                get = self.step.get
                if kept[0][1] or kept[1]:
                    self.states.append(kept)
                    self.number[kept[1] + kept[0][0]] = 1
                state = len(self.states) - 1
        # nothing follows the last byte: its token ends the encoding and needs no state
        _, data, ends, _, _ = self.states[state]
        last, start, _ = self.ending(state, data + piece[-1:])
        return out + self.split(ends, start) + [last]


class Pieces(dict):
    """Ids of a piece as little-endian unsigned 32-bit integers; the pieces of the last generation are kept
    while a new one fills."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine
        self.last: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.last.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            whole = self.machine.ranks.get(data)
            ids = np.array([whole] if whole is not None else self.machine.encode(data), dtype="<u4").tobytes()
            if len(data) > MAX_PIECE_BYTES:
                return ids
        if len(self) >= MAX_PIECES:
            self.last = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Utf8Stream:
    """An incremental UTF-8 state machine: ``feed`` gives the characters that are complete so far.

    The state is the number of bytes still missing from the last character and the bytes held back.
    Bytes that cannot continue a character come out as U+FFFD.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def missing(data: bytes) -> int:
        """How many bytes at the end belong to a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if b >> 5 == 6 else 3 if b >> 4 == 14 else 4 if b >> 3 == 30 else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.missing(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class Codec:
    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(read_ranks(path))
        self.pieces = Pieces(self.machine)
        self.pattern = regex.compile(pattern)
        self.cut = regex.compile(r"\S(?=\s)")
        tokens = [self.machine.token.get(i, b"") for i in range(max(self.machine.token) + 1)]
        self.all_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about CHUNK characters that the pattern treats alike."""
        at = 0
        while len(text) - at > CHUNK:
            m = self.cut.search(text, at + CHUNK)
            if m is None:
                break
            yield text[at : m.end()]
            at = m.end()
        yield text[at:] if at else text

    def encode_parts(self, text: str) -> Iterator[bytes]:
        for part in self.parts(text):
            yield b"".join(map(self.pieces.__getitem__, self.pattern.findall(part)))

    def decode_parts(self, parts: Iterable[bytes]) -> Iterator[bytes]:
        for some in parts:
            ids = np.frombuffer(some, "<u4")
            size = self.sizes[ids]
            ends = np.cumsum(size)
            yield self.all_bytes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - ends + size, size)].tobytes()

    def decode_text(self, ids: bytes) -> str:
        stream = Utf8Stream()
        out = [stream.feed(x) for x in self.decode_parts(ids[i : i + 4 * CHUNK] for i in range(0, len(ids), 4 * CHUNK))]
        return "".join(out) + stream.end()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def encode(text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """``array<int>`` of ids of a string column; null text gives an empty array."""

    def run(texts: pa.Array) -> pa.Array:
        c = codec(path or default_path(), pattern)
        return pa.array([np.frombuffer(b"".join(c.encode_parts(t or "")), "<i4") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of an id array; bytes that are no UTF-8 come out as U+FFFD."""

    def run(lists: pa.Array) -> pa.Array:
        c = codec(path or default_path(), public_tokenizers.PATTERN)
        return pa.array([c.decode_text(np.array(x or [], "<u4").tobytes()) for x in lists.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(ids)


DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def digests(text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: bool = True) -> Column:
    """Number of tokens and SHA-256 of the ids and of the bytes that they decode to, chunk by chunk.

    ``keep``: a worker keeps its states and pieces for its next task. Without, it gives the memory back after
    each task, for pipelines whose other stages use the same workers."""

    def one(c: Codec, text: str) -> tuple[int, str, str]:
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for ids in c.encode_parts(text):
            n += len(ids) // 4
            of_ids.update(ids)
            for data in c.decode_parts((ids,)):
                of_bytes.update(data)
        return n, of_ids.hexdigest(), of_bytes.hexdigest()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path or default_path(), pattern)
        try:
            for texts in batches:
                done = [one(c, t or "") for t in texts.to_pylist()]
                columns = [pa.array([x[i] for x in done], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            if not keep:
                c.machine.clear()
                c.pieces.clear()
                c.pieces.last = {}

    return F.arrow_udf(run, DIGEST)(text)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents")
    return docs.select("doc_id", digests(F.col("text")).alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
