"""SentencePiece BPE encoding and decoding with a table of prefixes.

Pieces that stand next to each other in an encoding are the encoding of what they cover, and pieces
are an encoding if each one and each neighbouring pair are. So the encoding of every prefix ends in
one certain piece: the piece that ends there, is the encoding of itself and goes with the last piece
of the prefix before it. An automaton over the vocabulary names the pieces that end at each
position, a remembered test says which pairs go together, and the table holds one piece for each
position. The ids are then read from the end backwards.

The model is a BPE model with byte fallback, a leading space and no other normalisation; a model that
the probes of ``PROBES`` show to behave otherwise is refused. Characters that no piece knows become
their UTF-8 bytes. Texts are cut where no piece can lie across: before a space mark that follows
another character, before a sign after a letter, and around characters that are in no longer
piece, as far as the vocabulary has no piece that says otherwise.

Null text is empty: no ids. Memory is bounded: remembered words and pairs are dropped when there are
too many, and the table of a word has one number for each character, whatever the length of the text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.llm import rows

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MAX_WORDS = 500_000
MAX_WORD_CHARS = 48
MAX_PAIRS = 1_000_000
CHUNK = 1 << 20
PROBES = ("", " ", "a  b ", "▁a", "ﬁ Å\n\t　\U0001f9ff")
UNKNOWN = -1
NEVER = 1 << 62


class Pieces:
    """The vocabulary: ids, ranks of merges (equal scores have equal ranks) and what may stand together."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(model.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.id = {t: i for i, t in self.text.items()}
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.rank = {t: rank[model.get_score(i)] for i, t in self.text.items()}
        self.size = {i: len(t) for i, t in self.text.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.trees: dict[str, tuple[str, str] | None] = {}
        self.spines: dict[tuple[int, int], tuple] = {}
        self.together: dict[int, bool] = {}

    def merged(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """What merging leaves, best rank and then leftmost first, and the two parts of the last merge."""
        last = None
        while len(symbols) > 1:
            best, at = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == NEVER:
                break
            last = symbols[at], symbols[at + 1]
            symbols[at : at + 2] = ["".join(last)]
        return symbols, last

    def tree(self, piece: str) -> tuple[str, str] | None:
        """The two parts that a piece is merged from; None if it is one character or no encoding of itself."""
        if piece not in self.trees:
            left, parts = self.merged(list(piece))
            self.trees[piece] = parts if len(left) == 1 else None
        return self.trees[piece]

    def whole(self, piece: str) -> bool:
        return len(piece) == 1 or self.tree(piece) is not None

    def spine(self, token: int, side: int) -> tuple[bool, tuple[tuple[str, int, int], ...]]:
        """The parts that stand at the left (0) or right (1) end of a piece while it is merged: text, rank it comes
        with and rank it goes with. The first value says whether ranks rise from part to whole."""
        known = self.spines.get((token, side))
        if known is None:
            part, until, rising, out = self.text[token], NEVER, True, []
            while True:
                came = -1 if len(part) == 1 else self.rank[part]
                rising &= came < until
                out.append((part, came, until))
                if (parts := self.tree(part)) is None:
                    break
                part, until = parts[side], came
            known = self.spines[token, side] = rising, tuple(out)
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left``: it is an encoding of itself, and no merge across the border is made
        while both its parts stand there."""
        if not self.whole(self.text[right]):
            return False
        if left == UNKNOWN:
            return True
        (rising, ends), (rises, starts) = self.spine(left, 1), self.spine(right, 0)
        sure = rising and rises
        for x, x_came, x_until in ends if sure else ():
            for y, y_came, y_until in starts:
                rank = self.rank.get(x + y)
                if rank is not None and rank < x_until and rank <= y_until:
                    if rank > x_came and rank > y_came:
                        return False
                    sure = False
        a, b = self.text[left], self.text[right]
        return sure or self.merged(list(a + b))[0] == [a, b]

    def may_follow(self, left: int, right: int) -> bool:
        if len(self.together) >= MAX_PAIRS:
            self.together.clear()
        known = self.together[left << 32 | right] = self.fits(left, right)
        return known

    def table(self, word: str) -> list[int]:
        """The last piece of every prefix; ``UNKNOWN`` where a character is no piece."""
        last: list[int] = []
        known, settled = self.together.get, 0
        for end, (size, token) in self.automaton.iter(word):
            if end < settled:
                continue
            if end > settled:
                last += [UNKNOWN] * (end - settled)
                settled = end
            before = last[end - size] if end >= size else UNKNOWN
            ok = known(before << 32 | token)
            if ok or ok is None and self.may_follow(before, token):
                last.append(token)
                settled += 1
        return last + [UNKNOWN] * (len(word) - settled) if settled < len(word) else last

    def encode(self, word: str) -> list[int]:
        last, out, at = self.table(word), [], len(word)
        while at:
            token = last[at - 1]
            if token == UNKNOWN:
                out += [self.bytes[b] for b in reversed(word[at - 1].encode())]
                at -= 1
            else:
                out.append(token)
                at -= self.size[token]
        return out[::-1]


class Words(dict):
    """Ids of words as unsigned 32-bit integers; the words of the last generation are kept
    while a new one fills."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.last: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.last.get(word)
        if ids is None:
            ids = array("I", self.pieces.encode(word)).tobytes()
            if len(word) > MAX_WORD_CHARS:
                return ids
        if len(self) >= MAX_WORDS:
            self.last = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Codec:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.words = Words(self.pieces)
        longer = [t for t in self.pieces.id if len(t) > 1]
        joined = {c for t in longer for c in t} - {SPACE}
        #: Words: what no piece can reach across. Where pieces hold a space mark after another character, there are no words.
        split = not any(SPACE in t.lstrip(SPACE) for t in longer) and joined
        letters = {c for c in joined if c.isalnum()}
        signs, after = joined - letters, {b for t in longer for a, b in zip(t, t[1:], strict=False) if a in letters and b not in letters}

        def some(chars: set[str]) -> str:
            return f"[{re.escape(''.join(sorted(chars)))}]" if chars else "(?!)"

        # a letter is followed by letters and by the signs that follow a letter in some piece
        word = f"{SPACE}*{some(signs)}*(?:{some(letters)}+(?:{some(after)}{some(signs)}*)?)+|{SPACE}*{some(signs)}+"
        self.word = re.compile(f"{word}|{SPACE}+|[^{SPACE}]" if split else r"(?s).+")
        self.cut = re.compile(r"[^ ▁](?=[ ▁])") if split else None
        self.shown = {i: t.replace(SPACE, " ") for i, t in self.pieces.text.items()}
        self.shown[self.pieces.unknown] = " ⁇ "
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for text in PROBES:
            ids = [i for some in self.encode_parts(text) for i in some]
            if ids != model.encode(text) or "".join(self.decode_parts([ids])) != model.decode(ids):
                raise ValueError("the model does not work like BPE with byte fallback, a leading space and no normalisation")

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about CHUNK characters that no piece reaches across."""
        at = 0
        while self.cut and len(text) - at > CHUNK:
            m = self.cut.search(text, at + CHUNK)
            if m is None:
                break
            yield text[at : m.end()]
            at = m.end()
        yield text[at:] if at else text

    def encode_parts(self, text: str) -> Iterator[list[int]]:
        get = self.words.__getitem__
        for n, part in enumerate(self.parts(text)):
            if part:
                marked = part.replace(" ", SPACE)
                ids = array("I")
                ids.frombytes(b"".join(map(get, self.word.findall(marked if n else SPACE + marked))))
                yield ids.tolist()

    def decode_parts(self, parts: Iterable[list[int]]) -> Iterator[str]:
        """The text of ids that come in parts. Runs of byte pieces are read as UTF-8, each odd byte as U+FFFD; one
        leading space goes; control pieces have no text."""
        held, begun, shown, byte_of = bytearray(), False, self.shown, self.pieces.byte_of
        for ids in parts:
            out = []
            for i in ids:
                t = shown.get(i)
                if t is None:
                    if i in byte_of:
                        held.append(byte_of[i])
                        begun = True
                    continue
                if held:
                    out.append(utf8(held))
                    held = bytearray()
                out.append(t if begun or not t.startswith(" ") or i == self.pieces.unknown else t[1:])
                begun = True
            yield "".join(out)
        yield utf8(held)


def utf8(data: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte that is part of no character."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out += data[: e.start].decode(), "\ufffd"
            data = data[e.start + 1 :]
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str | None) -> Codec:
    """One for each Python worker."""
    path = path or public_tokenizers.path(MODEL)
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(text: Column, path: str | None = None) -> Column:
    """``array<int>`` of ids of a string column; null text gives an empty array."""

    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([[i for some in c.encode_parts(t or "") for i in some] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of an id array; null gives an empty text."""

    def run(lists: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array(["".join(c.decode_parts([x or []])) for x in lists.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(ids)


DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def digests(text: Column, path: str | None = None) -> Column:
    """Number of ids and SHA-256 of the ids and of the text that they decode to, part by part."""

    def one(c: Codec, text: str) -> tuple[int, str, str]:
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

        def encoded() -> Iterator[list[int]]:
            nonlocal n
            for ids in c.encode_parts(text):
                of_ids.update((("," if n else "") + ",".join(map(str, ids))).encode())
                n += len(ids)
                yield ids

        for some in c.decode_parts(encoded()):
            of_text.update(some.encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        done = [one(c, t or "") for t in texts.to_pylist()]
        columns = [pa.array([x[i] for x in done], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.arrow_udf(run, DIGEST)(text)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents")
    return docs.select("doc_id", digests(F.col("text")).alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
