"""Document quality from a linear-chain conditional random field over lines.

Every line has features of its own bytes (letter case, symbols, punctuation, word lengths, repeated
words) and of the lines before and after it. A chain with the states bad and good scores each line
by these and each pair of neighbours by four transition weights; forward-backward gives the
probability that a line is good, and the mean of these over lines, weighted by their length, is the
quality of the document. A logistic curve fitted on the training documents turns it into a score in
which 0.7 is the cut between the labels.

Training: labels are of documents, so lines start with the label of their document; after each fit
the lines of a bad document that look good are set good (its worst line stays bad), and the chain
is fitted again. At most ``TRAIN_DOCS`` labelled documents of at most ``TRAIN_LINES`` lines take part,
those with the smallest hashes; these bounds are parameters, scoring covers all rows and whole
texts. Only features reach the driver, never texts.

Rules: null text is one empty line; without labels of both kinds every score is 0.5; several labels
of a document count each; labels, languages, sources and ids are never inputs of a score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.llm import rows

TRAIN_DOCS, TRAIN_LINES = 3_000, 200
ROUNDS, STEPS, RATE, DECAY = 3, 120, 0.1, 1e-3
CUT = 0.7

SPACE, LOWER, UPPER, DIGIT, POINT, BANG, PIPE, SYMBOL = range(8)
_CLASS = np.full(256, SYMBOL, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[128:] = LOWER  # letters beyond ASCII; their second bytes too
_CLASS[97:123] = LOWER
_CLASS[65:91] = UPPER
_CLASS[48:58] = DIGIT
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = POINT
_CLASS[ord("!")] = BANG
_CLASS[ord("|")] = PIPE
OWN = 15  # features of a line itself
SEEN_BESIDE = np.array([0, 1, 2, 3, 4, 6, 8, 9, 12])  # those that the neighbours also get
WIDTH = OWN + 2 * len(SEEN_BESIDE) + 3


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line (float32) and its length in bytes."""
    data = np.frombuffer(text, np.uint8)
    breaks = np.flatnonzero(data == 10)
    first, end = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(data)]))
    n = len(first)
    size = end - first
    kind = _CLASS[data]
    # capitals with accents of the Latin-1 block
    if len(data) > 1:
        kind[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] = UPPER
    line = np.repeat(np.arange(n), np.concatenate((np.diff(first), [len(data) - first[-1]])))
    count = np.bincount(line * 8 + kind, minlength=n * 8).reshape(n, 8).astype(np.float64)
    solid = np.maximum(1.0, count[:, 1:].sum(1))
    letters = np.maximum(1.0, count[:, LOWER] + count[:, UPPER])
    space = kind == SPACE
    odd = kind >= BANG
    by_line = lambda m, at: np.bincount(line[at:][m], minlength=n)[:n]
    starts = ~space
    starts[1:] &= space[:-1]
    words = np.maximum(1.0, by_line(starts, 0))
    twice = by_line(odd[1:] & (data[1:] == data[:-1]), 1) if len(data) > 1 else np.zeros(n)
    after_letter = by_line(odd[1:] & ((kind[:-1] == LOWER) | (kind[:-1] == UPPER)), 1) if len(data) > 1 else np.zeros(n)
    distinct = np.array([len(set(w)) / len(w) if (w := x.split()) else 1.0 for x in text.split(b"\n")])
    last = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(n, np.uint8)
    begin = kind[np.minimum(first, max(0, len(data) - 1))] if len(data) else np.zeros(n, np.uint8)
    own = np.column_stack([
        count[:, UPPER] / letters, count[:, SYMBOL] / solid, count[:, POINT] / solid, count[:, PIPE] / solid, count[:, BANG] / solid, count[:, DIGIT] / solid,
        letters / solid, np.log1p(words), solid / words / 10, twice / solid, distinct, np.isin(last, [46, 63, 33]), after_letter / words, begin == UPPER, np.log1p(size),
    ])
    beside = own[:, SEEN_BESIDE]
    none = np.zeros((1, len(SEEN_BESIDE)))
    edge = np.zeros((n, 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.column_stack([own, np.vstack([none, beside[:-1]]), np.vstack([beside[1:], none]), edge, size == 0]).astype(np.float32), size


class Model:
    """Weights of good against bad for each feature, log transition weights [from, to], and the score curve."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.moves, self.slope, self.shift = weights, moves, slope, shift

    def unary(self, features: np.ndarray) -> np.ndarray:
        return np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)

    def marginals(self, unary: np.ndarray) -> np.ndarray:
        """Probability of good for each line: forward and backward odds of good against bad."""
        (bb, bg), (gb, gg) = np.exp(self.moves).tolist()
        e = np.exp(unary).tolist()
        n = len(e)
        forward, odds = [0.0] * n, e[0]
        forward[0] = odds
        for i in range(1, n):
            odds = forward[i] = e[i] * (bg + gg * odds) / (bb + gb * odds)
        out, odds = [0.0] * n, 1.0
        for i in range(n - 1, -1, -1):
            both = forward[i] * odds
            out[i] = both / (1 + both)
            ahead = e[i] * odds
            odds = (gb + gg * ahead) / (bb + bg * ahead)
        return np.array(out)

    def quality(self, features: np.ndarray, size: np.ndarray) -> float:
        good = self.marginals(self.unary(features))
        weight = size + 1.0
        return float((good * weight).sum() / weight.sum())

    def score(self, quality: float) -> float:
        q = min(max(quality, 1e-4), 1 - 1e-4)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * math.log(q / (1 - q)) + self.shift))))


def _fit_chain(features: np.ndarray, state: np.ndarray, counts: np.ndarray, start: Model) -> Model:
    """Adam on the conditional log-likelihood of documents with ``counts`` lines; documents side by side, one line
    at a time, the longest first so that a step only touches those that still have lines."""
    by = np.argsort(-counts, kind="stable")
    row = np.empty(len(counts), np.int64)
    row[by] = np.arange(len(counts))
    doc = np.repeat(row, counts)
    at = np.arange(len(features)) - np.repeat(np.cumsum(counts) - counts, counts)
    longest = int(counts.max())
    on = np.array([(counts > i).sum() for i in range(longest)])  # documents with a line i
    x = np.column_stack([features, np.ones(len(features))])
    n, n_docs = len(x), len(counts)
    gold_pairs = np.zeros((2, 2))
    inner = np.flatnonzero(at > 0)
    np.add.at(gold_pairs, (state[inner - 1], state[inner]), 1)
    weights, moves = start.weights.copy(), start.moves.copy()
    m = [np.zeros_like(weights), np.zeros_like(moves)]
    v = [np.zeros_like(weights), np.zeros_like(moves)]
    node = np.ones((longest, n_docs, 2))
    forward, good = np.zeros_like(node), np.zeros((longest, n_docs))
    for step in range(1, STEPS + 1):
        node[at, doc, 1] = np.exp(np.clip(x @ weights, -30, 30))
        t = np.exp(moves)
        for i in range(longest):
            f = node[i, : on[i]] * (forward[i - 1, : on[i]] @ t) if i else node[0]
            forward[i, : on[i]] = f / f.sum(1, keepdims=True)
        back, pairs = np.ones((n_docs, 2)), np.zeros((2, 2))
        for i in range(longest - 1, -1, -1):
            p = forward[i, : on[i]] * back[: on[i]]
            good[i, : on[i]] = p[:, 1] / p.sum(1)
            if i:
                ahead = node[i, : on[i]] * back[: on[i]]
                joint = forward[i - 1, : on[i], :, None] * t * ahead[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                b = ahead @ t.T
                back[: on[i]] = b / b.sum(1, keepdims=True)
        slopes = [x.T @ (state - good[at, doc]) / n - DECAY * weights, (gold_pairs - pairs) / n - DECAY * moves]
        for k, (w, g) in enumerate(zip((weights, moves), slopes, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w += RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(weights, moves)


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> Model | None:
    """From (features, sizes, label) of each training document."""
    labels = np.array([d[2] for d in docs])
    if len(set(labels.tolist())) < 2:
        return None
    features = np.vstack([d[0] for d in docs]).astype(np.float64)
    counts = np.array([len(d[0]) for d in docs])
    mean, spread = features.mean(0), features.std(0) + 1e-6
    scaled = (features - mean) / spread
    state = np.repeat(labels, counts)
    model = Model(np.zeros(WIDTH + 1), np.zeros((2, 2)))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    for r in range(ROUNDS):
        model = _fit_chain(scaled, state, counts, model)
        if r < ROUNDS - 1:
            # alone, without its neighbours' states: what a line itself looks like
            looks = model.unary(scaled)
            for i in np.flatnonzero(labels == 0):
                own = looks[bounds[i] : bounds[i + 1]]
                state[bounds[i] : bounds[i + 1]] = (own > 0) & (np.arange(len(own)) != own.argmin())
    w = np.append(model.weights[:-1] / spread, model.weights[-1] - (model.weights[:-1] * mean / spread).sum())
    model = Model(w, model.moves)
    return _calibrated(model, np.array([model.quality(f.astype(np.float64), s) for f, s, _ in docs]), labels)


def _calibrated(model: Model, quality: np.ndarray, labels: np.ndarray) -> Model:
    """The logistic curve of the label over the quality's log odds, moved so that the best cut of the training
    documents (equal weight for both labels) gets score ``CUT``."""
    q = np.clip(quality, 1e-4, 1 - 1e-4)
    z = np.log(q / (1 - q))
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    a, b = 0.5, 0.0
    for _ in range(50):  # Newton with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (labels - p) * z).sum() - 1e-3 * a, (weight * (labels - p)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    a = max(a, 0.05)
    order = np.argsort(z, kind="stable")
    lost = np.cumsum(weight[order] * (labels[order] == 1)) - np.cumsum(weight[order] * (labels[order] == 0))
    worth = np.concatenate(([0.0], lost))  # cutting below the i-th: good lost less bad gained
    least = np.flatnonzero(worth <= worth.min() + 1e-12)
    i = int(least[len(least) // 2])
    zs = np.concatenate(([z[order[0]] - 1], z[order], [z[order[-1]] + 1]))
    cut = (zs[i] + zs[i + 1]) / 2
    return Model(model.weights, model.moves, a, math.log(CUT / (1 - CUT)) - a * cut)


def _features(texts: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array(x, pa.binary()) for x in zip(*[(f.tobytes(), s.astype(np.int64).tobytes()) for f, s in (line_features(t) for t in texts.to_pylist())], strict=True)] if len(texts) else [pa.array([], pa.binary())] * 2, ["features", "sizes"]
    )


def train(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Model | None:
    """From ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; the caller leaves out what is held out."""
    text = rows.body(docs)
    known = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    order = (F.xxhash64("doc_id", "quality"), F.col("doc_id"))
    # at most twice as many labels as needed, without texts: the bound of the broadcast
    some = known.orderBy(*order).limit(2 * most_docs)
    short = docs.filter(lines <= most_lines).select("doc_id", text.cast("binary").alias("body"))
    picked = short.join(F.broadcast(some), "doc_id").orderBy(*order).limit(most_docs)
    got = picked.select("doc_id", "quality", F.arrow_udf(_features, "struct<features:binary,sizes:binary>")("body").alias("f")).select("quality", "f.*").collect()
    return fit([(np.frombuffer(r["features"], np.float32).reshape(-1, WIDTH), np.frombuffer(r["sizes"], np.int64), r["quality"]) for r in got])


def score(body: Column, model: Model | None) -> Column:
    """Score (0 to 1) of a binary column of UTF-8."""

    def run(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array([0.5] * len(texts), pa.float64())
        return pa.array([model.score(model.quality(*line_features(t))) for t in texts.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(body)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = rows.table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels.filter(~rows.held_out(F.col("doc_id"))))
    done = docs.select("doc_id", rows.held_out(F.col("doc_id")).alias("held_out"), score(rows.body(docs).cast("binary"), model).alias("score"))
    return done.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
