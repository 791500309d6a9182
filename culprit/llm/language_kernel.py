"""Language identification with string kernels, Nyström landmarks and kernel ridge regression.

The kernel of two texts counts the character n-grams of 1 to ``ORDERS`` letters that both contain
(blended spectrum, presence not frequency), over the geometric mean of their own counts. N-grams
are hashed to ``BUCKETS`` places, so a text is a set of places and the kernel of a batch of texts
with the landmarks is one matrix product. Landmarks are a bounded sample of the training texts;
``K(x, landmarks) @ K(landmarks)^(-1/2)`` are the features of a ridge regression for each language
against the rest. The highest output decides.

Training: at most ``PER_LANGUAGE`` documents of each language with the smallest hashes, and of at
most ``LANGUAGES`` languages (the most frequent). These bounds are parameters; prediction covers all
rows and whole texts. Only sets of places reach the driver, never texts.

Rules: a null text or one without letters is ``und`` with score 0; case and everything that is no
letter are ignored, except that words are set apart; with no training rows all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from culprit.llm import rows

ORDERS = 4
BUCKETS = 1 << 14
PER_LANGUAGE = 250
LANDMARKS = 24  # of each language
LANGUAGES = 200
RIDGE = 1e-2
AT_ONCE = 1 << 18
ROWS_AT_ONCE = 256
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
UNDECIDED = "und"


def presence(text: str | None, orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray | None:
    """The set of places of a text as booleans; None without letters."""
    out, seen = np.zeros(buckets, bool), False
    tail = " "
    for at in range(0, len(text or ""), AT_ONCE):
        part = NOT_LETTERS.sub(" ", text[at : at + AT_ONCE].lower())
        if not seen and LETTER.search(part) is None:
            continue
        seen = True
        last = at + AT_ONCE >= len(text)
        part = tail + (part.removeprefix(" ") if tail.endswith(" ") else part) + (" " if last and not part.endswith(" ") else "")
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(codes), np.uint32)
        for n in range(1, orders + 1):
            if len(codes) < n:
                break
            h = (h[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ codes[n - 1 :]
            mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out[(mixed ^ (mixed >> np.uint32(15))) % np.uint32(buckets)] = True
        tail = part[-(orders - 1) :]
    return out if seen else None


class Model:
    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages = languages
        self.landmarks = landmarks.astype(np.float32)  # one row for each, over the square root of its size
        self.weights = weights.astype(np.float32)  # landmarks x languages: whitening and regression in one

    def outputs(self, present: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(1.0, present.sum(1, dtype=np.float32)))
        return (present.astype(np.float32) @ self.landmarks.T) / size[:, None] @ self.weights


def fit(present: np.ndarray, labels: list[str], per_language: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    at = np.concatenate([np.flatnonzero(y == i)[:per_language] for i in range(len(languages))])
    scaled = present / np.sqrt(np.maximum(1, present.sum(1)))[:, None]
    marks = scaled[at]
    among = marks @ marks.T
    value, vector = np.linalg.eigh(among)
    good = value > 1e-8 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    features = scaled @ marks.T @ whiten
    # every language weighs the same, however many rows it has
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y]
    target = (y[:, None] == np.arange(len(languages))).astype(float)
    gram = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1]) / max(1, len(at))
    beta = np.linalg.solve(gram, features.T @ (target * weight[:, None]))
    return Model(languages, marks, whiten @ beta)


def _places(texts: pa.Array) -> pa.Array:
    found = (presence(t) for t in texts.to_pylist())
    return pa.array([None if p is None else np.packbits(p).tobytes() for p in found], pa.binary())


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model | None:
    """From ``docs(doc_id, text, lang)``: rows with a language and a text, bounded for each language."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length(F.trim("text")) > 0))
    known = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(languages).collect()}
    if not known:
        return None
    # of each language only a share of hashes that surely holds the smallest ones is moved at all
    share = F.create_map(*[F.lit(x) for k, n in known.items() for x in (k, min(1.0, 4.0 * per_language / n))])
    at = F.xxhash64("doc_id", "text")
    likely = labelled.withColumn("share", share[F.col("lang")]).filter((at / float(1 << 63) + 1) / 2 <= F.col("share"))
    order = W.partitionBy("lang").orderBy(at, "doc_id")
    picked = likely.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= per_language)
    got = picked.select("lang", "at", F.arrow_udf(_places, "binary")("text").alias("places")).filter("places is not null").orderBy("at", "lang").collect()
    if not got:
        return None
    present = np.unpackbits(np.frombuffer(b"".join(r["places"] for r in got), np.uint8).reshape(len(got), -1), axis=1)
    return fit(present.astype(np.float64), [r["lang"] for r in got])


def _predict(model: Model | None, texts: list[str | None]) -> Iterator[tuple[str, float]]:
    for i in range(0, len(texts), ROWS_AT_ONCE):
        places = [presence(t) for t in texts[i : i + ROWS_AT_ONCE]]
        some = [p for p in places if p is not None]
        if model is not None and some:
            out = model.outputs(np.array(some))
            best = iter(zip(out.argmax(1).tolist(), np.clip(out.max(1), 0.0, 1.0).tolist(), strict=True))
        for p in places:
            if p is None or model is None:
                yield UNDECIDED, 0.0
            else:
                k, score = next(best)
                yield model.languages[k], score


def predict(text: Column, model: Model | None) -> Column:
    """``struct<lang_pred, score>`` of a string column."""

    def run(texts: pa.Array) -> pa.Array:
        done = list(_predict(model, texts.to_pylist()))
        return pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(run, "struct<lang_pred:string,score:double>")(text)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~rows.held_out(F.col("doc_id"))))
    return docs.select("doc_id", rows.held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), model).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score")
