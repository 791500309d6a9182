"""Text normalisation, masking and hashing as Column expressions.

Everything here but :func:`fnv1a32` stays inside the JVM; that one runs over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.functions.regex import ODD_SPACE, SPACE, jvm

# --- fixed values: masks of the log canonicaliser, applied in this order ----------------
ANSI_ESCAPE = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
CANONICAL_MASKS = [
    (ANSI_ESCAPE, ""),
    (r"\b\d{4}-\d{2}-\d{2}[tT ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:z|[+-]\d{2}:?\d{2})?\b", "<timestamp>"),
    (r"\b\d{4}/\d{2}/\d{2}[ t]\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "<timestamp>"),
    (r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "<timestamp>"),
    (
        r"(?i)(?:/tmp|/var/folders|/private/var/folders|/home/runner/work/_temp"
        r"|c:\\users\\[^\\\s]+\\appdata\\local\\temp)[^\s:]*",
        "<tmp>",
    ),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<id>"),
]
# --- fixed values: corpus redaction (e-mail first, then tokens) --------------------------
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
TOKENS = [
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/\-]+=*",
    r"\bghp_[A-Za-z0-9]{36,}\b",
    r"\bgho_[A-Za-z0-9]{36,}\b",
    r"\bghr_[A-Za-z0-9]{36,}\b",
    r"\bghx_[A-Za-z0-9]{36,}\b",
    r"\b[A-Za-z0-9+/]{30,}={0,2}\b",
    r"\bsk_(?:live|test)_[A-Za-z0-9]{20,}\b",
    r"\bpk_(?:live|test)_[A-Za-z0-9]{20,}\b",
]
# --- fixed values: sanitiser of labelled logs: (name, pattern, replacement) --------------
SANITIZERS = [
    ("github-token", r"(?i)\b(ghp|ghs|gho|github_pat)_[A-Za-z0-9_]{20,}\b", "<redacted-github-token>"),
    ("aws-key", r"\b(AKIA|AIPA|ASIA|AROA)[A-Z0-9]{16}\b", "<redacted-aws-key>"),
    ("auth-header", r"(?i)(Authorization:\s*(?:Bearer|Token|Basic)\s+)\S+", "$1<redacted>"),
    ("url-credentials", r"(?i)(https?://)([^:\s@]+):([^@\s]+)@", "$1<redacted>:<redacted>@"),
    (
        "credential-kv",
        r"(?i)((?:password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key)\s*[=:]\s*)(\S+)",
        "$1<redacted>",
    ),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "<redacted-jwt>"),
    (
        "pem-key",
        r"(?s)-----BEGIN [A-Z ]*(?:PRIVATE|RSA|EC|DSA) KEY-----.*?-----END [A-Z ]*(?:PRIVATE|RSA|EC|DSA) KEY-----",
        "<redacted-pem-key>",
    ),
    ("email", EMAIL, "<redacted-email>"),
]
# --- fixed values: masks of the gap-cluster line, applied in this order ------------------
CLUSTER_MASKS = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<ts>"),
    (r"https?://\S+", "<url>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"\b[0-9a-fA-F]{12,}\b", "<hex>"),
    (r"(?:/[\w.\-]+){2,}", "<path>"),
    (r"\b\d+\b", "<n>"),
    (r"\s{2,}", " "),
]
# --- fixed values: evidence masks of the signature, around the path step -----------------
SIGNATURE_MASKS_BEFORE_PATHS = [
    (r"\b\d{4}-\d{2}-\d{2}[tT ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[zZ]|[+-]\d{2}:?\d{2})?\b", "<timestamp>"),
    (r"\b\d{4}/\d{2}/\d{2}[ t]\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "<timestamp>"),
    (r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", "<date>"),
    (r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "<time>"),
]
SIGNATURE_MASKS_AFTER_PATHS = [
    (r"(?i)([a-z0-9_./-]+\.[a-z0-9]+):\d+(?::\d+)?", "$1:<n>"),
    (r":<n>(?::<n>)+", ":<n>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<id>"),
    (r"(?i)\b[0-9a-f]{7,64}\b", "<hex>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"\b(line|column|col|position|offset|pid|process|worker|attempt|build|run|job)\s+#?\d+\b", "$1 <n>"),
    (r"\b\d{5,}\b", "<n>"),
]
TRUNCATION_MARK = "\n...[truncated]"
# --- end of fixed values -----------------------------------------------------------------


# First characters of patterns that begin with an alternation, to skip positions early.
STARTS = {CANONICAL_MASKS[4][0]: "(?=[/cC])"}


def replace_all(c: Column, masks: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in masks:
        c = F.regexp_replace(c, STARTS.get(pattern, "") + jvm(pattern), replacement)
    return c


def trim_space(c: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_space(c: Column) -> Column:
    """Join the white-space separated fields of a text with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\s\x{85}\p{Z}&&[^ ]]", " "), "  +", " "))


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def canonicalize_log(c: Column) -> Column:
    """Mask run-specific noise line by line and drop blank lines.

    No mask can match across a line feed, so the whole text is masked at once instead
    of being split into lines: one pass per mask, and no per-line array work.
    """
    c = replace_all(unix_newlines(c), CANONICAL_MASKS)
    c = F.regexp_replace(F.regexp_replace(c, ODD_SPACE, " "), "  +", " ")
    c = F.regexp_replace(c, " ?\n[ \n]*", "\n")
    return F.trim(c, F.lit(" \n"))


def normalize_log(c: Column) -> Column:
    return F.lower(canonicalize_log(c))


def clean_line(c: Column) -> Column:
    return collapse_space(replace_all(c, CANONICAL_MASKS))


def normalize_line(c: Column) -> Column:
    return F.lower(clean_line(c))


def normalize_pattern(c: Column) -> Column:
    return F.lower(collapse_space(c))


def redact(c: Column, emails: bool = True, tokens: bool = True) -> Column:
    if emails:
        c = replace_all(c, [(EMAIL, "<email>")])
    if tokens:
        c = replace_all(c, [(t, "<token>") for t in TOKENS])
    return c


def sanitize(c: Column) -> Column:
    return replace_all(c, [(p, r) for _, p, r in SANITIZERS])


def sanitize_counts(c: Column) -> Column:
    """Array of (rule, n): matches of each sanitiser on the text left by the rules before it. For tables see :func:`sanitize_rows`."""
    steps = []
    for name, pattern, replacement in SANITIZERS:
        steps.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.regexp_count(c, F.lit(jvm(pattern))).cast("bigint").alias("n"),
            )
        )
        c = F.regexp_replace(c, jvm(pattern), replacement)
    return F.filter(F.array(*steps), lambda s: s["n"] > 0)


def sanitize_rows(d: DataFrame, text: str = "text") -> DataFrame:
    """Rows (rule, n) beside the other columns, as :func:`sanitize_counts`.

    Each step is a column of its own: in one nested expression all steps before run again for every count.
    """
    others = [c for c in d.columns if c != text]
    done: list[Column] = []
    d = d.select(*others, F.col(text).alias("_text"))
    for i, (name, pattern, replacement) in enumerate(SANITIZERS):
        n, rx = f"_n{i}", jvm(pattern)
        d = d.select(*others, *done, "_text", F.regexp_count("_text", F.lit(rx)).cast("bigint").alias(n))
        # a text without a match is its own result
        d = d.select(*others, *done, n, F.when(F.col(n) > 0, F.regexp_replace("_text", rx, replacement)).otherwise(F.col("_text")).alias("_text"))
        done.append(F.col(n))
    counts = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_n{i}").alias("n")) for i, (name, _, _) in enumerate(SANITIZERS)])
    return d.select(*others, F.explode(counts).alias("c")).filter("c.n > 0").select(*others, "c.rule", "c.n")


def parse_size(text: str) -> int:
    """``"4mb"`` -> bytes. Empty and ``0`` mean no limit."""
    s = text.strip().lower()
    if s in ("", "0"):
        return 0
    factor = 1
    for suffix, power in (("gb", 30), ("mb", 20), ("kb", 10), ("b", 0)):
        if s.endswith(suffix):
            s, factor = s[: -len(suffix)].strip(), 1 << power
            break
    if not s.isdigit():
        raise ValueError(f"invalid size {text!r}")
    return int(s) * factor


def utf8_prefix(c: Column, max_bytes: int) -> Column:
    """First ``max_bytes`` bytes as text; a code point cut in half is left out whole."""
    raw = F.encode(c, "UTF-8")

    def byte_at(i: int) -> Column:
        return F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int")

    def is_tail(i: int) -> Column:
        return (byte_at(i) >= 0x80) & (byte_at(i) < 0xC0)

    cut = (
        F.when(~is_tail(max_bytes + 1), max_bytes)
        .when(~is_tail(max_bytes), max_bytes - 1)
        .when(~is_tail(max_bytes - 1), max_bytes - 2)
        .otherwise(max_bytes - 3)
    )
    short = F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(c) <= max_bytes, c).otherwise(short)


def cap_size(c: Column, max_bytes: int) -> Column:
    if max_bytes <= 0:
        return c
    return F.when(F.octet_length(c) <= max_bytes, c).otherwise(
        F.concat(utf8_prefix(c, max_bytes), F.lit(TRUNCATION_MARK))
    )


def content_id(c: Column) -> Column:
    return F.sha2(trim_space(c), 256)


def fixture_fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def input_hash(c: Column) -> Column:
    return F.sha2(canonicalize_log(c), 256)


def _fnv1a32(texts: pa.Array) -> pa.Array:
    """One byte of all texts of a batch at a time, as long as many texts have one; the few longest ones byte by byte."""
    data = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    lengths = np.array([len(t) for t in data], np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, raw = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(data), np.uint8)
    starts, lengths = starts[order], lengths[order]
    state = np.full(len(data), 2166136261, np.uint32)
    at, left = 0, len(data)
    while (left := int(np.searchsorted(-lengths[:left], -at))) >= 100:  # texts of more than ``at`` bytes
        state[:left] = (state[:left] ^ raw[starts[:left] + at]) * np.uint32(16777619)
        at += 1
    for i in range(left):
        h = int(state[i])
        for byte in raw[starts[i] + at : starts[i] + lengths[i]].tobytes():
            h = (h ^ byte) * 16777619 & 0xFFFFFFFF
        state[i] = h
    out = [""] * len(data)
    for i, h in zip(order.tolist(), state.tolist(), strict=True):
        out[i] = f"{h:08x}"
    return pa.array(out, pa.string(), mask=np.asarray(texts.is_null()))


def fnv1a32(c: Column) -> Column:
    """FNV-1a, 32 bit, over the UTF-8 bytes, as eight hex digits."""
    return F.arrow_udf(_fnv1a32, "string")(c)


def first_line(c: Column) -> Column:
    """Lower-cased first line, at most 120 bytes."""
    return utf8_prefix(F.lower(trim_space(F.substring_index(c, "\n", 1))), 120)


def first_line_tag(c: Column) -> Column:
    line = first_line(c)
    return F.when(line == "", F.lit("")).otherwise(F.substring(F.sha2(line, 256), 1, 8))


def cluster_line(c: Column) -> Column:
    return F.lower(trim_space(replace_all(trim_space(c), CLUSTER_MASKS)))


def cluster_signature(clean: Column) -> Column:
    return F.substring(F.sha2(clean, 256), 1, 8)


def token_set(c: Column) -> Column:
    """Distinct lower-case ASCII alphanumeric runs, sorted."""
    words = F.split(F.lower(c), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 when one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def contains_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def round2(c: Column) -> Column:
    """Round half away from zero on the scaled value, which keeps 1.005 at 1.0."""
    return F.round(c * 100) / 100


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Directory part of a slash path, empty for a bare file name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))
