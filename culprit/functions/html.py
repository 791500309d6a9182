"""Issue pages to text, and log snippets out of text."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from culprit.functions import text as tx

# --- fixed values: tags that break lines, words that make a text look like a log ------------------------
BLOCK_TAGS = [
    "p", "div", "section", "article", "blockquote", "li", "tr", "table", "thead", "tbody", "tfoot", "ul", "ol",
]
ERROR_SIGNALS = [
    "error", "failed", "exception", "traceback", "panic:", "timeout", "timed out", "permission denied",
    "connection refused", "unauthorized", "denied", "no such file or directory", "not found", "cannot find",
    "module not found", "context deadline exceeded", "crashloopbackoff", "oomkilled", "x509",
    "temporary failure in name resolution", "pull access denied", "npm err",
]
MIN_LOG_LINES = 6
FENCED_BLOCK = r"(?s)```[^\n`]*\n(.*?)```"
# --- end of fixed values ----------------------------------------------------------------------------------

LINE_STARTS = frozenset(["pre", "br", *BLOCK_TAGS])
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Segments(HTMLParser):
    """A page as lines of pieces: ``(text, verbatim)``; block tags begin a line, text inside ``pre`` is verbatim."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list[tuple[str, bool]]] = [[]]
        self.verbatim = False

    def handle_starttag(self, tag, attrs) -> None:
        self.verbatim |= tag == "pre"
        if tag in LINE_STARTS:
            self.lines.append([])

    def handle_endtag(self, tag) -> None:
        self.verbatim &= tag != "pre"
        if tag in LINE_STARTS and tag != "br":
            self.lines.append([])

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data) -> None:
        text = html.unescape(data)
        if not self.verbatim:
            text = " ".join(filter(None, _SPACES.split(text)))
        if text:
            self.lines[-1].append((text, self.verbatim))


def _joined(pieces: list[tuple[str, bool]]) -> str:
    """Pieces of running text are set apart by a space, unless they begin a line; verbatim pieces are not."""
    out: list[str] = []
    for text, verbatim in pieces:
        if out and not verbatim and not out[-1].endswith("\n"):
            out.append(" ")
        out.append(text)
    return "".join(out)


def page_text(page: str | None) -> str:
    parser = _Segments()
    parser.feed((page or "").strip())
    parser.close()
    texts = [t for t in map(_joined, parser.lines) if t]
    whole = "".join(t if t.endswith("\n") else f"{t}\n" for t in texts)
    lines = [l.strip() for l in whole.replace("\r\n", "\n").split("\n")]
    kept = [l for i, l in enumerate(lines) if l or (i and lines[i - 1])]
    return "\n".join(kept).strip()


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    """Runs in Python because entities and raw script text need a real HTML tokenizer."""
    return pages.map(page_text)


def looks_like_log(block: Column) -> Column:
    return tx.contains_any(F.lower(block), ERROR_SIGNALS) | (F.size(F.split(block, "\n")) >= MIN_LOG_LINES)


def log_snippets(text: Column) -> Column:
    """Distinct log snippets of a text in order: fenced blocks, or paragraphs when no block fits."""
    t = tx.unix_newlines(text)

    def usable(blocks: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(blocks, tx.canonicalize_log), looks_like_log))

    fenced = usable(F.regexp_extract_all(t, F.lit(FENCED_BLOCK), F.lit(1)))
    return F.when(F.size(fenced) > 0, fenced).otherwise(usable(F.split(t, "\n\n")))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(s == "", F.lit("fixture")).otherwise(s)


def snippet_id(provider: Column, repository: Column, issue: Column, position: Column, snippet: Column) -> Column:
    """provider-repo-issue-s{n}-fingerprint."""
    return F.concat_ws(
        "-", provider, slug(repository), issue.cast("string"), F.concat(F.lit("s"), position.cast("string")), tx.fixture_fingerprint(snippet)
    )
