"""Main text of a web page by scores on its element tree.

The page is parsed into a tree once. Every block of text (a paragraph, list item, cell, heading or
loose text between block tags) gives points for its length and its commas to the containers above
it: all to the parent, half to the next, a third to the one after. A container's points are
discounted by its link density and raised or lowered by what its name, class and role say. The best
container is kept, with those of its siblings that are near it in score or are plain text blocks. What is
kept loses its menus, headers, footers, sidebars, notices, adverts, forms and comments, and each
block's white space becomes single spaces.

Rules: null or empty html gives the empty text; a page without any text outside the dropped parts
gives the empty text; unclosed and crossing tags are closed where HTML closes them; text is never
cut. Trees are kept for one page at a time.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.llm import rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the article.
DROPPED = frozenset("script style noscript template head title nav aside footer form button select textarea iframe object svg canvas dialog menu".split())
BLOCK = frozenset("address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A new one of these ends an open one of the second, if no element of the third lies between.
ENDS = {
    **{t: ({"p"}, {"button"}) for t in "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: First or last words of a class, id or role that mark what does not belong to an article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion promotions nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar sidebars side footer masthead header cookie cookies consent notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments respond replies discussion disqus widget widgets toolbar pagination pager skip hidden complementary contentinfo search form forms".split()
)
#: In front these say what a container has or lacks, not what it is.
STATES = frozenset("with has no is not without".split())
WORD = re.compile(r"[^a-z0-9]+")
CONTENT = re.compile(r"(?<![a-z])(?:article|articles|content|main|post|entry|story|text|body|blog|hentry|page)(?![a-z])")
#: Siblings of the best container that are kept for what they are, if they are not mostly links.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
SPACE = re.compile(r"\s+")
START = {"article": 30.0, "main": 20.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "table": 0.0, "header": -20.0}


class Element:
    __slots__ = ("tag", "label", "parent", "children", "score", "chars", "linked")

    def __init__(self, tag: str, label: str, parent: Element | None):
        self.tag, self.label, self.parent = tag, label, parent
        self.children: list[Element | str] = []
        self.score = self.chars = self.linked = 0.0

    def is_dropped(self) -> bool:
        if self.tag in DROPPED:
            return True
        if self.tag in ("html", "body", "article", "main", ""):
            return False
        if self.tag == "header":
            return not self.is_inside("article", "main")
        for name in self.label.split():
            words = [w for w in WORD.split(name) if w]
            if words and words[0] not in STATES and (words[0] in NOISE or words[-1] in NOISE):
                return True
        return False

    def is_inside(self, *tags: str) -> bool:
        e = self.parent
        while e is not None and e.tag not in tags:
            e = e.parent
        return e is not None


class TreeParser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", "", None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS:
            ended, fence = ENDS[tag]
            node = self.at
            while node.parent is not None and node.tag not in fence:
                if node.tag in ended:
                    self.at = node.parent
                node = node.parent
        label = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
        if any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs):
            label += " hidden"
        child = Element(tag, label, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("div", "p", "span", "a", "script"):  # a slash on these means nothing in HTML
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if data:
            self.at.children.append(data)


def blocks(node: Element) -> list[tuple[Element, str, int]]:
    """Blocks below a node that are not in a dropped part: the element they lie in, text, linked characters."""
    out: list[tuple[Element, str, int]] = []
    parts: list[str] = []
    state = {"owner": node, "linked": 0}

    def flush(owner: Element) -> None:
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((state["owner"], text, state["linked"]))
        parts.clear()
        state["owner"], state["linked"] = owner, 0

    stack: list[tuple[Element, int, bool]] = [(node, 0, False)]
    while stack:  # by hand: trees of broken pages can be deeper than Python's stack
        e, i, in_link = stack.pop()
        if i == 0 and e.tag in BLOCK:
            flush(e)
        while i < len(e.children):
            c = e.children[i]
            i += 1
            if isinstance(c, str):
                parts.append(c)
                if in_link:
                    state["linked"] += len(c.strip())
            elif not c.is_dropped():
                stack.append((e, i, in_link))
                stack.append((c, 0, in_link or c.tag == "a"))
                break
        else:
            if e.tag in BLOCK:
                flush(next_block(e.parent) or node)
    flush(node)
    return out


def next_block(e: Element | None) -> Element | None:
    while e is not None and e.tag not in BLOCK:
        e = e.parent
    return e


def points(text: str) -> float:
    return 1.0 + text.count(",") + min(3.0, len(text) / 100)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = TreeParser()
    parser.feed(html)
    if not parser.rawdata.startswith("<!--"):  # a comment that is never closed reaches to the end
        parser.close()
    root = parser.root
    scored: dict[int, Element] = {}
    for owner, text, linked in blocks(root):
        worth = points(text) * (1 - min(1.0, linked / len(text)))
        node, share, level = (owner if owner.tag not in ("p", "pre", "br", "hr") else owner.parent or owner), 1.0, 1
        up: Element | None = owner
        while up is not None:
            up.chars += len(text)
            up.linked += linked
            up = up.parent
        heading = node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if heading and node.parent is not None:
            node = node.parent
        while node is not None and share >= 0.2:
            if id(node) not in scored:
                scored[id(node)] = node
                node.score = START.get(node.tag, 0.0) + (15.0 if node.label and CONTENT.search(node.label) else 0.0)
            node.score += worth * share
            node, level = node.parent, level + 1
            share = 1.0 / level
    if not scored:
        return ""
    density = lambda e: min(1.0, e.linked / e.chars) if e.chars else 1.0
    value = {k: e.score * (1 - density(e)) for k, e in scored.items()}
    best = max(scored.values(), key=lambda e: value[id(e)])
    least = max(10.0, 0.2 * value[id(best)])
    kept: list[Element] = []
    for s in best.parent.children if best.parent is not None else [best]:
        if isinstance(s, str) or s.is_dropped():
            continue
        near = id(s) in value and value[id(s)] >= least
        plain = s.tag in PLAIN and s.chars > 0 and density(s) < 0.25
        if s is best or near or plain:
            kept.append(s)
    return "\n\n".join(text for e in kept for _, text, _ in blocks(e))


def extract(html: Column) -> Column:
    """Main text (string, never null) of a column of pages."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(html)


def op5(spark, sf_dir: str) -> DataFrame:
    pages = rows.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extract(F.col("html").cast("string")).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
