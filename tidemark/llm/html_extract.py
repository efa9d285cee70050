"""Operator 2: main text of web pages by tree scoring.

A page becomes a tree of elements (with HTML's implied end tags).  Each
paragraph passes points for its length and commas to its ancestors, discounted
by the share of its text inside links; the container with most points is the
article, and siblings that look like it, further articles included, are kept.
Its text is cut into blocks in page order.

Tags, roles and class names only propose what to leave out (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments): an element that
holds ``MOST`` of the page's paragraph points, leaving out those of reader
comments, stays whatever its name is, unless the page's <article> or <main> is
outside it.  Menus and footers by tag always go, as do scripts, styles and
hidden elements.

Every step is a single pass over the page or over the elements in page order,
so time grows with the page and depth is not limited.

Defined results: null or empty html, and pages without any text, give an empty
text; unclosed or stray tags and broken references are read as browsers do, and
a tag whose quote is never closed ends at its first ``>``; repeated rows each
give their result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=\"']+|[=\"'])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)?))?")
GAP = re.compile(r"[\s/]*")
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg object canvas noframes xmp".split())
BLOCK = set("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Never text.
CONTROLS = {"button", "select", "input", "datalist", "nav", "footer", "menu"}
#: Left out unless they hold most of the page.
DROP = {"aside", "form", "dialog", "fieldset"}
DROP_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|disqus|discussion)(?:$|[\s_-])", re.I)
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adslot|banner|breadcrumbs?|cookies?|consent|gdpr|notice|notification|popup|modal|overlay|sidebar|side|menu|nav|navbar|navigation|footer|foot|masthead|share|sharing|social|related|recommend\w*|promo\w*|sponsor\w*|newsletter|subscribe|signup|login|toolbar|pagination|pager|widget|skip|legal|copyright)(?:$|[\s_-])", re.I
)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|head|topbar|top)(?:$|[\s_-])", re.I)
LIKELY = re.compile(r"article|content|entry|post|story|main|text|body", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SCORED = {"p", "pre", "td", "blockquote", "li", "dd", "h2", "h3"}
HEADINGS = {"h1", "h2", "h3"}
#: The share of paragraph points from which a name no longer speaks against an element.
MOST = 0.5


class Node:
    __slots__ = ("tag", "parent", "children", "marks", "role", "hidden", "score", "inside", "linked", "n", "links", "commas", "points", "gone")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.marks, self.role, self.hidden, self.gone = "", "", False, False
        self.score = self.points = 0.0
        self.n = self.links = self.commas = 0
        # Within an article headers belong to the text.
        self.inside = parent is not None and (parent.inside or main_part(parent))
        self.linked = tag == "a" or parent is not None and parent.linked

    def attribute(self, name: str, value: str) -> None:
        name = name.lower()
        if name in ("class", "id"):
            self.marks += " " + value
        elif name == "role":
            self.role = value.lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            self.hidden = True


def main_part(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role == "main"


def attributes(page: str, at: int, node: Node, last: dict[str, int]) -> tuple[int, bool]:
    """The place behind the tag whose attributes start at ``at``, and whether
    it closed itself."""
    end = len(page)
    while True:
        at = GAP.match(page, at).end()
        if at >= end:
            return end, False
        if page[at] == ">":
            return at + 1, page[at - 1] == "/"
        m = ATTRIBUTE.match(page, at)
        quote = page[m.end() : m.end() + 1]
        if quote in ('"', "'") and quote and last[quote] <= m.end():
            # A quote without an end.
            close = page.find(">", m.end())
            return (close + 1 if close >= 0 else end), False
        node.attribute(m[1], m[2] or m[3] or m[4] or "")
        at = m.end()


def parse(page: str) -> list[Node]:
    """The elements in page order; the first is the root."""
    root = now = Node("html", None)
    nodes = [root]
    # The last place of each quote tells without a search that none follows.
    last = {q: page.rfind(q) for q in "\"'"}
    raw_last: dict[str, int] = {}
    open_tags: dict[str, int] = {}
    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start != at:
            start = end if start < 0 else start
            now.children.append(references.unescape(page[at:start]))
            at = start
            continue
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            at = end if close < 0 else close + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?") and at + 1 < end:
            close = page.find(">", at)
            at = end if close < 0 else close + 1
            continue
        m = NAME.match(page, at + 1)
        if not m:
            now.children.append("<")
            at += 1
            continue
        tag = m[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            at, _ = attributes(page, m.end(), Node(tag, None), last)
            if not open_tags.get(tag):
                continue
            node = now
            while node and node.tag != tag and not (node.tag in ("td", "th") and tag not in ("tr", "table", "tbody")):
                node = node.parent
            if node and node.tag == tag and node.parent:
                while now is not node.parent:
                    open_tags[now.tag] -= 1
                    now = now.parent
            continue
        node = Node(tag, now)
        at, closed = attributes(page, m.end(), node, last)
        if tag in RAW:
            if tag not in raw_last:
                found = [x.start() for x in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", page, re.I)]
                raw_last[tag] = found[-1] if found else -1
            if at > raw_last[tag]:
                at = end
            else:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in ("html", "body"):
            continue
        up = now
        if (tag in BLOCK or tag == "hr") and open_tags.get("p"):
            other = now
            while other and other.tag not in ("p", "td", "th", "table", "button"):
                other = other.parent
            if other and other.tag == "p" and other.parent:
                up = other.parent
        if tag in CLOSES and any(open_tags.get(x) for x in CLOSES[tag]):
            other = up
            while other and other.tag not in CLOSES[tag] and other.tag not in BARRIER[tag]:
                other = other.parent
            if other and other.tag in CLOSES[tag]:
                up = other.parent
        while now is not up:
            open_tags[now.tag] -= 1
            now = now.parent
        node.parent, node.inside, node.linked = now, now.inside or main_part(now), tag == "a" or now.linked
        now.children.append(node)
        nodes.append(node)
        if tag not in VOID and not closed:
            now = node
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return nodes


def count(nodes: list[Node]) -> None:
    """Characters, characters in links, commas and paragraph points of every
    element that is not gone, children before parents."""
    for node in nodes:
        node.n = node.links = node.commas = 0
        node.points = 0.0
    for node in reversed(nodes):
        if node.gone:
            node.n = node.links = node.commas = 0
            node.points = 0.0
            continue
        own = False
        for c in node.children:
            if isinstance(c, str):
                k = len(c.strip())
                own = own or k > 0
                node.n += k
                node.links += k * node.linked
                node.commas += c.count(",") + c.count("、") + c.count("，")
        if (node.tag in SCORED or own and node.tag in BLOCK) and node.n:
            node.points = max(node.points, points(node))
        if node.parent is not None:
            up = node.parent
            up.n, up.links, up.commas, up.points = up.n + node.n, up.links + node.links, up.commas + node.commas, up.points + node.points


def points(node: Node) -> float:
    return (1 + node.commas + min(node.n / 100, 3)) * (1 - node.links / node.n) if node.n else 0.0


def doubtful(node: Node) -> bool:
    """Left out by tag, role or name, unless it holds most of the page."""
    if node.tag in DROP or node.role in DROP_ROLE:
        return True
    if main_part(node):
        return False
    if not node.inside and (node.tag == "header" or node.marks and HEADER.search(node.marks)):
        return True
    return bool(node.marks and node.tag in BLOCK and UNLIKELY.search(node.marks))


def prune(nodes: list[Node]) -> None:
    """Mark as gone what is not the article's."""
    for node in nodes:
        if node.hidden or node.tag in CONTROLS:
            node.gone = True
    comments = [x for x in nodes if x.marks and x.tag in BLOCK and not main_part(x) and COMMENTS.search(x.marks)]
    for whole in (False, True):
        for node in comments:
            node.gone = node.gone or not whole
        count(nodes)
        total = nodes[0].points
        if total or not comments:
            break
        for node in comments:  # a page of comments only
            node.gone = node.hidden
    # Elements with an <article> or <main> that has text in them.
    around: set[int] = set()
    for node in nodes:
        up = node if main_part(node) and node.n and not node.gone else None
        while up is not None and id(up) not in around:
            around.add(id(up))
            up = up.parent
    for node in nodes[1:]:
        if doubtful(node) and (node.points <= MOST * total or around and id(node) not in around):
            node.gone = True
    for node in nodes[1:]:
        node.gone = node.gone or node.parent.gone
    count(nodes)


def score_tree(nodes: list[Node]) -> Node | None:
    best, seen = None, {}
    for node in nodes:
        own = any(isinstance(c, str) and c.strip() for c in node.children)
        if not node.gone and node.n and (node.tag in SCORED or own and node.tag in BLOCK):
            share, up = points(node), node.parent if node.tag in SCORED else node
            for _ in range(4):
                if up is None:
                    break
                up.score += share
                seen[id(up)] = up
                share, up = share / 2, up.parent
    for node in seen.values():
        likely = 1.5 if main_part(node) else 1.2 if node.marks and LIKELY.search(node.marks) else 1.0
        node.score *= (1 - node.links / node.n if node.n else 0) * likely
        if best is None or node.score > best.score:
            best = node
    return best


def blocks(node: Node, out: list[list[str]]) -> None:
    """Append the texts of a node's blocks to ``out``."""
    todo: list[tuple[Node | None, Iterator]] = [(node, iter(node.children))]
    while todo:
        top, rest = todo[-1]
        for c in rest:
            if isinstance(c, str):
                out[-1].append(c)
            elif not c.gone:
                if c.tag in BLOCK or c.tag == "hr":
                    out.append([])
                elif c.tag == "br":
                    out[-1].append(" ")
                todo.append((c, iter(c.children)))
                break
        else:
            todo.pop()
            if top is not node and (top.tag in BLOCK or top.tag == "hr"):
                out.append([])


def chosen(nodes: list[Node]) -> list[Node]:
    """The best container, with siblings and articles that look like it, in page order."""
    best = score_tree(nodes)
    if best is None:
        return [nodes[0]]
    up = best
    while up.parent:
        up = up.parent
        if main_part(up):
            best = up
            if up.tag == "article":
                break
    least = 0.2 * best.score
    if best.tag == "article":
        # Further articles of the page that are text, not lists of links.
        kept, taken = [], set()
        for node in nodes:
            if node.gone or node.parent is not None and id(node.parent) in taken:
                taken.add(id(node))
            elif node is best or node.tag == "article" and node.n and node.links < 0.5 * node.n and node.score >= max(10, least):
                kept.append(node)
                taken.add(id(node))
        return kept
    if best.parent is None or best.tag == "main":
        return [best]
    kept = []
    for s in best.parent.children:
        if s is best:
            kept.append(s)
        elif not isinstance(s, str) and not s.gone and (s.score >= max(10, least) or s.tag in HEADINGS or s.tag in ("p", "pre", "blockquote") and s.n and s.links < 0.25 * s.n):
            kept.append(s)
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes = parse(page)
    prune(nodes)
    out: list[list[str]] = [[]]
    for node in chosen(nodes):
        out.append([])
        blocks(node, out)
        out.append([])
    lines = (" ".join("".join(b).split()) for b in out)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    text = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
