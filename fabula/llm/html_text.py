"""Main text of web pages by tree scoring.

A small tree is built from the tags. Every paragraph-like block passes points for its length and its commas on to its
ancestors (halved at each step up), a container's points are discounted by its link density, and the best container
is kept together with those of its siblings that score or read like it. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are left out by tag, role or name before scoring and inside the
kept container.

Pages are independent, so the work is one pass over the rows in Arrow batches; nothing is shuffled. Defined cases:
null or empty html gives an empty text; broken markup is closed where HTML would close it; text outside any
tag is a block; repeated pages give a row each; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard, and names that sites give to what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary "
    "table tbody td template tfoot th thead title tr ul".split())
SKIP = frozenset(
    "head script style title nav header footer aside form button select option textarea input noscript iframe template svg math canvas object "
    "audio video dialog menu search".split())
PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption summary".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
SKIP_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adbox|banner|breadcrumbs?|comments?|respond|reply|replies|cookies?|consent|gdpr|disqus|footer|header|masthead|"
    r"menu|nav|navbar|navigation|newsletter|notices?|popup|modal|promos?|promoted|related|recommended|share|sharing|shares|sidebar|side-bar|social|sponsor\w*|"
    r"subscribe|subscription|signup|toolbar|widgets?|paywall|pagination|pager|skip-link|disclaimer)(?:$|[-_\s])", re.I)
GOOD_NAMES = re.compile(r"(?:^|[-_\s])(?:article|articlebody|body|content|entry|main|page|post|story|text)(?:$|[-_\s])", re.I)
#: What a start tag closes if it is open in the nearest block.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = BLOCK - {"button", "iframe", "select", "option", "optgroup", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "head", "template", "noscript", "body", "html"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "bad", "good", "points", "n_text", "n_link")

    def __init__(self, tag: str, parent: Node | None = None, bad: bool = False, good: bool = False) -> None:
        self.tag, self.parent, self.bad, self.good = tag, parent, bad, good
        self.parts: list[str | Node] = []
        self.points = self.n_text = self.n_link = 0.0


def _named(tag: str, attributes: str) -> tuple[bool, bool]:
    if not attributes or attributes.isspace():
        return tag in SKIP, tag in ("article", "main")
    at = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    names = f"{at.get('id', '')} {at.get('class', '')}"
    good = tag in ("article", "main") or at.get("role", "").lower() in ("main", "article") or bool(GOOD_NAMES.search(names))
    bad = tag in SKIP or at.get("role", "").lower() in SKIP_ROLES or "hidden" in at or at.get("aria-hidden") == "true"
    bad = bad or tag not in ("html", "body", "article", "main") and bool(SKIP_NAMES.search(names))
    return bad, good and not bad


def parse(source: str) -> Node:
    """The tree of a page. Unknown or unclosed tags never fail; what is left open ends with the page."""
    root = here = Node("html")
    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            here.parts.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            here.parts.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                here.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            up = here
            while up is not root and up.tag != tag:
                if tag not in BLOCK and up.tag in BLOCK:  # a stray end of an inline element ends no block
                    up = root
                    break
                up = up.parent
            if up is not root:
                here = up.parent
            elif tag == "br":
                here.parts.append(Node("br", here))
            continue
        if tag in ("html", "body"):
            bad, good = _named(tag, m[3])
            root.good |= good
            continue
        if tag in P_ENDS or tag in CLOSES:
            up = here
            while up is not root and up.tag not in BLOCK:
                up = up.parent
            if up.tag in CLOSES.get(tag, {"p"}) or up.tag == "p":
                here = up.parent
                if tag in CLOSES and here.tag in CLOSES[tag]:
                    here = here.parent
        elif tag == "a":
            up = here
            while up is not root and up.tag not in BLOCK and up.tag != "a":
                up = up.parent
            if up.tag == "a":
                here = up.parent
        node = Node(tag, here, *_named(tag, m[3]))
        here.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes outside left-out parts, parents first. A stack, as pages may nest deeper than Python recurses."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in node.parts if isinstance(x, Node) and not x.bad]
    return out


def _blocks(node: Node) -> list[str]:
    """The texts of the blocks below node, in page order, white space made single."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := SPACE.sub(" ", "".join(line)).strip():
            out.append(text)
        line.clear()

    stack: list[str | Node | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append("\n")
        elif not x.bad or x is node:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(x.parts)
    end()
    return out


def _score(root: Node) -> list[Node]:
    """Containers with points, after paragraphs have passed theirs on."""
    nodes = _walk(root)
    own: dict[int, tuple[int, int]] = {}
    for node in reversed(nodes):  # children before parents
        chars = commas = 0
        for x in node.parts:
            if isinstance(x, str):
                s = x.strip()
                chars += len(s)
                commas += s.count(",") + s.count("،") + s.count("、") + s.count("，")
            elif not x.bad and x.tag not in BLOCK and id(x) in own:
                chars += own[id(x)][0]
                commas += own[id(x)][1]
        own[id(node)] = chars, commas
        node.n_text += chars if node.tag in BLOCK or node.parent is None else 0
        if node.tag == "a":
            node.n_link = chars
        if node.parent is not None:
            node.parent.n_link += node.n_link
            if node.tag in BLOCK:
                node.parent.n_text += node.n_text
        if chars and (node.tag in PARAGRAPH or node.tag in BLOCK or node.parent is None):
            points, up = 1 + commas + min(chars / 100, 3.0), node if node.tag not in PARAGRAPH else node.parent
            points *= 1 if chars >= 25 else 0.2
            share = 1.0
            while up is not None and share > 0.01:
                up.points += points * share
                up, share = up.parent, share / 2
    return [x for x in nodes if x.points > 0]


def _density(node: Node) -> float:
    return min(1.0, node.n_link / node.n_text) if node.n_text else 0.0


def main_text(source: str | None) -> str:
    if not source:
        return ""
    root = parse(source)
    scored = _score(root)
    if not scored:
        return ""
    value = {id(x): x.points * (1 - _density(x)) * (1.5 if x.good else 1.0) for x in scored}
    best = max(scored, key=lambda x: value[id(x)])
    while best.tag in PARAGRAPH and best.parent is not None:
        best = best.parent
    if best.parent is None:
        return " ".join(_blocks(best))
    least = max(10.0, 0.2 * value.get(id(best), 0.0))
    kept: list[str] = []
    for x in best.parent.parts:
        if x is best:
            kept += _blocks(best)
        elif isinstance(x, Node) and not x.bad:
            text = _blocks(x)
            chars = sum(map(len, text))
            near = value.get(id(x), 0.0) >= least
            reads = x.tag in PARAGRAPH and _density(x) < 0.25 and (chars > 80 or chars and text[-1][-1] in ".!?…")
            if near or reads or x.tag in ("h1", "h2", "h3"):
                kept += text
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(batches, "page_id long, url string, text string, n_chars long")
