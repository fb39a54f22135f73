"""Main text of web pages by tree scoring (operator 4).

The page becomes a tree of block elements; text directly in one is a block. Each block passes points for its length and
its commas to the elements around it, the more the nearer, and an element's score is discounted by its share of linked text. The best
container, or the article or main around it, and those siblings that score well or are text beside it are kept, without menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments inside them. Character references are decoded, white space within a
block (line-break tags included) becomes one blank, blocks are trimmed and joined in page order by a line feed.

Null or empty html gives an empty text with 0 characters, as does a page without text; broken and truncated markup is
read as far as it goes, an unfinished tag at the end is dropped. Rows are independent: repeated rows give equal rows, null
page_id or url are handed through, other columns are ignored, an empty table gives no rows. Very long pages are read whole; work grows
with the length and, for each block, with the number of elements around it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import small

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
DROPPED = frozenset("aside audio button canvas dialog embed fieldset footer form head iframe menu nav noscript object select svg template video".split())
CONTAINERS = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 3.0, "blockquote": 1.0, "pre": 1.0}
_SAFE = frozenset(("html", "body", "article", "main"))
_WHOLE = frozenset(("article", "main"))
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",))}
_WORDS = "ad|ads|adsense|advert|adverts|advertisement|advertising|adbox|banner|sponsor|sponsored|promo|promotion|comment|comments|commentlist|reply|replies|respond|disqus|discussion|sidebar|side-bar|rail|widget|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|toc|header|masthead|topbar|footer|foot|copyright|legal|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|recommendations|pager|pagination|hidden|skip|toolbar"
_BAD = re.compile(rf"(?:^|[\s_-])(?:{_WORDS})(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)
_BAD_ROLE = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"))
MIN_POINTS = 10.0
SIBLING_SHARE = 0.2


class _Node:
    __slots__ = ("parent", "tag", "dropped", "points", "chars", "linked", "bonus", "first", "last")

    def __init__(self, parent: _Node | None, tag: str, dropped: bool, bonus: float, first: int) -> None:
        self.parent, self.tag, self.dropped, self.bonus = parent, tag, dropped, bonus
        self.points = 0.0
        self.chars = self.linked = 0
        self.first, self.last = first, -1

    def score(self) -> float:
        return (self.points + (self.bonus if self.points else 0)) * (1 - self.linked / max(self.chars, 1))


def _judged(tag: str, attributes: str, inside_article: bool) -> tuple[bool, float]:
    """Whether an element is dropped by its tag or attributes, and what they add to its score."""
    if tag in DROPPED:
        return True, 0.0
    bonus = CONTAINERS.get(tag, 0.0)
    if tag == "header" and not inside_article:
        return True, 0.0
    if "=" in attributes or "hidden" in attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                if tag not in _SAFE and _BAD.search(value):
                    return True, 0.0
                if _GOOD.search(value):
                    bonus += 10.0
            elif name == "role" and value.lower() in _BAD_ROLE and tag not in _SAFE:
                return True, 0.0
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, 0.0
    return False, bonus


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = _Node(None, "#root", False, 0.0, 0)
    nodes, blocks = [root], []  # blocks: text and the node it lies in
    stack: list[tuple[str, _Node, int]] = [("#root", root, 0)]  # tag, block around, links around
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            node = stack[-1][1]
            if text := " ".join(html.unescape("".join(buffer)).split()):
                blocks.append((text, node))
                points, up, level = 1.0 + text.count(",") + min(len(text) / 100, 3.0), node if node.tag in CONTAINERS or node.parent is None else node.parent, 0
                above: _Node | None = node
                while above is not None:
                    above.chars += len(text)
                    above.linked += min(linked, len(text))
                    above = above.parent
                while up is not None and up.parent is not None:
                    up.points += points / (1, 2)[level] if level < 2 else points / (level * 3)
                    up, level = up.parent, level + 1
                root.points += points / 100
            buffer.clear()
        linked = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag, node, _ = stack.pop()
            if tag == node.tag and node is not stack[-1][1]:
                node.last = len(blocks)

    def open_at(tag: str, stops: tuple[str, ...]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                return i
            if stack[i][0] in stops:
                return 0
        return 0

    def text(piece: str) -> None:
        nonlocal linked
        if not stack[-1][1].dropped:
            buffer.append(piece)
            if stack[-1][2]:
                linked += len(piece)

    at = 0
    search = _TAG.search
    while m := search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if m[2] is None and not page.endswith(">", m.start(), m.end()):
            break  # a tag that the page ends in
        block = tag in BLOCK
        if closing:
            if i := open_at(tag, () if block else ("td", "th", "table")):
                if block or stack[i][1] is not stack[-1][1]:
                    flush()
                close(i)
            continue
        if block:
            flush()
            if i := open_at("p", ("table", "td", "th", "button", "object")):
                close(i)
            if tag in _CLOSES:
                other, stops = _CLOSES[tag]
                for t in {tag, other, "th" if tag == "td" else "td" if tag == "th" else tag}:
                    if i := open_at(t, stops):
                        close(i)
        elif tag == "br":
            text(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if not end:
                at = len(page)
                break
            at = end.start()
            close_tag = page.find(">", at)
            at = len(page) if close_tag < 0 else close_tag + 1
            continue
        around = stack[-1][1]
        links = stack[-1][2] + (tag == "a")
        dropped, bonus = around.dropped, 0.0
        if not dropped:
            dropped, bonus = _judged(tag, attributes, any(s[0] == "article" for s in stack) if tag == "header" else False)
        if attributes.endswith("/") and not block:
            continue
        if block or dropped and not around.dropped:
            if not block:
                flush()
            around = _Node(around, tag, dropped, bonus, len(blocks))
            nodes.append(around)
        stack.append((tag, around, links))
    if at < len(page) and "<" not in page[at : at + 1]:
        text(page[at:])
    flush()
    close(1)
    root.last = len(blocks)
    if not blocks:
        return ""
    best = max((n for n in nodes if n.points), key=_Node.score, default=root)
    limit = max(MIN_POINTS, best.score() * SIBLING_SHARE)
    above: _Node | None = best
    while above is not None:  # an article or main around it is taken whole
        if above.tag in _WHOLE:
            best = above
        above = above.parent
    kept = [best]
    if best.parent is not None:
        short = best.tag not in _WHOLE and best.parent.tag not in ("#root", "html", "body")
        kept += [n for n in nodes if n.parent is best.parent and n is not best and not n.dropped and (n.score() >= limit if n.tag in CONTAINERS else (short or n.tag == "p" and n.chars > 80) and n.linked < 0.25 * n.chars)]
    chosen = {id(n) for n in kept}
    verdict: dict[int, bool] = {}

    def inside(node: _Node | None) -> bool:
        path = []
        while node is not None and id(node) not in verdict and id(node) not in chosen:
            path.append(node)
            node = node.parent
        found = node is not None and (id(node) in chosen or verdict[id(node)])
        for n in path:
            verdict[id(n)] = found
        return found

    return "\n".join([t for t, n in blocks if inside(n)])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
