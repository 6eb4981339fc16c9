"""Main text of web pages by their line-block distribution."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.llm.common import table

WINDOW = 3
SURGE = 80
PARAGRAPH = 60

# Element names of HTML and words that pages name their parts with.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol"
    " p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
SILENT = frozenset(
    "audio button canvas datalist head label legend map nav noscript object option select svg"
    " template video menu dialog".split()
)
AROUND = frozenset("aside footer form header".split())
ROOTS = frozenset(["article", "main"])
ITEMS = frozenset(["li", "td", "dd", "dt"])
WITHIN = frozenset("p li blockquote pre td section header h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
PARTS = frozenset(
    "ad ads adbox advert advertisement advertising adverts adsense banner bottombar breadcrumb"
    " breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer discuss"
    " discussion disqus dropdown feedback foot footer form gdpr guestbook header links login masthead"
    " menu menubar modal nav navbar navigation navi newsletter notice notices notification overlay"
    " pager pagination paywall popup promo promotion recommended recommendations related replies reply"
    " respond response responses search share sharebar sharing sidebar signup skip social sponsor"
    " sponsored subscribe subscription tags toolbar topbar tracking widget widgets".split()
)
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search"
    " toolbar".split()
)
LAYOUT = frozenset(["has", "no", "with"])  # "with-sidebar" names a page that has one
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
REPLIES = frozenset(
    "comment commentlist comments discuss discussion disqus feedback guestbook replies reply respond"
    " response responses".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)",
    re.S,
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
WORD = re.compile(r"[a-z]+")
HUMP = re.compile(r"([a-z])([A-Z])")
NOTE = re.compile(r"(?:©|\(c\) |copyright\b|all rights reserved)", re.I)
REPLY_HEADING = re.compile(
    r"(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|responses?|replies|leave a (?:reply|comment)"
    r"|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d*\)?)?\s*:?",
    re.I,
)


class Node:
    """One element of the page: what rules its text out, and the main element it lies in.

    ``start`` and ``stop`` number the opening and the end of the element in page order.
    """

    __slots__ = ("name", "up", "out", "replies", "root", "soft", "item", "kind", "start", "stop")

    def __init__(self, name: str, up: Node | None, start: int):
        self.name, self.up, self.start, self.stop = name, up, start, None
        self.out = up.out if up else False
        self.replies = up.replies if up else False
        self.root = up.root if up else None
        self.soft = up.soft if up else None
        self.item = name in ITEMS or bool(up and up.item)

    def holds(self, other: Node) -> bool:
        return self.start <= other.start and (self.stop is None or other.start < self.stop)


def words(attributes: str) -> tuple[frozenset, str]:
    """Words of an element's class and id, and its role."""
    names, role = [], ""
    for name, *values in ATTRIBUTE.findall(attributes):
        value = html.unescape("".join(values))
        name = name.lower()
        if name in ("class", "id"):
            names += WORD.findall(HUMP.sub(r"\1 \2", value).lower())
        elif name == "role":
            role = value.strip().lower()
        elif name == "itemprop" and value.lower() == "articlebody":
            role = role or "article"
    return frozenset(names), role


def placed(name: str, attributes: str, up: Node, start: int) -> Node:
    """The node of an opening tag."""
    node = Node(name, up, start)
    names, role = words(attributes) if "=" in attributes else (frozenset(), "")
    if names & REPLIES and not names & LAYOUT and name not in ("html", "body"):
        node.replies = True
    root = name in ROOTS or role in ("main", "article")
    named = role in ROLES or names & PARTS and not names & LAYOUT and name not in HEADINGS
    if up.root is not None and names & PARTS == {"header"} and role not in ROLES:
        named = False  # the heading of the article itself
    if root and not node.replies and not named:
        # A main element ends what an unclosed or wrapping part around it has ruled out.
        node.out, node.soft = False, None
        node.kind = "article" if "article" in (name, role) else "main"
        node.root = up.root if up.root and up.root.kind == "article" else node
    elif name in SILENT:
        node.out = True
    elif name not in ("html", "body") and (name in AROUND or named):
        heading = name == "header" and up.root is not None and not named
        if not heading:
            if name in ("form", "header") or names & {"form", "header"}:
                node.soft = node.soft or node  # pages may lie in one form or header as a whole
            else:
                node.out = True
    return node


class Line:
    __slots__ = ("text", "node", "linked", "weight")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked
        self.weight = max(len(text) - linked, 0)


def lines_of(page: str) -> list[Line]:
    """The page without markup, one line for each block of text, in page order."""
    top = Node("", None, 0)
    n_nodes = 1
    stack, opened = [top], Counter()
    lines: list[Line] = []
    parts: list[str] = []
    linked = links = at = 0
    node = top

    def close_line():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append(Line(text, node, min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    def pop_to(index: int):
        nonlocal node
        for gone in stack[index:]:
            opened[gone.name] -= 1
            gone.stop = n_nodes
        del stack[index:]
        node = stack[-1]

    while True:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in RAW and not found[1]:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            links = 0 if found[1] else 1
            continue
        block = name in BLOCKS
        if not block and name not in SILENT:
            if name in ("img", "input"):
                parts.append(" ")
            continue
        close_line()
        if block:
            links = 0
        if name in VOID:
            continue
        if found[1]:
            if opened[name]:
                index = len(stack) - 1
                while stack[index].name != name:
                    index -= 1
                pop_to(index)
            continue
        if name == "body":
            while node.name == "head":
                pop_to(len(stack) - 1)
        closing = CLOSED_BY.get(name)
        if closing and any(opened[c] for c in closing):
            scope = SCOPES.get(name, ("table",))
            index = len(stack) - 1
            while index > 0 and stack[index].name not in scope and stack[index].name not in closing:
                index -= 1
            if index > 0 and stack[index].name in closing:
                pop_to(index)
        if block and node.name == "p":
            pop_to(len(stack) - 1)  # a paragraph ends where the next block starts
        if not found[3].endswith("/") or block:
            node = placed(name, found[3], node, n_nodes)
            n_nodes += 1
            stack.append(node)
            opened[name] += 1
    close_line()
    return lines


def menus(lines: list[Line]) -> set[int]:
    """Lines in runs of three or more list items that are nothing but links."""
    found, run = set(), []
    for i, line in enumerate([*lines, None]):
        if line is not None and line.weight == 0 and line.node.item:
            run.append(i)
            continue
        if len(run) >= 3:
            found.update(run)
        run = []
    return found


def window_sums(weights: np.ndarray, window: int) -> np.ndarray:
    """Sum of the weights of each line and the ``window - 1`` after it."""
    total = np.concatenate([[0], np.cumsum(weights)])
    ends = np.minimum(np.arange(len(weights)) + window, len(weights))
    return total[ends] - total[: len(weights)]


def surges(weights: np.ndarray, window: int, surge: int) -> list[tuple[int, int]]:
    """Stretches from a surge of the window sums to the dive after it, without blank ends.

    A surge is a window above the threshold; the stretch dives where a window sum falls to zero.
    """
    sums = window_sums(weights, window)
    found, at, n = [], 0, len(weights)
    while at < n:
        if weights[at] == 0 or sums[at] <= surge:
            at += 1
            continue
        stop = at
        while stop < n and sums[stop] > 0:
            stop += 1
        last = stop
        while weights[last - 1] == 0:
            last -= 1
        found.append((at, last))
        at = max(stop, at + 1)
    return found


def container(lines: list[Line], weights: np.ndarray, span: tuple[int, int]) -> Node:
    """The innermost element around all paragraphs of a stretch of lines."""
    inside = [i for i in range(*span) if weights[i]]
    least = min(PARAGRAPH, max(weights[i] for i in inside) // 2)
    nodes = [lines[i].node for i in inside if weights[i] >= least]
    node, last = (f(nodes, key=lambda x: x.start) for f in (min, max))
    while not node.holds(last):
        node = node.up
    while node.up and node.name in WITHIN:
        node = node.up
    return node


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Main text of one page."""
    lines = lines_of(page or "")
    if not lines:
        return ""
    ruled = menus(lines)
    replies: Node | None = None
    weights = np.array([line.weight for line in lines], np.int64)
    hard = np.zeros(len(lines), bool)
    soft = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        if replies is not None and not replies.holds(line.node):
            replies = None
        if replies is None and line.node.root is None and REPLY_HEADING.fullmatch(line.text):
            replies = line.node.up or line.node
        hard[i] = line.node.out or line.node.replies or i in ruled or replies is not None
        hard[i] |= line.node.root is None and bool(NOTE.match(line.text))
        soft[i] = line.node.soft is not None
    if weights[~hard & ~soft].sum() * 2 >= weights[~hard].sum():
        hard |= soft  # otherwise the page itself lies in the form or header
    weights[hard] = 0
    for kind in ("article", "main"):
        rooted = np.array([bool(x.node.root and x.node.root.kind == kind) for x in lines])
        if weights[rooted].sum():
            # Inside the page's own main element every line that is not ruled out is text.
            inside = rooted & ~hard
            spans = surges(np.where(inside, np.maximum(weights, 1), 0), window, 0)
            break
    else:
        if not weights.sum():
            return ""
        peak = int(window_sums(weights, window).max())
        spans = surges(weights, window, min(surge, peak // 2))
        sums = window_sums(weights, window)
        main = next(s for s in spans if sums[s[0] : s[1]].max() == peak)
        around = container(lines, weights, main)
        inside = np.array([around.holds(line.node) for line in lines]) & ~hard
        spans = [s for s in spans if inside[s[0] : s[1]].any()]
    kept = np.zeros(len(lines), bool)
    for first, last in spans:
        kept[first:last] = True
    return "\n".join(line.text for line, k, i in zip(lines, kept, inside, strict=True) if k and i)


def main_texts(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of each page, one row for each input row.

    Markup is stripped to one line for each block of text (a line break or white space inside a
    block is one space), and each line weighs what it holds outside links.  Lines of menus, headers,
    footers, sidebars, notices, adverts, forms and reader comments, told by element, role, class and
    id, and runs of list items that are only links are blank.  Weights are summed over sliding
    windows of ``window`` lines; text runs from a surge, a window above ``surge`` characters,
    to the dive where a window is empty.  Where a page marks its article or main element, lines
    elsewhere are blank and any line is a surge; otherwise the element around the paragraphs of
    the highest stretch bounds the text, and half its height is a surge where that is lower.
    Headings inside the article stay.

    A null or empty page, or one without such text, gives an empty text with 0 characters; unclosed
    and truncated markup is read to its end; ties between stretches go to the first; repeated rows
    and null ids are kept; an empty table gives no rows; further columns are ignored.  Rows are
    independent, so nothing is shuffled.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [extract(page.as_py(), window, surge) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
