"""HTML as arrays of nodes: a tolerant, linear-time parser, and features of each node.

Nodes are block elements, inline elements that have a class, id or role or hold what is shown in place of something else,
and runs of text beside other nodes. Text lies in leaves only. A node's parent comes before it. Only scripts, styles,
templates and form controls are left out whole; formulas, drawings and listings are text like any other.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np

#: HTML's block elements, elements without an end, and elements without text of the page (of raw text, and with marks).
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup p pre search section summary table caption tbody thead tfoot tr td th ul".split()
)
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
DROPPED = frozenset("template select datalist button".split())
#: Inline elements that are nodes of their own even without attributes, as what stands in them may be a notice.
APART = frozenset("noscript object canvas audio video map".split())
#: A start of the key ends the open elements of the value, up to a list or table around them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
BORDERS = frozenset("ul ol menu dl table".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\s\"'])))*+)>")
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

TEXT = "#text"


class Page:
    """Lists by node: tag, parent, depth, attribute tokens, text (of leaves), borders before it, link characters."""

    __slots__ = ("border", "border_end", "depth", "link", "parent", "tag", "text", "tokens")

    def __init__(self):
        self.tag, self.parent, self.depth, self.tokens = ["#page"], [-1], [0], [()]
        self.text, self.border, self.border_end, self.link = [""], [0], [0], [0]

    def add(self, tag: str, parent: int, tokens: tuple, border: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tokens.append(tokens)
        self.text.append("")
        self.border.append(border)
        self.border_end.append(border)
        self.link.append(0)
        return len(self.tag) - 1


def tokens_of(attributes: str) -> tuple[str, ...]:
    """Lower-case words of an element's class, id, role, label and itemprop, without a plural s."""
    out = []
    for _, value in _ATTRIBUTE.findall(attributes):
        for word in _TOKEN.findall(value):
            word = word.lower()
            out.append(word[:-1] if len(word) > 3 and word.endswith("s") else word)
    return tuple(dict.fromkeys(out))


def parse(html: str) -> Page:
    page, at, end = Page(), 0, len(html)
    stack, names, opened, has_child = [0], ["#page"], {}, [False]
    pieces: list[str] = []  # of the run of text that is open
    run_border, border, link_chars, in_link = 0, 0, 0, False

    def flush() -> None:
        nonlocal link_chars, border
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            if text.isspace():
                border += 1
            elif text:
                node = page.add(TEXT, stack[-1], (), run_border) if has_child[-1] else stack[-1]
                page.text[node], page.link[node] = text, link_chars
                page.border[node], page.border_end[node] = run_border, border
        link_chars = 0

    def pop() -> None:
        flush()
        name = names.pop()
        opened[name] -= 1
        stack.pop()
        has_child.pop()

    def pop_to(name: str) -> None:
        while names[-1] != name:
            pop()
        pop()

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            chunk = html[at:lt]
            if "&" in chunk:
                chunk = unescape(chunk)
            if not pieces:
                run_border = border
            pieces.append(chunk)
            if in_link:
                link_chars += len(chunk)
        if lt >= end:
            break
        found = _TAG.match(html, lt)
        if not found:
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 2)
                at = end if close < 0 else close + 3
            elif html.startswith(("<!", "<?"), lt) or (html.startswith("</", lt) and lt + 2 < end):
                close = html.find(">", lt)
                at = end if close < 0 else close + 1
            elif re.match(r"<[a-zA-Z]", html[lt : lt + 2]):
                at = end  # a tag that never ends
            else:
                if not pieces:
                    run_border = border
                pieces.append("<")
                at = lt + 1
            continue
        at = found.end()
        closing, name, attributes = found.groups()
        name = name.lower()
        if closing:
            if name == "a":
                in_link = False
            elif name == "p" and not opened.get("p"):
                border += 1
                pieces.append(" ")
            if opened.get(name):
                if name not in BLOCKS:
                    top = len(names) - 1
                    while names[top] != name and names[top] not in BLOCKS:
                        top -= 1
                    if names[top] == name:  # an inline element isn't ended from inside a block
                        pop_to(name)
                    continue
                in_link = False
                pop_to(name)
                border += 1
            continue
        if name in RAW or name in DROPPED:
            if name in DROPPED:
                at = at if attributes.endswith("/") else _skip(html, at, name)
            else:
                close = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                at = end if not close else (html.find(">", close.end()) + 1 or end)
            continue
        if name == "xmp":  # text as it stands, without marks and references
            close = re.compile(r"</xmp(?=[\s/>])", re.IGNORECASE).search(html, at)
            stop = close.start() if close else end
            if not pieces:
                run_border = border
            border += 1
            pieces.append(f" {html[at:stop]} ")
            at = end if not close else (html.find(">", close.end()) + 1 or end)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                border += 1
                pieces.append(" ")
            continue
        block = name in BLOCKS
        tokens = tokens_of(attributes) if "=" in attributes else ()
        if block:
            if opened.get("p"):
                pop_to("p")
            for ended in ENDS.get(name, ()):
                if opened.get(ended):
                    inside = len(names) - 1
                    while inside and names[inside] != ended and names[inside] not in BORDERS:
                        inside -= 1
                    if names[inside] == ended:
                        pop_to(ended)
            in_link = False
        elif not tokens and name not in APART or attributes.endswith("/"):
            if name == "a":
                in_link = True
            continue
        has_child[-1] = True
        flush()
        if block:
            border += 1
        if name == "a":
            in_link = True
        node = page.add(name, stack[-1], tokens, border)
        stack.append(node)
        names.append(name)
        has_child.append(False)
        opened[name] = opened.get(name, 0) + 1
    while len(stack) > 1:
        pop()
    has_child[-1] = True
    flush()
    return page


def _skip(html: str, at: int, name: str) -> int:
    """The place behind the end of an element whose content doesn't count."""
    depth = 1
    for m in re.compile(f"<(/?){name}(?=[\\s/>])", re.IGNORECASE).finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            close = html.find(">", m.end())
            return len(html) if close < 0 else close + 1
    return len(html)


TAG_GROUPS = ("nav", "header", "footer", "aside", "form fieldset legend", "article", "main", "section", "div center", "p", "h1 h2", "h3 h4 h5 h6", "ul ol menu dl dir", "li dt dd", "table tbody thead tfoot tr td th caption", "blockquote pre figure figcaption", "body html #page", TEXT, "a span")
_GROUP_OF = {t: i for i, names in enumerate(TAG_GROUPS) for t in names.split()}
BOILER_TAGS = frozenset(("nav", "header", "footer", "aside", "form"))
FEATURES = (
    *(f"tag {g}" for g in TAG_GROUPS),
    "chars", "link share", "nodes", "density", "marks", "share of page", "paragraphs", "list items", "headings",
    "depth", "children", "siblings", "place among siblings", "siblings alike", "mean of siblings", "before", "after", "place in page",
    "in article", "in boilerplate tag", "in list", "own tokens low", "own tokens high", "path tokens low", "path tokens high", "articles around", "from the end",
)


def node_features(pages: list[Page], token_odds: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of all pages, each node's parent (-1 for pages) and depth."""
    starts = np.cumsum([0, *(len(p.tag) for p in pages)])
    n = int(starts[-1])
    page = np.repeat(np.arange(len(pages)), np.diff(starts))
    parent = np.concatenate([np.array(p.parent) for p in pages]) + np.where(np.concatenate([np.array(p.parent) for p in pages]) >= 0, starts[page], 0)
    depth = np.concatenate([np.array(p.depth) for p in pages])
    tags = [t for p in pages for t in p.tag]
    group = np.array([_GROUP_OF.get(t, len(TAG_GROUPS)) for t in tags])
    texts = [t for p in pages for t in p.text]
    chars = np.fromiter(map(len, texts), float, n)
    links = np.array([x for p in pages for x in p.link], float)
    marks = np.array([t.count(".") + t.count(",") if t else 0 for t in texts], float)
    ones, para = np.ones(n), (group == _GROUP_OF["p"]).astype(float)
    items, heads = (group == _GROUP_OF["li"]).astype(float), ((group == _GROUP_OF["h1"]) | (group == _GROUP_OF["h3"])).astype(float)
    tops = (group == _GROUP_OF["article"]) | (group == _GROUP_OF["main"])
    boiler = np.fromiter((t in BOILER_TAGS for t in tags), bool, n)
    lists = (group == _GROUP_OF["ul"]) | items.astype(bool)
    odds = [[token_odds.get(w, 0.0) for w in x] for p in pages for x in p.tokens]
    low, high = np.array([min(o, default=0.0) for o in odds]), np.array([max(o, default=0.0) for o in odds])
    low, high = np.minimum(low, 0), np.maximum(high, 0)
    sums = np.column_stack([chars, links, marks, ones, para, items, heads])
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    for level in reversed(levels[1:]):
        np.add.at(sums, parent[level], sums[level])
    inherited = np.column_stack([tops, boiler, lists, low, high, group == _GROUP_OF["article"]]).astype(float)
    for level in levels[1:]:
        up = inherited[parent[level]]
        inherited[level, :3] = np.maximum(inherited[level, :3], up[:, :3])
        inherited[level, 3] = np.minimum(inherited[level, 3], up[:, 3])
        inherited[level, 4] = np.maximum(inherited[level, 4], up[:, 4])
        inherited[level, 5] += up[:, 5]
    total, up = sums[:, 0], np.maximum(parent, 0)
    children = np.bincount(up[parent >= 0], minlength=n).astype(float)
    whole = np.maximum(1, total[starts[:-1]])[page]
    # Siblings in page order: those of one parent follow each other once sorted by parent.
    by_parent = np.lexsort((np.arange(n), parent))
    first = np.searchsorted(parent[by_parent], parent[by_parent])
    place = np.empty(n)
    place[by_parent] = np.arange(n) - first
    before, after = np.zeros(n), np.zeros(n)
    if n > 1:
        same = parent[by_parent][1:] == parent[by_parent][:-1]
        before[by_parent[1:][same]] = total[by_parent[:-1][same]]
        after[by_parent[:-1][same]] = total[by_parent[1:][same]]
    siblings = np.where(parent >= 0, children[up], 1)
    alike_key = parent * 64 + group
    _, inverse, counts = np.unique(alike_key, return_inverse=True, return_counts=True)
    mean = (total[up] - total) / np.maximum(1, siblings - 1) * (parent >= 0)
    offset = np.cumsum(chars) - chars
    offset = (offset - offset[starts[:-1]][page]) / whole
    hot = np.zeros((n, len(TAG_GROUPS) + 1), np.float32)
    hot[np.arange(n), group] = 1
    log = np.log1p
    rest = [
        log(total), sums[:, 1] / np.maximum(1, total), log(sums[:, 3]), log(total / sums[:, 3]), sums[:, 2] / np.maximum(1, total), total / whole, log(sums[:, 4]), log(sums[:, 5]), log(sums[:, 6]),
        np.minimum(depth, 30), log(children), log(siblings), place / np.maximum(1, siblings - 1), log(counts[inverse]), log(mean), log(before), log(after), offset,
        inherited[:, 0], inherited[:, 1], inherited[:, 2], low, high, inherited[:, 3], inherited[:, 4], inherited[:, 5], 1 - offset - total / whole,
    ]
    return np.column_stack([hot[:, : len(TAG_GROUPS)], *rest]).astype(np.float32), parent, depth


def kept_text(page: Page, keep: np.ndarray) -> str:
    """Text of the kept leaves in page order: borders between them and white space inside become one space."""
    out, last = [], 0
    for i in np.flatnonzero(keep).tolist():
        text = page.text[i]
        if text:
            if page.border[i] != last:
                out.append(" ")
            out.append(text)
            last = page.border_end[i]
    return " ".join("".join(out).split())
