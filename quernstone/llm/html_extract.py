"""Operator 8: HTML extraction by gradient-boosted trees over DOM nodes with hierarchical decoding.

Trees (see boosting.py) give each node of a page (see dom.py) the odds that it holds main text, from its tag, the density
and size of its subtree, attribute tokens on it and above it, depth, and statistics of its siblings. Decoding finds the
likeliest labelling in which no kept node has a dropped ancestor: a dropped node drops its subtree, and a kept one keeps
the way to it. The trees are trained here on pages made from a seed, in many layouts, of which every part is known.

A page's text: character references decoded; white space inside a block and borders of blocks and br elements become one
space; ends trimmed. Markup, scripts, styles, forms' fields, comments of the markup and whatever the trees call menus,
headers, footers, sidebars, notices, adverts or reader comments are left out; nothing else is. Null and empty pages, and
pages without main text, give the empty text. Repeated rows each get a row. Other columns pass through, but for those
named like results. An empty table gives no rows. A tag that never ends drops what follows it, as in browsers.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quernstone.llm import dom
from quernstone.llm.boosting import Boosting
from quernstone.llm.common import read, text_slices, tidied
from quernstone.session import worker_path

TRAIN_PAGES, SEED = 700, 11
#: Bytes of html that are held as nodes at a time; a longer page is alone.
BATCH_BYTES = 1_000_000
#: Attribute words that training pages use, for main text and for each kind of the rest.
MAIN_WORDS = "content article post entry main body text story page-content article-body post-body entry-content main-content single prose".split()
REST_WORDS = {
    "nav": "nav menu navbar navigation main-menu top-menu breadcrumbs breadcrumb pagination pager toc links topnav site-nav submenu".split(),
    "header": "header site-header masthead top-bar branding logo site-title tagline page-header hero-header".split(),
    "footer": "footer site-footer bottom copyright legal colophon footer-links page-footer credits".split(),
    "aside": "sidebar side aside widget widget-area related related-posts recommended rail trending popular more-stories secondary".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert banner popup modal overlay privacy-notice message announcement paywall disclaimer".split(),
    "ad": "ad ads advert advertisement adsbox banner-ad sponsored sponsor promo promotion adslot teaser-ad ad-container partner commercial".split(),
    "form": "form search search-form newsletter subscribe signup login contact-form subscription register".split(),
    "comments": "comments comment comment-list comment-body reply replies respond discussion disqus reader-comments feedback user-comments".split(),
    "share": "share social share-buttons social-links sharing follow-us tags post-tags author-box byline-links".split(),
}
PLAIN_WORDS = "wrapper container row col inner outer block box section grid wrap layout x1 css-1ab item clearfix left-col".split()


class _Maker:
    """Writes one training page; marks main text with \\x01 so that the nodes that hold it are known."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.syllables = ["".join(r.choice("bcdfghlmnprstvwz") + r.choice("aeiouéäñ") + r.choice(["", "", "n", "r", "s", "t"]) for _ in range(1)) for _ in range(40)]
        self.junk = r.random() < 0.15
        self.classes = r.random() < 0.85
        self.main = True

    def words(self, n: int) -> str:
        r, out = self.r, []
        while len(out) < n:
            size = max(1, min(n - len(out), r.randint(1, 14)))
            sentence = ["".join(r.choices(self.syllables, k=r.randint(1, 3))) for _ in range(size)]
            if self.junk and self.main:
                sentence = [w + r.choice(["***", "%%%", "&amp;&amp;", "$$$", "###"]) for w in sentence]
            sentence[0] = sentence[0].capitalize()
            sentence[-1] += r.choice([".", ".", ".", ",", "!", "?", " &amp;", ""])
            out += sentence
        return ("\x01" if self.main else "") + " ".join(out)

    def attribute(self, words: list[str], chance: float = 1.0) -> str:
        r = self.r
        if not self.classes or r.random() > chance:
            return "" if r.random() < 0.7 else f' class="{r.choice(PLAIN_WORDS)}"'
        name = r.choice(words)
        if r.random() < 0.3:
            name += " " + r.choice(PLAIN_WORDS)
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int) -> str:
        r = self.r
        return "".join(f'<li><a href="/{i}">{self.words(r.choice([1, 1, 1, 2, 3, 6]))}</a></li>' for i in range(n))

    def rest(self, kind: str) -> str:
        """A part that isn't main text."""
        r, old = self.r, self.main
        self.main = False
        out = getattr(self, "_" + kind)()
        self.main = old
        return out

    def _nav(self) -> str:
        r = self.r
        inner = f"<ul{self.attribute(REST_WORDS['nav'], 0.3)}>{self.links(r.randint(2, 12))}</ul>" if r.random() < 0.7 else " | ".join(f'<a href="#">{self.words(r.randint(1, 3))}</a>' for _ in range(r.randint(2, 8)))
        tag = r.choice(["nav", "nav", "div", "ul"])
        if tag == "ul":
            return f"<ul{self.attribute(REST_WORDS['nav'])}>{self.links(r.randint(3, 12))}</ul>"
        return f"<{tag}{self.attribute(REST_WORDS['nav'], 0.4 if tag == 'nav' else 1)}>{inner}</{tag}>"

    def _header(self) -> str:
        r = self.r
        inner = r.choice([f"<h1>{self.words(r.randint(1, 4))}</h1>", f'<a href="/">{self.words(2)}</a>', f"<div>{self.words(3)}</div>", f"<p>{self.words(r.randint(2, 12))}</p>"]) + r.choice(["", f"<p>{self.words(r.randint(3, 10))}</p>", self._nav()])
        tag = r.choice(["header", "header", "div"])
        return f"<{tag}{self.attribute(REST_WORDS['header'], 0.4 if tag == 'header' else 1)}>{inner}</{tag}>"

    def _footer(self) -> str:
        r = self.r
        inner = r.choice([f"&copy; {self.words(r.randint(2, 14))}", f"<p>&copy; 2020 {self.words(r.randint(2, 30))}</p>", f"<ul>{self.links(r.randint(2, 8))}</ul><p>{self.words(8)}</p>", f"<div>{self.words(r.randint(2, 9))}</div><div>{self.words(r.randint(5, 25))}</div>"])
        tag = r.choice(["footer", "footer", "div"])
        return f"<{tag}{self.attribute(REST_WORDS['footer'], 0.4 if tag == 'footer' else 1)}>{inner}</{tag}>"

    def _aside(self) -> str:
        r = self.r
        widget = lambda: r.choice([f"<h3>{self.words(r.randint(1, 4))}</h3><ul>{self.links(r.randint(2, 8))}</ul>", f"<h4>{self.words(2)}</h4><p>{self.words(r.randint(5, 60))}</p>", f"<p>{self.words(r.randint(3, 40))}</p>", f"<div>{self.words(r.randint(3, 20))}</div>"])
        tag = r.choice(["aside", "aside", "div", "section"])
        return f"<{tag}{self.attribute(REST_WORDS['aside'], 0.4 if tag == 'aside' else 1)}>{''.join(f'<div>{widget()}</div>' if r.random() < 0.4 else widget() for _ in range(r.randint(1, 4)))}</{tag}>"

    def _classed(self, kind: str, low: int, high: int) -> str:
        r = self.r
        self_classes, self.classes = self.classes, True  # nothing else tells these from text
        tag = r.choice(["div", "div", "div", "p", "section", "span", "aside"])
        inner = self.words(r.randint(low, high))
        if tag in ("div", "section", "aside"):
            inner = r.choice([inner, f"<p>{inner}</p>", f'{inner} <a href="#">{self.words(1)}</a>', f'<div>{inner}</div><a href="#">{self.words(2)}</a>', f"<h3>{self.words(2)}</h3><p>{inner}</p>"])
        out = f"<{tag}{self.attribute(REST_WORDS[kind])}>{inner}</{tag}>"
        self.classes = self_classes
        return out

    def _notice(self) -> str:
        return self._classed("notice", 3, 45)

    def _ad(self) -> str:
        return self._classed("ad", 1, 40)

    def _share(self) -> str:
        r = self.r
        return f"<div{self.attribute(REST_WORDS['share'])}>{r.choice([self.words(r.randint(1, 3)), ''])}<ul>{self.links(r.randint(1, 6))}</ul></div>"

    def _form(self) -> str:
        r = self.r
        inner = "".join(r.choice([f"<label>{self.words(r.randint(1, 3))}</label><input name=q>", f"<p>{self.words(r.randint(2, 25))}</p>", f"<h3>{self.words(3)}</h3>", f"<div><label>{self.words(2)}</label> <input></div>", f"<button>{self.words(1)}</button>"]) for _ in range(r.randint(1, 4)))
        form = f"<form{self.attribute(REST_WORDS['form'], 0.5)}>{inner}</form>"
        return form if r.random() < 0.6 else f"<div{self.attribute(REST_WORDS['form'])}><p>{self.words(r.randint(2, 15))}</p>{form}</div>"

    def _comments(self) -> str:
        r = self.r
        old, self.classes = self.classes, True
        tag, each = r.choice([("div", "div"), ("section", "article"), ("ul", "li"), ("ol", "li"), ("div", "article"), ("section", "div")])
        outer = self.attribute(REST_WORDS["comments"])
        one = lambda: f"<{each}{self.attribute(REST_WORDS['comments'], 0.7)}>" + r.choice(["", f"<h4>{self.words(2)}</h4>", f"<b>{self.words(2)}</b>", f"<div>{self.words(2)}</div>"]) + r.choice([f"<p>{self.words(r.randint(2, 80))}</p>", self.words(r.randint(2, 80)), f"<p>{self.words(20)}</p><p>{self.words(30)}</p>"]) + f"</{each}>"
        head = r.choice(["", f"<h2>{self.words(2)}</h2>", f"<h3>{self.words(2)}</h3>"]) if tag in ("div", "section") else ""
        out = f"<{tag}{outer}>{head}{''.join(one() for _ in range(r.randint(1, 6)))}</{tag}>"
        self.classes = old
        return out

    def paragraph(self) -> str:
        r = self.r
        n = r.choice([1, 2, 3, 5, 8, 15, 30, 30, 60, 60, 90, 150, 400])
        text, pick = self.words(n), r.random()
        if pick < 0.12:
            return f"<p><b>{text}<br>"
        if pick < 0.2:
            return f'<p>{text} <a href="/x">{self.words(r.randint(1, 6))}</a> {self.words(r.randint(1, 20))}</p>'
        if pick < 0.27:
            return f'<p>{text} <span class="{r.choice(["highlight", "name", "mark", "dropcap", "small", "date"])}">{self.words(r.randint(1, 4))}</span> {self.words(6)}</p>'
        if pick < 0.31:
            return f"<div>{text}</div>"
        if pick < 0.34:
            return f'<p class="{r.choice(["lead", "intro", "first", "summary", "dek", "caption"])}">{text}</p>'
        return f"<p>{text}</p>"

    def block(self) -> str:
        r, pick = self.r, self.r.random()
        if pick < 0.78:
            return self.paragraph()
        if pick < 0.86:
            return f"<h{r.randint(2, 4)}>{self.words(r.randint(1, 9))}</h{2}>"
        if pick < 0.9:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>{''.join(f'<li>{self.words(r.randint(1, 25))}</li>' for _ in range(r.randint(2, 7)))}</{tag}>"
        if pick < 0.93:
            return f"<blockquote><p>{self.words(r.randint(5, 50))}</p></blockquote>"
        if pick < 0.96:
            return f"<figure><img src=x><figcaption>{self.words(r.randint(2, 15))}</figcaption></figure>"
        if pick < 0.98:
            return f"<table>{''.join(f'<tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr>' for _ in range(r.randint(2, 5)))}</table>"
        return f"<pre>{self.words(r.randint(4, 30))}</pre>"

    def page(self) -> str:
        r = self.r
        title = f"<h1>{self.words(r.randint(1, 12))}</h1>"
        if r.random() < 0.1:
            title = f"<header>{title}<p>{self.words(r.randint(1, 8))}</p></header>"
        blocks = [self.block() for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12, 20, 40]))]
        for kind, chance in (("ad", 0.2), ("share", 0.15), ("aside", 0.1), ("notice", 0.1), ("form", 0.08), ("nav", 0.06)):
            if r.random() < chance:
                blocks.insert(r.randint(0, len(blocks)), self.rest(kind))
        if r.random() < 0.12:
            blocks.append(self.rest("comments"))
        if r.random() < 0.06:
            blocks.append(self.rest("footer"))
        inner = (title if r.random() < 0.9 else "") + "".join(blocks)
        if not inner:
            inner = title
        pick = r.random()
        if pick < 0.45:
            main = f"<article{self.attribute(MAIN_WORDS, 0.4)}>{inner}</article>"
        elif pick < 0.6:
            main = f"<main{self.attribute(MAIN_WORDS, 0.4)}>{inner}</main>"
        elif pick < 0.7:
            main = f"<main><article{self.attribute(MAIN_WORDS, 0.5)}>{inner}</article>{self.rest('comments') if r.random() < 0.3 else ''}</main>"
        elif pick < 0.97:
            old, self.classes = self.classes, True
            tag = r.choice(["div", "div", "section"])
            main = f"<{tag}{self.attribute(MAIN_WORDS)}>{inner}</{tag}>"
            self.classes = old
            if r.random() < 0.3:
                main = f"<div{self.attribute(PLAIN_WORDS)}>{main}</div>"
        else:
            main = inner
        before = [k for k, c in (("notice", 0.2), ("header", 0.5), ("nav", 0.7), ("ad", 0.45), ("form", 0.2), ("share", 0.05)) if r.random() < c]
        after = [k for k, c in (("comments", 0.25), ("aside", 0.35), ("ad", 0.25), ("nav", 0.15), ("form", 0.15), ("footer", 0.8), ("notice", 0.15)) if r.random() < c]
        if r.random() < 0.3:
            r.shuffle(before)
            r.shuffle(after)
        parts = [*map(self.rest, before), main, *map(self.rest, after)]
        if r.random() < 0.3:
            at = r.randint(0, len(before))
            end = r.randint(len(before) + 1, len(parts))
            parts[at:end] = [f"<div{self.attribute(PLAIN_WORDS)}>{''.join(parts[at:end])}</div>"]
        return f"<!DOCTYPE html><html><head><title>t</title><script>var t='</p>';</script></head><body{self.attribute(PLAIN_WORDS, 0.3)}>{''.join(parts)}</body></html>"


def training_pages(count: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    """Pages without marks, and for each node whether it or a node below it holds main text."""
    out = []
    for i in range(count):
        html = _Maker(seed * 1_000_003 + i).page()
        marked = dom.parse(html)
        holds = ["\x01" in t for t in marked.text]
        for k in range(len(holds) - 1, 0, -1):
            if holds[k]:
                holds[marked.parent[k]] = True
        holds[0] = True
        out.append((html.replace("\x01", ""), holds))
    return out


class Extractor:
    def __init__(self, odds: dict[str, float], trees: Boosting):
        self.odds, self.trees = odds, trees

    def keep(self, pages: list[dom.Page]) -> list[np.ndarray]:
        """For each node of each page whether it is kept."""
        x, parent, depth = dom.node_features(pages, self.odds)
        kept = decode(self.trees.raw(x), parent, depth)
        return np.split(kept, np.cumsum([len(p.tag) for p in pages])[:-1])

    def texts(self, htmls: list[str]) -> list[str]:
        pages = [dom.parse(h) for h in htmls]
        return [dom.kept_text(p, k) for p, k in zip(pages, self.keep(pages), strict=True)] if pages else []


def decode(raw: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The likeliest labels with no kept node under a dropped one, from each node's log-odds.

    Relative to dropping everything, keeping a node gains its log-odds and whatever its children gain at best.
    """
    gain = raw.astype(float).copy()
    gain[parent < 0] = np.inf  # a page itself is always kept
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
    for level in reversed(levels[1:]):
        np.add.at(gain, parent[level], np.maximum(gain[level], 0))
    kept = gain > 0
    for level in levels[1:]:
        kept[level] &= kept[parent[level]]
    return kept


def token_odds(pages: list[dom.Page], holds: list[list[bool]]) -> dict[str, float]:
    """Log-odds that an element with an attribute word holds main text, smoothed, from the training pages."""
    seen: dict[str, list[int]] = {}
    for page, held in zip(pages, holds, strict=True):
        for tokens, h in zip(page.tokens, held, strict=True):
            for w in tokens:
                seen.setdefault(w, [0, 0])[h] += 1
    return {w: float(np.log((b + 1) / (a + 1))) for w, (a, b) in seen.items() if a + b >= 4}


@lru_cache(maxsize=1)
def extractor(count: int = TRAIN_PAGES, seed: int = SEED) -> Extractor:
    """The trained extractor; a few seconds, once in a process."""
    made = training_pages(count, seed)
    pages, holds = [dom.parse(h) for h, _ in made], [held for _, held in made]
    odds = token_odds(pages, holds)
    x, _, _ = dom.node_features(pages, odds)
    return Extractor(odds, Boosting().fit(x, np.concatenate(holds).astype(float)))


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """df without its html and with text and n_chars (code points)."""
    spark = worker_path(df.sparkSession)
    shared = spark.sparkContext.broadcast(extractor())  # a few hundred kilobytes, whatever the input
    kept = [c for c in df.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(blocks):
        for block in tidied(blocks):
            texts = [t for htmls in text_slices(block.column(0), BATCH_BYTES) for t in shared.value.texts(htmls)]
            columns = [*block.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return df.select(html, *kept).mapInArrow(run, schema)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: What the whole method gives on the pages of the tables, whose main text is always one article element.
ORACLE_SQL = r"""
WITH inside AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS a FROM pages
), bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1)>|<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS a FROM inside
), decoded AS (
  SELECT page_id, url, replace(regexp_replace(replace(replace(replace(a, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', chr(1), 'g'), chr(1), '&') AS a FROM bare
), clean AS (SELECT page_id, url, trim(regexp_replace(a, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM clean
"""
