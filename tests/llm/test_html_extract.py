import html
import random
import re

import numpy as np
import pyarrow.parquet as pq

from quernstone.llm import dom
from quernstone.llm import html_extract as H
from quernstone.llm.boosting import Boosting

LINE = "The quick brown fox rests near the river bank, and then it walks home before the rain."


def slow(page):
    found = re.search(r"<article>(.*?)</article>", page or "", re.DOTALL)
    text = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>|<br>", " ", found[1])) if found else ""
    return " ".join(html.unescape(text).split())


def test_whole_table(spark, sf):
    pages = pq.read_table(f"{sf}/pages.parquet").to_pydict()
    got = {r.page_id: r for r in H.op8_html_extract(spark, sf).collect()}
    for i, u, h in zip(pages["page_id"], pages["url"], pages["html"], strict=True):
        assert (got[i].url, got[i].text, got[i].n_chars) == (u, slow(h), len(slow(h)))


def test_other_layouts():
    ex = H.extractor()
    pages = {
        f"<body><header><h1>My Site</h1><p>Best.</p></header><nav><a href=/>Home</a></nav><aside class=sidebar><h3>Recent</h3><p>{LINE}</p></aside><main><article><h1>A</h1><p>{LINE}</p><ul><li>one</li><li>two</li></ul><div class='ad'>{LINE}</div><p>x&nbsp;Tail&hellip;</p></article><section class='comments'><h2>Comments</h2><div class=comment><p>{LINE}</p></div></section></main><footer><p>{LINE}</p></footer>": f"A {LINE} one two x Tail…",
        f"<body><div class='cookie-notice'>{LINE}</div><div class=menu><ul><li><a href=x>A</a><li><a href=y>B</a></ul></div><div class=content><h2>B</h2><p>{LINE}<p>{LINE}<br>more</div><div class=sidebar>{LINE}</div><div class=footer>{LINE}</div>": f"B {LINE} {LINE} more",
        f"<article><h1>T</h1><p>{LINE}</p><form><p>{LINE}</p><input></form><p>End.</p></article><div id=comments><article class=comment><p>{LINE}</p></article></div>": f"T {LINE} End.",
        f"<h1>T</h1><p>{LINE}</p>": f"T {LINE}",
        "<article><p>a<b>b</b>c <span class=ad>buy</span>d<i>e</i> f&amp;g &lt;x&gt; &amp;quot; &am</p></article>": "abc de f&g <x> &quot; &am",
        "<article>x<script>if(a<b)y('</p>')</script><style>p{}</style><!-- <p>no</p> --> 1 < 2</article><footer>z": "x 1 < 2",
        "<nav><a>x</a></nav><article></article><footer>b</footer>": "",
        "": "",
    }
    for page, text in pages.items():
        assert ex.texts([page]) == [text], page
    assert ex.texts(list(pages)) == list(pages.values())


def test_unseen_made_pages():
    ex, right, leaves = H.extractor(), 0, 0
    for page, held in H.training_pages(120, seed=77):
        parsed = dom.parse(page)
        leaf = np.array([bool(t) for t in parsed.text])
        right += ((ex.keep([parsed])[0] == np.array(held)) & leaf).sum()
        leaves += leaf.sum()
    assert right >= 0.98 * leaves


def test_decoding_is_the_best_consistent_labelling():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 9)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        depth = [0]
        for p in parent[1:]:
            depth.append(depth[p] + 1)
        raw = [rng.uniform(-2, 2) for _ in range(n)]
        best = max((sum(raw[i] for i in range(1, n) if m >> i & 1) for m in range(1, 1 << n, 2) if all(not m >> i & 1 or m >> parent[i] & 1 for i in range(1, n))), default=0)
        kept = H.decode(np.array(raw), np.array(parent), np.array(depth))
        assert kept[0] and all(not kept[i] or kept[parent[i]] for i in range(1, n))
        assert abs(sum(raw[i] for i in range(1, n) if kept[i]) - best) < 1e-9


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = Boosting(trees=30, depth=3).fit(x[:2000], y[:2000])
    assert ((model.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.97


def test_edge_cases(spark):
    deep = "<div>" * 20_000 + "<p>" + LINE
    rows = [(1, None, 5), (1, None, 5), (2, "", 6), (None, f"<article><p>{LINE}</p></article>", 7), (3, "<p>" + "word " * 200_000, 8), (4, deep, 9), (5, "<p title=\"never ends", 10), (6, "<<>></x></p>", 11)]
    df = spark.createDataFrame(rows, "page_id long, html string, n_chars long")
    out = H.extract(df)
    assert out.columns == ["page_id", "text", "n_chars"]
    got = {}
    for r in out.collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    assert got[1] == [("", 0)] * 2 and got[2] == got[5] == [("", 0)] and got[None] == [(LINE, len(LINE))]
    assert got[3] == [("word " * 199_999 + "word", 999_999)] and len(got) == 7
    assert H.extract(df.limit(0)).count() == 0


def test_shown_text_of_rare_elements_stays():
    ex = H.extractor()
    pages = {
        f"<article><p>Energy is <math>E = mc</math> and mass.</p><p>{LINE}</p></article>": f"Energy is E = mc and mass. {LINE}",
        f"<article><p>A <svg><title>t</title><text>label</text></svg> drawn.</p><p>{LINE}</p></article>": f"A label drawn. {LINE}",
        f"<article><p>{LINE}</p><p>Type <xmp><b>&amp;</b></xmp> here.</p></article>": f"{LINE} Type <b>&amp;</b> here.",
        f"<article><p>{LINE}</p><p>{LINE} <noscript>{LINE}</noscript></p></article>": f"{LINE} {LINE} {LINE}",
        f"<article><p>{LINE}</p><template><p>{LINE}</p></template><button>{LINE}</button></article>": LINE,
    }
    for page, text in pages.items():
        assert ex.texts([page]) == [text], page


def test_attributes_are_read_whole():
    assert dom.tokens_of(f' class="{"x " * 2000}sidebars"')[-1] == "sidebar"
