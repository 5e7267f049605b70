import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_decontaminate import slow as slow_leaks
from test_decontaminate import words
from test_simhash_dedup import slow_components, slow_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from quernstone.llm import packing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def slow_lines(docs):
    totals, pages = Counter(d["source"] for d in docs), defaultdict(set)
    for i, d in enumerate(docs):
        for line in (d["text"] or "").split("\n"):
            if key := line.strip(" \t\r"):
                pages[d["source"], key].add(i)
    bad = {k for k, v in pages.items() if len(v) >= 5 and len(v) > 0.1 * totals[k[0]]}
    out = []
    for d in docs:
        text = d["text"] if d["text"] is None else "\n".join(x for x in d["text"].split("\n") if (d["source"], x.strip(" \t\r")) not in bad)
        out.append(d | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def as_rows(docs):
    return sorted((tuple(d[c] for c in COLUMNS) for d in docs), key=str)


def test_every_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]

    def step(name, given):
        frame = stages[name](spark, given, sf)
        frame.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    frame = step("toxicity", docs)
    want = [d for d in rows if model.scores([d["text"] or ""])[0] < 0.7]
    assert frame.columns == COLUMNS and rows_of(frame) == as_rows(want) and len(want) < len(rows)
    frame, want = step("line dedup", frame), slow_lines(want)
    assert frame.columns == COLUMNS and rows_of(frame) == as_rows(want)
    frame = step("SimHash near-dedup", frame)
    near = slow_components({d["doc_id"]: slow_fingerprint(d["text"]) for d in want})
    want = [d for d in want if near[d["doc_id"]] == d["doc_id"]]
    assert frame.columns == COLUMNS and rows_of(frame) == as_rows(want)
    frame = step("benchmark decontamination", frame)
    grams = {i: {tuple(w[a : a + 5]) for w in [words(t)] for a in range(len(w) - 4)} for i, t in items}
    leaks = set()
    for d in want:
        w = words(d["text"])
        own = {tuple(w[a : a + 5]) for a in range(len(w) - 4)}
        leaks |= {k for k, _ in slow_leaks([(d["doc_id"], d["text"])], [(i, t) for i, t in items if own & grams[i]])}
    kept = {r.doc_id for r in frame.select("doc_id").collect()}
    assert all(len(words(t)) >= 5 for _, t in items) and leaks
    assert frame.columns == COLUMNS and kept == {d["doc_id"] for d in want} - leaks
    tokens = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    pieces = defaultdict(list)
    for r in step("packing", frame).collect():
        pieces[r.doc_id].append(r)
    assert pieces.keys() == kept
    for d in rows:
        if d["doc_id"] in kept:
            ids = [*tokens.encode(next(w["text"] for w in want if w["doc_id"] == d["doc_id"]) or "", add_special_tokens=False).ids, 1]
            mine = sorted(pieces[d["doc_id"]], key=lambda r: r.start)
            assert [r.ids_crc32 for r in mine] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine]
            assert sum(r.length for r in mine) == len(ids)


@pytest.fixture
def odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id " * 9, "en", "a", 54), (3, "same text of some words here", "en", "a", 5), (3, "same text of some words here", "en", "a", 5), (4, "same text of some words here", "fr", "b", 5), (5, "long word " * 30_000, "en", "b", 1)]

    def write(docs, name):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        return f"{tmp_path}/{name}"

    return write(rows, "odd"), write([], "none")


def test_odd_and_empty_tables(spark, odd_tables):
    odd, none = odd_tables
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, odd).where("start = 0").collect())
    assert got == Counter([1, None, 3, 5])
    assert corpus_pipeline.run(spark, none).count() == 0
