import math
import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import models
from quernstone.operators import lexical, ranking, vector
from quernstone.plans.engines import ENGINES


def okapi(corpus, query):
    n, avg = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = {t: sum(t in d for d in corpus) for d in corpus for t in d}
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if w < 0 else w for t, w in raw.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query) for d in corpus]


def test_bm25_against_the_formula(spark):
    rng = random.Random(1)
    corpus = [[rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 20))] for _ in range(30)]
    query = ["aa", "bb", "aa", "zz"]
    tokens = spark.createDataFrame(list(enumerate(corpus)), "id long, tokens array<string>")
    got = {r.id: r.score for r in lexical.bm25(tokens, spark.createDataFrame([(7, query)], "query_id long, tokens array<string>")).collect()}
    for i, s in enumerate(okapi(corpus, query)):
        assert got.get(i, 0) == pytest.approx(s, abs=1e-6)
    assert lexical.bm25_top(tokens, spark.createDataFrame([(1, [])], "query_id long, tokens array<string>")).count() == 0


def test_index_is_made_of_rows_alone(spark):
    tokens = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (1, ["a"])], "id long, tokens array<string>")
    index = lexical.index_of(tokens)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, index.collect())) == [(1, 1, ["a"], [1]), (1, 3, ["a", "b"], [1, 2]), (2, 0, [], [])]
    counts = {r.term: (r.df, r.n) for r in lexical.built(tokens).counts.collect()}
    assert counts == {r.term: (r.df, r.n) for r in lexical.counted(tokens).collect()} == {"": (3, 4), "a": (2, None), "b": (1, None)}


@pytest.mark.parametrize("size", [7, 8_192])
def test_cells_of_the_index_against_the_formula(spark, monkeypatch, size):
    monkeypatch.setattr(lexical, "CELL_DOCUMENTS", size)
    monkeypatch.setattr(lexical, "CELL_QUERIES", size)
    rng = random.Random(3)
    corpus = [(rng.randint(0, 60), [rng.choice("abcdefghij") for _ in range(rng.randint(0, 20))]) for _ in range(90)]  # ids repeat
    tokens = spark.createDataFrame([*corpus, (5, ["a", "b"]), (5, ["b", "c"]), (5, ["a", "b", "c"])], "id long, tokens array<string>")
    queries = spark.createDataFrame([(i, [rng.choice("abcdefghijz") for _ in range(4)]) for i in range(9)] + [(50, [])], "query_id long, tokens array<string>")
    top = lexical.indexed_top(lexical.built(tokens), queries, 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "HashAggregate" not in plan  # pairs of documents and queries are no rows
    want = sorted(map(tuple, lexical.bm25_top(tokens, queries, 5).select("query_id", "rank", "id", "score").collect()))
    assert sorted(map(tuple, top.select("query_id", "rank", "id", "score").collect())) == want and len(want) == 40
    assert lexical.indexed_top(lexical.built(tokens.limit(0)), queries, 5).count() == 0


def test_cosine_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "CELL_CANDIDATES", 40)
    monkeypatch.setattr(vector, "CELL_QUERIES", 7)
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(150)] + [(200, None), (201, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    queries = df.where("id < 20").select(F.col("id").alias("query_id"), "v")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in vector.cosine_top(df, queries, 5).collect())
    want = []
    length = lambda a: math.sqrt(sum(x * x for x in a))
    for q, a in rows[:20]:
        if any(a):
            scored = sorted((-round(sum(x * y for x, y in zip(a, b, strict=True)) / length(a) / length(b), 6), i) for i, b in rows if b and any(b))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert [w[:3] for w in sorted(want)] == [g[:3] for g in got]


def lists(spark, *rows):
    return spark.createDataFrame([(1, i, r) for i, r in rows], "query_id long, id long, rank int")


def test_fusion_is_symmetric_and_weighs(spark):
    a, b = lists(spark, (1, 1), (2, 2)), lists(spark, (2, 1), (3, 2))
    got = {r.id: r.score for r in ranking.fuse(a, b, 60, 1, 1).collect()}
    assert got == {1: round(1 / 61, 9), 2: round(1 / 62 + 1 / 61, 9), 3: round(1 / 62, 9)}
    only = lexical.ranked(ranking.fuse(a, b, 30, 1, 0), 2)
    assert [r.id for r in only.orderBy("rank").collect()] == [1, 2]


def test_boost_bounds(spark):
    fused = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "query_id long, id long, score double")
    tokens = spark.createDataFrame([(1, list("abcdef")), (2, ["z"])], "id long, tokens array<string>")
    queries = spark.createDataFrame([(1, list("abcdef"))], "query_id long, tokens array<string>")
    entities = spark.createDataFrame([(c, [c]) for c in "abcdefz"], "entity string, tokens array<string>")
    assert {r.id: r.score for r in ranking.boost(fused, tokens, queries, entities, "add").collect()} == {1: 0.508, 2: 0.5}
    assert {r.id: r.score for r in ranking.boost(fused, tokens, queries, entities, "multiply").collect()} == {1: 0.54, 2: 0.5}


def test_known_entities(spark):
    found = spark.createDataFrame([(" ФНС ",), ("ab",), ("Новая сущность",)], "entity string")
    got = {r.entity: r.tokens for r in ranking.known_entities(spark, found).collect()}
    assert len(got) == 10 and got["новая сущность"] == ["новая", "сущность"]


def test_sources(spark):
    final = spark.createDataFrame([(1, i, 0.123456 - i / 1e3, i + 1) for i in range(6)], "query_id long, id long, score double, rank int")
    pages = spark.createDataFrame([(0, "u", "Указ № 5. О службе. Да"), (1, "u", "x"), (2, "", "y"), (3, "v", "Иное. Вот"), (4, "w", None), (5, "q", "z")], "id long, url string, title string")
    got = [(r.place, r.url, r.title, r.score) for r in ranking.sources(final, pages).orderBy("place").collect()]
    assert got == [(1, "u", "О службе. Да", 0.1235), (2, "v", "Иное. Вот", 0.1205), (3, "w", "Источник", 0.1195)]


def test_engine_variants():
    assert len(ENGINES) == 9 and ENGINES["dated"].final_k == 3 and ENGINES["plain_dense"].fusion is None


def test_models(spark):
    vectors = models.hashing_embedder(64)(["alpha beta", "alpha beta", "", "gamma"])
    assert (vectors[0] == vectors[1]).all() and not vectors[2].any() and abs((vectors[3] ** 2).sum() - 1) < 1e-9
    df = spark.createDataFrame([("a b", "b c"), ("x", None)], "q string, t string")
    assert [r.s for r in df.select(models.reranker()("q", "t").alias("s")).collect()] == [pytest.approx(1 / 3), 0.0]
    assert len(df.select(models.embedder(query=True)("q").alias("v")).first().v) == 256
    chunks = ["One. Two.", "Three. Four.", "Five.", "Six.", "Seven."]
    assert models.synthesize("q", chunks, "tree") == "One. Seven."  # groups of four, then their answers
    assert models.synthesize("q", chunks, "simple") == "One." and models.synthesize("q", chunks, "compact") == "One. Three. Five. Six. Seven."
    assert models.synthesize("q", chunks[:2], "refine") == "One. Three."
    row = spark.createDataFrame([("Иван Петров встретил Мария тут",)], "t string").select(models.graph_of("t").alias("g")).first()
    assert [e.name for e in row.g.entities] == ["Иван Петров", "Мария"] and row.g.relationships[0].source == "Иван Петров"
