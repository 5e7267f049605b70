import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quernstone.llm import topk_search as K


def slow(ids, x, queries, k):
    out = []
    for q in queries:
        scored = sorted((-int(x[q] @ x[j]), ids[j]) for j in range(len(ids)) if ids[j] != ids[q])[:k]
        out += [(ids[q], r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_against_brute_force(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    x = np.floor(64 * np.array(t["embedding"], np.float64)).astype(np.int64)
    queries = [i for i, v in enumerate(t["vec_id"]) if v % 20 == 0]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.op5_topk_search(spark, sf).collect())
    assert got == slow(t["vec_id"], x, queries, 20)


@pytest.mark.parametrize("scale", [1, 10, 3_000_000_0])
def test_blocks_ties_and_large_values(scale):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (5000, 12)) * scale
    x[100:400] = x[7]
    ids = rng.permutation(5000)
    row, key, score = K.search_block(ids[:40], x[:40], ids, x, 5)
    got = sorted(zip(ids[row].tolist(), key.tolist(), score.tolist(), strict=True))
    assert got == sorted((q, i, s) for q, _, i, s in slow(ids.tolist(), x, range(40), 5))


def test_bounds_are_bounds():
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(30, 13)), rng.normal(size=(50, 13))
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    for s in (1, 2, 5, 13, 20):
        assert (K.distance_bound(K.segment_statistics(q, s), K.segment_statistics(x, s)) <= d + 1e-9).all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 2), (2, None, 3), (3, [nan, 1.0], 4), (4, [inf, 1.0], 5), (5, [None, 1.0], 6), (7, [1.0, 1.0], 7), (7, [1.0, 1.0], 7), (20, [0.0, 1.0], 8), (None, [1.0, 1.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, K.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect()))
    assert got == [(0, 1, 1, 4096), (0, 2, 7, 4096), (0, 3, 7, 4096), (20, 1, 1, 4096), (20, 2, 7, 4096), (20, 3, 7, 4096)]
    assert K.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size", [4096, 7])
def test_repeated_query_rows_and_vectors(spark, monkeypatch, size):
    monkeypatch.setattr(K, "TASK_QUERIES", size)
    monkeypatch.setattr(K, "TASK_CANDIDATES", 3 * size)
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-9, 10, 6).tolist()) for i in range(100)]
    rows += [rows[i] for i in range(0, 100, 5) for _ in range(3)]  # queries and candidates as they are
    rows += [(i, rng.integers(-9, 10, 6).tolist()) for i in range(0, 100, 10)]  # another vector of the same key
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>").repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.top_k(df, F.col("vec_id") % 5 == 0, k=20, scale=1).collect())
    want = []
    for q in range(0, 100, 5):
        vectors = [np.array(v) for i, v in rows if i == q]
        scored = sorted((-max(int(v @ np.array(x)) for v in vectors), i) for i, x in rows if i != q)[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == want
