import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash

from quernstone.llm import simhash_dedup as S
from quernstone.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_against_brute_force(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    prints = {d: slow_fingerprint(t) for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    got = {r.doc_id: r for r in S.op9_simhash_dedup(spark, sf).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {k: r.component_id for k, r in got.items()} == slow_components(prints)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(5, None, 1), (3, "", 1), (9, " \n\t", 1), (7, "a b", 1), (8, "A  b", 1), (7, "a b", 1), (None, "x", 1), (1, long, 1), (2, long, 1), (4, "É b c d e", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 3), (7, 7), (7, 7), (8, 7), (9, 3)]
    assert S.near_duplicates(df.limit(0)).count() == 0
    assert S.fingerprint("É b") == slow_fingerprint("É b")


@pytest.mark.parametrize("tile_rows", [8, 1 << 18])
def test_links_are_whole_for_any_tiling(spark, tile_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = {}
    for b in base.tolist():
        for _ in range(4):
            for bit in rng.choice(64, 2, replace=False).tolist():
                b ^= 1 << bit
            prints[len(prints) + 1] = b
    signed = [(int(np.uint64(v).astype(np.int64)), k) for k, v in prints.items()]
    edges = S.link_fingerprints(spark.createDataFrame(signed, "fp long, rep long"), tile_rows=tile_rows)
    found = {r.node: r.component for r in components(edges).collect()}
    assert {k: found.get(k, k) for k in prints} == slow_components(prints)


def test_close_pairs_with_many_sub_tiles():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = np.append(a[:500] ^ np.uint64(0b1111 << 58), rng.integers(0, 2**64, 2000, dtype=np.uint64))
    got = {(int(i), int(j)) for x, y in S.close_pairs(a, b, 4) for i, j in zip(x, y, strict=True)}
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 4)
    assert got == set(zip(i.tolist(), j.tolist(), strict=True)) and len(got) >= 500


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(1, 1), (None, 5), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in [7, *range(20, 60)]}, 1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("max_broadcast", [0, 100])
def test_one_of_each_group_stays(spark, max_broadcast):
    rows = [(5, "a b c", "x"), (3, "a b c", "y"), (3, "a b c", "y"), (None, "a b c", "z"), (9, "other words", "q"), (8, None, "r"), (7, "", "s"), (7, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(tuple, S.drop_near_duplicates(df, max_broadcast=max_broadcast).collect()), key=str)
    assert [r[0] for r in got] == [3, 7, 9, None] and S.drop_near_duplicates(df, max_broadcast=max_broadcast).columns == df.columns


@pytest.mark.parametrize("segments", [1, 2, 3, 5])
def test_tiles_within_the_radius_meet(segments):
    rng = np.random.default_rng(segments)
    a = rng.integers(0, 2**64, 300, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    deal = S._deal(4, segments)
    tiles = lambda x: {k: {*zip(g["t1"], g["t2"], strict=True)} for k, g in pd.concat(deal([pd.DataFrame({"fp": x.view(np.int64), "rep": np.arange(len(x))})])).groupby("rep")}
    left, right = tiles(a), tiles(b)
    assert all(left[k] & right[k] for k in left)
    assert all(len(v) <= len(S._steps(segments, 4)) for v in left.values())


def test_tiles_grow_with_the_set():
    assert [S.segments_of(n, 1 << 19) for n in (0, 10**6, 10**8, 10**9)] == [1, 1, 3, 5]
    assert [len(S._steps(k, 4)) for k in (1, 2, 3, 4)] == [9, 41, 129, 321]


def test_unlike_texts_of_one_id_stay_apart(spark):
    t, u = "one text of some words here", "something else entirely with other words"
    df = spark.createDataFrame([(1, t), (3, t), (3, u), (5, u)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect())
    assert got == [(1, 1), (3, 1), (3, 3), (5, 3)]
    assert sorted(map(tuple, S.drop_near_duplicates(df).collect())) == [(1, t), (3, u)]


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_fingerprints(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_ROWS", hot)
    df = spark.createDataFrame([(i, "a b c" if i % 3 else f"other {i}") for i in range(30)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()}
    assert got == {i: 1 if i % 3 else i for i in range(30)}


def test_query_keeps_rows_without_an_id(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (None, "x"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, S.op9_simhash_dedup(spark, str(tmp_path)).collect()), key=str)
    one = f"{slow_fingerprint('x'):016x}"
    assert got == sorted([(1, one, 1), (None, one, None), (None, "0" * 16, None)], key=str)


def counted(monkeypatch):
    """The sizes of all arrays whose bits are counted from now on."""
    sizes, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: sizes.append(np.size(x)) or count(x))
    return sizes


def forest_of(prints):
    """The smallest position of each position's tree, by the links inside one tile."""
    x = np.array(prints, np.uint64)
    rep = np.arange(len(x))
    links = S._forest(4)(pd.DataFrame({"t1": 0, "t2": 0, "first": True, "fp": x.view(np.int64), "rep": rep}))
    got = rep.copy()
    got[links["a"]] = links["b"]
    return dict(enumerate(got.tolist()))


def test_comparisons_follow_the_rows_of_a_tile(monkeypatch):
    n = 40_000
    a = np.random.default_rng(5).integers(0, 2**64, n, dtype=np.uint64)
    b = a ^ np.uint64(0b1011 << 30)
    sizes = counted(monkeypatch)
    got = {(i, j) for x, y in S.close_pairs(a, b, 4) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert {(i, i) for i in range(n)} <= got and sum(sizes) < 100 * n


def test_a_dense_group_is_compared_until_it_is_linked(monkeypatch):
    masks = [(1 << i) | (1 << j) for i in range(64) for j in range(i + 1)]  # 2,080 within two bits of one fingerprint
    prints = [0x0123456789ABCDEF ^ m for m in masks]
    monkeypatch.setattr(S, "BLOCK", 1 << 14)
    sizes = counted(monkeypatch)
    assert set(forest_of(prints).values()) == {0} and sum(sizes) < len(prints) ** 2


@pytest.mark.parametrize("block", [16, 256, 1 << 20])
def test_large_sub_tiles_are_whole(monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(block)
    few = rng.integers(0, 2**64, 3, dtype=np.uint64)
    wide = few[rng.integers(0, 3, 500)] ^ (rng.integers(0, 2**20, 500, dtype=np.uint64) << np.uint64(22))  # equal in 44 places
    a = np.unique(np.append(wide, rng.integers(0, 2**64, 100, dtype=np.uint64)))
    b = a[::2] ^ (np.uint64(1) << rng.integers(0, 64, len(a[::2])).astype(np.uint64))
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 4)
    got = {p for x, y in S.close_pairs(a, b, 4) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == set(zip(i.tolist(), j.tolist(), strict=True)) and len(got) > len(b)
    both = np.unique(np.append(a, b)).tolist()
    assert forest_of(both) == slow_components(dict(enumerate(both)))


def test_a_tile_pair_of_the_dedup_stage_compares_few_of_its_pairs(monkeypatch):
    n = 30_000
    rng = np.random.default_rng(11)
    a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    fp = np.append(a, a ^ np.uint64(0b11 << 40))
    first = np.arange(len(fp)) < len(a)
    sizes = counted(monkeypatch)
    got = S._forest(4)(pd.DataFrame({"t1": 3, "t2": 5, "first": first, "fp": fp.view(np.int64), "rep": np.arange(len(fp))}))
    assert {*zip(got["b"], got["a"], strict=True)} == {(i, i + len(a)) for i in range(len(a))}
    assert sum(sizes) < len(a) ** 2 // 100
