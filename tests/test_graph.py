import random
from collections import Counter

import numpy as np
import pytest

from quernstone.operators import graph as G

CHUNKS = "id string, seq long, graph struct<entities: array<struct<name: string, description: string>>, relationships: array<struct<source: string, target: string, relation: string>>>"


def test_mentions_and_rollups(spark):
    rows = [
        ("c1", 0, ([("«ФНС России»", "a"), ("ab", "x"), (None, "y"), ("Порядок", "z"), ("Отпуск", None)], [("ФНС", "Отпуск", "регулирует"), ("ФНС", "Отпуск", None), ("", "x", "регулирует"), ("a", "b", "иное")])),
        ("c2", 1, ([("фнс", "longer"), ("ФНС", "equals")], [("ФНС", "Отпуск", "регулирует")])),
        ("c3", 2, None),
    ]
    chunks = spark.createDataFrame(rows, CHUNKS)
    got = {r.norm: (r.id, r.name, r.description, r.freq, r.n_chunks) for r in G.with_entity_ids(G.entity_rollup(G.mentions(chunks))).collect()}
    assert got == {"фнс": ("ent_0001", "«ФНС России»", "longer", 3, 2), "отпуск": ("ent_0002", "Отпуск", "", 1, 1)}
    edges = G.edge_rollup(G.relations(chunks))
    assert {(r.source, r.target, r.relation): (r.weight, r.n_chunks) for r in edges.collect()} == {("ФНС", "Отпуск", "регулирует"): (2, 2), ("ФНС", "Отпуск", "связан с"): (1, 1)}
    assert [(r.weight, r.label) for r in G.merged_edges(edges).collect()] == [(3, "регулирует, связан с")]
    assert {r.chunk: (r.n, r.total) for r in G.running_totals(G.mentions(chunks)).collect()} == {"c1": (2, 2), "c2": (2, 2)}


def test_numbering_over_ranges(spark):
    values = random.Random(4).sample(range(0, 9 * G.ID_RANGE), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert {r.v: r.n for r in G.numbered(df, "v").collect()} == {v: i + 1 for i, v in enumerate(sorted(values))}


def test_degrees_and_density(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "source string, target string")
    assert {r.node: r.degree for r in G.degrees(edges).collect()} == {"a": 2, "b": 2, "c": 2}
    nodes = spark.createDataFrame([("d",)], "node string")
    assert tuple(G.density(edges, nodes).first()) == (4, 3, 0.25)
    assert tuple(G.density(edges.limit(0)).first()) == (0, 0, 0.0)


def test_communities_of_planted_groups(spark):
    rng = random.Random(7)
    group = {f"n{i:02d}": i % 4 for i in range(48)}
    names = sorted(group)
    edges = [(a, b, 1) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < (0.6 if group[a] == group[b] else 0.03)]
    df = spark.createDataFrame(edges, "a string, b string, weight long")
    members = G.communities(df)
    planted = spark.createDataFrame(list(group.items()), "node string, community string")
    found, best = G.modularity(df, members).first().modularity, G.modularity(df, planted).first().modularity
    assert found >= best - 0.03
    assert {(r.node, r.community) for r in G.communities(df).collect()} == {(r.node, r.community) for r in members.collect()}


def test_modularity_by_hand(spark):
    df = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "a string, b string, weight long")
    halves = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")], "node string, community string")
    assert G.modularity(df, halves).first().modularity == pytest.approx(2 / 3 - 0.5)


def test_context(spark):
    members = spark.createDataFrame([("x", "1", 5, "law", "about"), ("y", "1", 7, "concept", ""), ("z", "1", 5, "concept", None)], "node string, community string, degree long, type string, description string")
    assert G.community_context(members, 2).first().context == "- y [concept]: описание отсутствует\n- x [law]: about"


def test_communities_end_where_no_node_gains(spark):
    rng = random.Random(11)
    names = [f"n{i:03d}" for i in range(240)]
    edges = {tuple(sorted(rng.sample(names, 2))): rng.randint(1, 3) for _ in range(900)}
    found = {r.node: r.community for r in G.communities(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a string, b string, weight long")).collect()}
    # The last level, whose nodes are the communities: no two of them gain by becoming one.
    total, between, m2 = {}, {}, 2 * sum(edges.values())
    for (a, b), w in edges.items():
        for x, y in ((a, b), (b, a)):
            total[found[x]] = total.get(found[x], 0) + w
            between[found[x], found[y]] = between.get((found[x], found[y]), 0) + w
    assert all(w * m2 <= total[c] * total[d] for (c, d), w in between.items() if c != d)
    assert set(found) == {x for e in edges for x in e}


def test_local_moves_end_where_no_node_gains(spark):
    n, edges = 400, []
    edges = [(f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(n - 1)]  # a chain, along which moves need many rounds
    both = spark.createDataFrame([*edges, *((b, a, w) for a, b, w in edges)], "a string, b string, weight long")
    found = {r.node: r.community for r in G._local_moves(both).collect()}
    k, near, total = {}, {}, {}
    for a, b, w in [*edges, *((b, a, w) for a, b, w in edges)]:
        k[a] = k.get(a, 0) + w
        near.setdefault(a, {}).setdefault(found[b], 0)
        near[a][found[b]] += w
    for x, d in k.items():
        total[found[x]] = total.get(found[x], 0) + d
    gain = lambda x, c: near[x].get(c, 0) * 2 * len(edges) - k[x] * (total[c] - (k[x] if c == found[x] else 0))
    assert all(gain(x, c) <= gain(x, found[x]) for x in k for c in near[x])


def test_communities_query_has_every_part(spark, sf):
    from quernstone.plans.graph_queries import communities_modularity

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    nodes = {f"p{r[0]}" for r in lines.select("l_partkey").distinct().collect()} | {f"s{r[0]}" for r in lines.select("l_suppkey").distinct().collect()}
    assert {r.node for r in communities_modularity(spark, f"{sf}").collect()} == nodes


@pytest.mark.parametrize("per_task", [40, 10_000])
def test_no_node_gains_whatever_the_tasks(spark, per_task):
    rng = np.random.default_rng(1)
    pairs = {tuple(sorted(rng.choice(30, 2, replace=False).tolist())) for _ in range(120)}
    edges = [(f"n{a}", f"n{b}", int(rng.integers(1, 5))) for a, b in pairs]
    both = edges + [(b, a, w) for a, b, w in edges]
    found = {r.node: r.community for r in G._local_moves(spark.createDataFrame(both, "a string, b string, weight long"), per_task).collect()}
    k, twice = Counter(), sum(w for *_, w in both)
    for a, _, w in both:
        k[a] += w
    for n in k:
        near, total = Counter(), Counter()
        for a, b, w in both:
            near[found[b]] += w * (a == n)
        for m in k:
            total[found[m]] += k[m] * (m != n)
        gain = lambda c: near[c] * twice - k[n] * total[c]  # noqa: B023, E731
        assert all(gain(c) <= gain(found[n]) for c in near if near[c])


def test_components_settle_on_their_own(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = {(30 * c + int(a), 30 * c + int(b)) for c in range(6) for a, b in (sorted(rng.choice(30, 2, replace=False)) for _ in range(90))}
    edges = [(f"n{a:03d}", f"n{b:03d}", int(rng.integers(1, 5))) for a, b in pairs]
    df = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "a string, b string, weight long")
    found = lambda per_task: {(r.node, r.community) for r in G._local_moves(df, per_task).collect()}
    whole = found(10_000)
    assert len({c for _, c in whole}) > 6

    def rounds(*_):
        raise AssertionError("a component that fits a task is moved in rounds")

    monkeypatch.setattr(G, "_rounds", rounds)
    assert found(200) == whole == found(900)


def test_rounds_broadcast_no_table(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "a string, b string, weight long")
    members = spark.createDataFrame([("a", "a", 1), ("b", "b", 1)], "node string, community string, k long")
    assert "BroadcastHashJoin" not in G._rows(edges, members)._jdf.queryExecution().sparkPlan().toString()
