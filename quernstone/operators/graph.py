"""The entity graph: roll-ups of mentions, degrees, density, communities and their contexts.

Roll-ups are hash aggregates with partial sums; the order of first appearance is a number that mentions carry, so that
no group is ever sorted or collected. Communities come from local moves of modularity in rounds of joins, level by level.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import rules
from quernstone.functions.text import entity_name
from quernstone.operators.components import components
from quernstone.session import worker_path
from quernstone.storage import discard, stored

#: Rows of a range in which places are counted.
ID_RANGE = 1_000_000
#: Links of a task in which nodes move, at some 200 bytes each.
EDGES_PER_TASK = 1_500_000


def mentions(chunks: DataFrame, chunk: str = "id", seq: str = "seq", graph: str = "graph", per_chunk: int = rules.ENTITIES_PER_CHUNK, stop: Iterable[str] = tuple(rules.STOP_ENTITIES)) -> DataFrame:
    """(chunk, seq, name, description, norm): valid entities of each chunk's graph; faulty elements are skipped one by one."""
    rows = chunks.select(F.col(chunk).alias("chunk"), F.col(seq).alias("_s"), F.posexplode(F.slice(F.col(f"{graph}.entities"), 1, per_chunk)).alias("_i", "_e"))
    rows = rows.select("chunk", (F.col("_s") * per_chunk + F.col("_i")).alias("seq"), F.btrim("_e.name").alias("name"), F.coalesce(F.btrim("_e.description"), F.lit("")).alias("description"))
    return rows.where(F.length("name") >= 3).withColumn("norm", entity_name(F.col("name"))).where(~F.col("norm").isin(*stop))


def relations(chunks: DataFrame, chunk: str = "id", seq: str = "seq", graph: str = "graph", per_chunk: int = rules.RELATIONS_PER_CHUNK, allowed: Iterable[str] = tuple(rules.RELATIONS)) -> DataFrame:
    """(chunk, seq, source, target, relation): relations with two ends and a known kind; a missing kind is the default."""
    rows = chunks.select(F.col(chunk).alias("chunk"), F.col(seq).alias("_s"), F.posexplode(F.slice(F.col(f"{graph}.relationships"), 1, per_chunk)).alias("_i", "_r"))
    rows = rows.select("chunk", (F.col("_s") * per_chunk + F.col("_i")).alias("seq"), F.btrim("_r.source").alias("source"), F.btrim("_r.target").alias("target"), F.btrim(F.coalesce("_r.relation", F.lit(rules.DEFAULT_RELATION))).alias("relation"))
    return rows.where((F.col("source") != "") & (F.col("target") != "") & F.col("relation").isin(*allowed))


def _ranged(df: DataFrame, order: str) -> DataFrame:
    """df as a written table with _part: ranges of the order with about ID_RANGE rows each, whatever the key is like."""
    rows = stored(df)
    ranges = max(1, -(-rows.count() // ID_RANGE))
    return stored(rows.repartitionByRange(ranges, order).withColumn("_part", F.spark_partition_id()))


def _ahead(rows: DataFrame, value: Column) -> DataFrame:
    """(_part, _base): the value's sum over all ranges before; one row a range."""
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with n, its place from 1 in an order without ties, counted in ranges so that no task sees all rows."""
    rows = _ranged(df, order)
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return rows.withColumn("_local", local).join(F.broadcast(_ahead(rows, F.lit(1))), "_part").withColumn("n", F.col("_local") + F.col("_base")).drop("_part", "_local", "_base")


def entity_rollup(found: DataFrame) -> DataFrame:
    """(norm, name, description, freq, n_chunks, first): by normal name its mentions, its first name, its longest
    description (the first of equals) and in how many chunks it is; found: (chunk, seq, name, description, norm)."""
    longest = F.max_by("description", F.struct(F.length("description"), -F.col("seq")))
    once = found.groupBy("norm", "chunk").agg(
        F.count("*").alias("c"), F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"), longest.alias("description"), F.max(F.struct(F.length("description").alias("l"), (-F.col("seq")).alias("s"))).alias("key")
    )
    return once.groupBy("norm").agg(F.min_by("name", "seq").alias("name"), F.max_by("description", "key").alias("description"), F.sum("c").alias("freq"), F.count("*").alias("n_chunks"), F.min("seq").alias("first"))


def with_entity_ids(entities: DataFrame) -> DataFrame:
    """Entities with an id in the order of first appearance."""
    return numbered(entities, "first").withColumn("id", F.concat(F.lit("ent_"), F.when(F.length(F.col("n").cast("string")) < 4, F.lpad(F.col("n").cast("string"), 4, "0")).otherwise(F.col("n").cast("string")))).drop("n")


def edge_rollup(found: DataFrame) -> DataFrame:
    """(source, target, relation, weight, n_chunks, first); found: (chunk, seq, source, target, relation)."""
    once = found.groupBy("source", "target", "relation", "chunk").agg(F.count("*").alias("c"), F.min("seq").alias("seq"))
    return once.groupBy("source", "target", "relation").agg(F.sum("c").alias("weight"), F.count("*").alias("n_chunks"), F.min("seq").alias("first"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """(source, target, weight, label): relations of a pair together, named in the order of first appearance."""
    named = F.transform(F.sort_array(F.collect_list(F.struct("first", "relation"))), lambda x: x["relation"])  # one for each kind of relation
    return edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.array_join(named, ", ").alias("label"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: weights of both directions summed; self-loops go."""
    return edges.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("weight"))


def edge_types(edges: DataFrame) -> DataFrame:
    """(source_type, relation, target_type, n): edges by the kinds of their ends and their relation."""
    return edges.groupBy(node_type(F.col("source")).alias("source_type"), "relation", node_type(F.col("target")).alias("target_type")).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends at each node; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def density(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row (n_nodes, n_edges, density): edges over ordered pairs; 0 for fewer than two nodes."""
    all_nodes = degrees(edges).select("node")
    if nodes is not None:
        all_nodes = all_nodes.unionByName(nodes.select("node")).distinct()
    n, m = all_nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    share = F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(F.lit(0.0))
    return n.crossJoin(m).withColumn("density", F.round(share, 9))  # one row by one row


def running_totals(found: DataFrame) -> DataFrame:
    """(chunk, first, n, total): entities of each chunk and how many distinct ones there are up to it."""
    new = found.groupBy("norm").agg(F.min("seq").alias("seq")).join(found.select("norm", "seq", "chunk"), ["norm", "seq"]).groupBy("chunk").agg(F.count("*").alias("fresh"))
    rows = found.groupBy("chunk").agg(F.min("seq").alias("first"), F.count("*").alias("n")).join(new, "chunk", "left")
    part = _ranged(rows, "first")
    local = F.sum(F.coalesce("fresh", F.lit(0))).over(Window.partitionBy("_part").orderBy("first"))
    bases = F.broadcast(_ahead(part, F.coalesce("fresh", F.lit(0))))
    return part.withColumn("_l", local).join(bases, "_part").select("chunk", "first", "n", (F.col("_l") + F.col("_base")).alias("total"))


def node_type(name: Column, table: Iterable[tuple[str, tuple[str, ...]]] = tuple(rules.NODE_TYPES), default: str = "concept") -> Column:
    """The first kind one of whose words a name holds."""
    out = F.lit(default)
    for kind, words in reversed(list(table)):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(name), F.lit(w))
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def community_sizes(members: DataFrame) -> DataFrame:
    """(community, size); members: (node, community)."""
    return members.groupBy("community").agg(F.count("*").alias("size"))


def top_members(members: DataFrame, n: int = 12) -> DataFrame:
    """The n members of highest degree of each community, ties by name, with their place; (node, community, degree)."""
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node"))
    return members.withColumn("place", place).where(F.col("place") <= n)


def community_context(members: DataFrame, n: int = 12) -> DataFrame:
    """(community, context): a line "- name [type]: description" for each of the top members."""
    line = F.format_string("- %s [%s]: %s", "node", "type", F.coalesce(F.nullif("description", F.lit("")), F.lit("описание отсутствует")))
    rows = top_members(members, n).select("community", "place", line.alias("line"))
    return rows.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("context"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row (modularity) of a division of the nodes; edges: (a, b, weight), members: (node, community)."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    left = members.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    right = members.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    rows = both.join(left, "a").join(right, "b")
    per = rows.groupBy("ca").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inner"))
    whole = per.agg(F.sum("total").alias("m2"))
    return per.crossJoin(whole).agg(F.sum(F.col("inner") / F.col("m2") - (F.col("total") / F.col("m2")) ** 2).alias("modularity"))


def _settle(table: pa.Table, twice: float) -> pa.Table:
    """Moves of some nodes, one after the other by name and again until none gains; all other nodes stay as they are.

    table: (a, b, to, w, total, k): the links of a with the community of b and that community's weight; a row of a with
    itself has its own community and weight k.
    """
    size = table.num_rows
    names = pa.chunked_array([c for name in ("a", "b", "to") for c in table[name].chunks]).combine_chunks().dictionary_encode()
    rank = np.empty(len(names.dictionary), np.int64)
    rank[np.array(pc.array_sort_indices(names.dictionary))] = np.arange(len(rank))
    code = rank[names.indices.to_numpy()]  # places in the order of names
    node, other, to = code[:size], code[size : 2 * size], code[2 * size :]
    own = node == other
    community, total, k = np.zeros(len(rank), np.int64), [0] * len(rank), [0] * len(rank)
    community[other] = to
    weight, sums, mine = table["w"].to_pylist(), table["total"].to_pylist(), table["k"].to_pylist()
    for i in np.unique(to, return_index=True)[1].tolist():
        total[to[i]] = sums[i]
    for i in np.flatnonzero(own).tolist():
        k[node[i]] = mine[i]
    order = np.lexsort((other, node))
    order = order[~own[order]]
    locals_ = np.unique(node[own])
    begin = np.searchsorted(node[order], locals_).tolist()
    end = np.searchsorted(node[order], locals_, side="right").tolist()
    neighbour, weight = other[order].tolist(), [weight[i] for i in order.tolist()]
    del order, code
    community = community.tolist()
    nodes = list(zip(locals_.tolist(), begin, end, strict=True))
    slack = 0 if isinstance(twice, int) else 1e-12 * twice * twice  # gains of whole weights are whole
    active = True
    while active:
        active = False
        for n, lo, hi in nodes:
            near: dict[int, float] = {}
            for j in range(lo, hi):
                c = community[neighbour[j]]
                near[c] = near.get(c, 0) + weight[j]
            here, kn = community[n], k[n]
            best, gain = here, near.get(here, 0) * twice - kn * (total[here] - kn) + slack
            for c, w in near.items():
                if c != here:
                    g = w * twice - kn * total[c]
                    if g > gain or g == gain and best != here and c < best:
                        best, gain = c, g
            if best != here:
                total[here] -= kn
                total[best] += kn
                community[n] = best
                active = True
    name_at = np.empty(len(rank), np.int64)
    name_at[rank] = np.arange(len(rank))
    where = pa.array(name_at[locals_]), pa.array(name_at[np.array(community, np.int64)[locals_]])
    return pa.table({"node": names.dictionary.take(where[0]), "community": names.dictionary.take(where[1])})


def _square(edges: DataFrame, members: DataFrame, twice: float) -> tuple:
    """(a number that rises with modularity, weights whole for whole weights; communities)."""
    left = members.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    right = members.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    inner = edges.join(_met(left), "a").join(_met(right), "b").where("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    totals = members.groupBy("community").agg(F.sum("k").alias("t"))
    whole = dict(totals.dtypes)["t"] == "bigint"
    t = F.col("t").cast("decimal(19,0)") if whole else F.col("t")
    return inner * twice - (totals.agg(F.sum(t * t)).first()[0] or 0)


def _met(df: DataFrame) -> DataFrame:
    """df for a join by a shuffle: in rounds of joins every broadcast would pass the driver again."""
    return df.hint("merge")


def _rows(edges: DataFrame, members: DataFrame) -> DataFrame:
    """What _settle reads; edges and members may be those of some components alone."""
    totals = members.groupBy(F.col("community").alias("to")).agg(F.sum("k").alias("total"))
    near = edges.where("a <> b").join(_met(members.select(F.col("node").alias("b"), F.col("community").alias("to"))), "b").select("a", "b", "to", F.col("weight").alias("w"), F.lit(None).cast(members.schema["k"].dataType).alias("k"))
    own = members.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("community").alias("to"), F.lit(0).cast(near.schema["w"].dataType).alias("w"), "k")
    return near.unionByName(own).join(_met(totals), "to").select("a", "b", "to", "w", "total", "k")


def _settled(rows: DataFrame, members: DataFrame, twice: float) -> DataFrame:
    """(node, community, k, was) after each task has moved its nodes, as a written table."""
    schema = f"node {dict(members.dtypes)['node']}, community {dict(members.dtypes)['node']}"

    def run(table: pa.Table) -> pa.Table:
        return _settle(table.drop_columns(["task"]), twice)

    return stored(rows.groupBy("task").applyInArrow(run, schema).join(_met(members.select("node", "k", F.col("community").alias("was"))), "node"))


def _local_moves(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, community) from which no single node gains by a move to a neighbouring community.

    Moves in one component of the graph change no gain in another, so a component whose links fit a task settles there at
    once, with the result that one task for all would have. Nodes of larger components move in rounds, see _rounds.
    edges: (a, b, weight) in both directions.
    """
    worker_path(edges.sparkSession)
    edges = stored(edges.where("weight > 0"))
    degree = edges.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k"), F.count("*").alias("links"))
    nodes = stored(degree.withColumn("community", F.col("node")))
    members = nodes.select("node", "k", "community")
    whole = nodes.agg(F.sum("k").alias("twice"), F.sum("links").alias("links")).first()
    if not whole.twice:
        return members.select("node", "community")
    if whole.links <= edges_per_task:
        return _settled(_rows(edges, members).withColumn("task", F.lit(0)), members, whole.twice).select("node", "community")
    nodes = stored(nodes.join(_met(components(edges)), "node"))
    sizes = stored(nodes.groupBy("component").agg(F.sum("links").alias("links")))
    fits = F.col("links") <= edges_per_task
    fit = sizes.agg(F.sum(F.when(fits, F.col("links")))).first()[0] or 0
    parts = []
    if fit:
        # Small components share tasks, by a hash; others have a task of their own.
        shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(max(1, 2 * fit // edges_per_task))))
        deals = sizes.where(fits).select("component", F.when(F.col("links") * 8 > edges_per_task, F.concat(F.lit("c"), F.col("component"))).otherwise(shared).alias("task"))
        dealt = stored(nodes.join(deals, "component").select("node", "k", "community", "task"))
        inside = edges if fit == whole.links else edges.join(dealt.select(F.col("node").alias("a")), "a", "left_semi")
        mine = dealt.select("node", "k", "community")
        rows = _rows(inside, mine).join(_met(dealt.select(F.col("node").alias("a"), "task")), "a")
        # A number of partitions of its own: partitions that are joined for their size would settle one after the other.
        parts.append(_settled(rows.repartition(8 * fit // edges_per_task + 1, "task"), mine, whole.twice).select("node", "community"))
    if fit < whole.links:
        rest = stored(nodes.join(sizes.where(~fits), "component", "left_semi").select("node", "k", "community"))
        inside = edges if not fit else stored(edges.join(rest.select(F.col("node").alias("a")), "a", "left_semi"))
        parts.append(_rounds(inside, rest, whole.twice, edges_per_task))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _rounds(edges: DataFrame, members: DataFrame, twice: float, edges_per_task: int) -> DataFrame:
    """_local_moves of components that are larger than a task.

    In a round nodes are dealt to tasks by a hash, and each task moves its own nodes one after the other while all others
    stay where they are. Moves of several tasks can lose together; then only those of a share of the tasks are made, in
    the end those of one, which gain for sure. So modularity rises by every round that stays, and the rounds end by
    themselves, with the first in which no task moves a node.
    """
    tasks = max(1, -(-edges.count() // edges_per_task))
    step, best = 0, _square(edges, members, twice)
    while True:
        step += 1
        moved = _settled(_rows(edges, members).withColumn("task", F.pmod(F.xxhash64(F.lit(step), "a"), F.lit(tasks))), members, twice)
        if moved.where("community <> was").isEmpty():
            break
        share = 1
        while True:
            chosen = F.pmod(F.pmod(F.xxhash64(F.lit(step), "node"), F.lit(tasks)), F.lit(share)) == 0
            new = stored(moved.select("node", "k", F.when(chosen, F.col("community")).otherwise(F.col("was")).alias("community")))
            square = _square(edges, new, twice)
            if square > best or share >= tasks:
                break
            discard(new)
            share *= 2
        if square < best:  # one task's moves gain; only rounding of broken weights leads here
            break
        discard(members, moved)
        members, best = new, square
    return members.select("node", "community")


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) by modularity: local moves, then the same over the graph of communities, until no node and no
    community moves; deterministic.

    edges: (a, b, weight), undirected. Communities are named by one of their nodes.
    """
    level = stored(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    members = None
    while True:
        step = _local_moves(level)
        if members is None:
            members = step
        else:
            members = stored(members.join(_met(step.select(F.col("node").alias("community"), F.col("community").alias("_up"))), "community").select("node", F.col("_up").alias("community")))
        if step.where("node <> community").limit(1).count() == 0:
            break
        up = lambda end: step.select(F.col("node").alias(end), F.col("community").alias(f"_{end}"))  # noqa: B023, E731
        level = stored(level.join(_met(up("a")), "a").join(_met(up("b")), "b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("weight").alias("weight")))
    return members
