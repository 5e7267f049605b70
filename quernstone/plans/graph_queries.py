"""Queries of the entity graph. Line items stand for mentions: an order is a chunk, a part's type an entity, and a part
and its supplier are the ends of a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import entity_name
from quernstone.operators import graph
from quernstone.operators.dedupe import union_all
from quernstone.plans.corpus_build import build
from quernstone.plans.registry import query
from quernstone.session import table

SEQ = "l_orderkey * 10 + l_linenumber"
SQL_MENTIONS = f"m AS (SELECT l_orderkey AS chunk, CAST({SEQ} AS BIGINT) AS seq, p_type AS name, p_name AS description, lower(p_type) AS norm FROM lineitem JOIN part ON p_partkey = l_partkey)"
SQL_EDGES = f"""f AS (SELECT l_orderkey AS chunk, CAST({SEQ} AS BIGINT) AS seq, 'p' || l_partkey AS source, 's' || l_suppkey AS target, l_returnflag AS relation FROM lineitem
), e AS (SELECT source, target, relation, count(*) AS weight, count(DISTINCT chunk) AS n_chunks, min(seq) AS first FROM f GROUP BY ALL
), g AS (SELECT source, target, CAST(sum(weight) AS BIGINT) AS weight, string_agg(relation, ', ' ORDER BY first) AS label FROM e GROUP BY ALL
), d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM g UNION ALL SELECT target FROM g) GROUP BY node)"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(SEQ).cast("long").alias("seq"), "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name")
    return lines.join(parts, "l_partkey").select(F.col("l_orderkey").alias("chunk"), "seq", F.col("p_type").alias("name"), F.col("p_name").alias("description"), entity_name(F.col("p_type")).alias("norm"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chunk"), F.expr(SEQ).cast("long").alias("seq"), F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.col("l_returnflag").alias("relation")
    )


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merged_edges(graph.edge_rollup(_relations(spark, sf_dir)))


@query(
    f"""WITH {SQL_MENTIONS}, e AS (
  SELECT norm, arg_min(name, seq) AS name, arg_max(description, (length(description), -seq)) AS description, count(*) AS freq, count(DISTINCT chunk) AS n_chunks, min(seq) AS first FROM m GROUP BY norm)
SELECT 'ent_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS id, norm, name, description, freq, n_chunks, first FROM (SELECT *, row_number() OVER (ORDER BY first) AS n FROM e)"""
)
def entity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_entity_ids(graph.entity_rollup(_mentions(spark, sf_dir)))


@query(
    f"""WITH {SQL_MENTIONS}, o AS (SELECT norm, min(seq) AS seq FROM m GROUP BY norm), fresh AS (SELECT chunk, count(*) AS fresh FROM m JOIN o USING (norm, seq) GROUP BY chunk
), r AS (SELECT chunk, min(seq) AS first, count(*) AS n FROM m GROUP BY chunk)
SELECT chunk, first, n, CAST(sum(coalesce(fresh, 0)) OVER (ORDER BY first) AS BIGINT) AS total FROM r LEFT JOIN fresh USING (chunk)"""
)
def entity_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.running_totals(_mentions(spark, sf_dir))


@query(f"WITH {SQL_EDGES} SELECT source, target, relation, weight, n_chunks, first FROM e")
def edge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_rollup(_relations(spark, sf_dir))


@query(f"WITH {SQL_EDGES} SELECT source, target, weight, label FROM g")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query(f"WITH {SQL_EDGES} SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 10")
def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_merged(spark, sf_dir)).orderBy(F.desc("degree"), "node").limit(10)


@query(f"WITH {SQL_EDGES}, n AS (SELECT count(*) AS n FROM d), m AS (SELECT count(*) AS m FROM g) SELECT n AS n_nodes, m AS n_edges, round(m / (n * (n - 1)), 9) AS density FROM n, m")
def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.density(_merged(spark, sf_dir))


SQL_MEMBERS = f"{SQL_EDGES}, mem AS (SELECT node, n_name AS community, degree, s_name AS description FROM d JOIN supplier ON node = 's' || s_suppkey JOIN nation ON n_nationkey = s_nationkey)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nodes, their nations as given communities."""
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    named = suppliers.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("n_name").alias("community"), F.col("s_name").alias("description"))
    return graph.degrees(_merged(spark, sf_dir)).join(named, "node").withColumn("type", graph.node_type(F.col("description")))


@query(f"WITH {SQL_MEMBERS} SELECT community, count(*) AS size FROM mem GROUP BY community")
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_sizes(_members(spark, sf_dir))


@query(
    f"""WITH {SQL_MEMBERS}, t AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS place FROM mem)
SELECT community, string_agg('- ' || node || ' [concept]: ' || description, chr(10) ORDER BY place) AS context FROM t WHERE place <= 12 GROUP BY community"""
)
def community_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_context(_members(spark, sf_dir))


@query(
    """SELECT n_name AS community, c_name AS node, CAST(round(c_acctbal * 100) AS BIGINT) AS degree, CAST(place AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY CAST(round(c_acctbal * 100) AS BIGINT) DESC, c_name) AS place FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE place <= 12"""
)
def top_members_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select(F.col("n_name").alias("community"), F.col("c_name").alias("node"), F.round(F.col("c_acctbal") * 100).cast("long").alias("degree"))
    return graph.top_members(rows)


@query(
    f"""WITH {SQL_EDGES}, mem AS (SELECT source AS node, 'c' || CAST(substr(source, 2) AS BIGINT) % 5 AS c FROM g UNION SELECT target, 'c' || CAST(substr(target, 2) AS BIGINT) % 5 FROM g
), b AS (SELECT source AS a, target AS b, weight FROM g UNION ALL SELECT target, source, weight FROM g
), p AS (SELECT x.c, sum(weight) AS total, sum(CASE WHEN x.c = y.c THEN weight ELSE 0 END) AS inner_ FROM b JOIN mem x ON x.node = b.a JOIN mem y ON y.node = b.b GROUP BY x.c)
SELECT round(sum(inner_ / m2 - (total / m2) ** 2), 9) AS modularity FROM p, (SELECT sum(total) AS m2 FROM p)"""
)
def partition_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modularity of a given division: nodes by their number modulo five."""
    edges = graph.undirected(_merged(spark, sf_dir))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    members = nodes.withColumn("community", F.concat(F.lit("c"), F.substring("node", 2, 20).cast("long") % 5))
    return graph.modularity(edges, members).select(F.round("modularity", 9).alias("modularity"))


@query()
def communities_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of all parts and suppliers by the line items they share, found by local moves (an iteration, beyond SQL)."""
    return graph.communities(graph.undirected(_merged(spark, sf_dir)))


@query()
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline build over all documents, as the number of rows of each of its tables."""
    tables = build(table(spark, sf_dir, "documents"))
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, t in tables.items()]
    return union_all(*counts)
