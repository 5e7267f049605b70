"""From texts to an index: cleaning, chunks, the entity graph, communities with summaries, and what is searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import models, text as T
from quernstone.operators import chunk, dedupe, graph, lexical
from quernstone.session import worker_path
from quernstone.storage import stored


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", version: int = 5, limit: int = 512) -> dict[str, DataFrame]:
    """Tables by name: chunks, entities, edges, communities, summaries, nodes (chunks and summaries) and postings.

    docs needs an integer key, by which first appearances are ordered.
    """
    worker_path(docs.sparkSession)
    pieces = chunk.legal_chunks(docs, key, text, version, limit)
    chunks = stored(chunk.chunk_ids(pieces, "chunk", key, "idx").withColumn("seq", F.col(key) * 1_000_000 + F.col("idx")))
    read = stored(chunks.select("id", "seq", models.graph_of("text").alias("graph")))
    entities = stored(graph.entity_rollup(graph.mentions(read)))
    edges = stored(graph.merged_edges(graph.edge_rollup(graph.relations(read))))
    members = graph.communities(graph.undirected(edges))
    described = entities.select(F.col("name").alias("node"), "description")
    members = stored(members.join(graph.degrees(edges), "node").join(dedupe.keep_first(described, ["node"], ["description"]), "node", "left").withColumn("type", graph.node_type(F.col("node"))))
    large = graph.community_sizes(members).where("size >= 2")
    context = graph.community_context(members.join(large, "community"))
    summaries = context.select(F.concat(F.lit("community_"), "community").alias("id"), T.scrub_summary(F.col("context")).alias("text"))
    nodes = dedupe.union_all(chunks.select("id", "text"), summaries)
    return {"chunks": chunks, "entities": entities, "edges": edges, "communities": members, "summaries": summaries, "nodes": nodes, "postings": lexical.postings(lexical.tokens_of(nodes, "id", "text"))}
