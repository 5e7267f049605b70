"""The ranking pipeline as one plan with a configuration for each engine variant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.stem import stem_tokens
from quernstone.functions.text import rewrite_synonyms, tokenize, tokenize_long
from quernstone.operators import lexical, ranking, vector
from quernstone.storage import stored


@dataclass(frozen=True)
class Engine:
    """prefixes: the embedding model's family; boost: add, multiply or none; modes: the router that picks a synthesis mode."""

    name: str
    prefixes: str = "search"
    vector_k: int = 30
    lexical_k: int = 30
    fusion: tuple[int, float, float] | None = (30, 0.45, 0.55)  # k, weight of vectors, weight of BM25
    boost: str | None = None
    rerank_k: int = 10
    final_k: int = 5
    long_tokens: bool = False
    stem: bool = False  # tokens of Russian words by their stem; costs a pass through Python
    score: Callable[[Column, Column], Column] = ranking.overlap  # of the asked tokens and a document's, as a reranker gives it
    rewrite: bool = False
    modes: str = "router"

    @property
    def tokenizer(self) -> Callable[[Column], Column]:
        cut = tokenize_long if self.long_tokens else tokenize
        return partial(cut, stem=stem_tokens) if self.stem else cut


ENGINES = {
    e.name: e
    for e in (
        Engine("canonical", boost="add", rewrite=True),
        Engine("chat", boost="multiply", rewrite=True),
        Engine("dated", fusion=(30, 0.4, 0.6), boost="multiply", final_k=3, rewrite=True, modes="router_dated"),
        Engine("store", fusion=(60, 1.0, 1.0), long_tokens=True, modes="simple"),
        Engine("passage_hybrid", prefixes="passage", fusion=(60, 1.0, 1.0), long_tokens=True, modes="compact"),
        Engine("search_hybrid", fusion=(60, 1.0, 1.0), long_tokens=True, modes="visual_simple"),
        Engine("light", fusion=(60, 1.0, 1.0), long_tokens=True, modes="visual_tree"),
        Engine("passage_dense", prefixes="passage", vector_k=10, fusion=None, modes="compact"),
        Engine("plain_dense", prefixes="none", vector_k=10, fusion=None, modes="compact"),
    )
}


def candidates(engine: Engine, docs: DataFrame, vectors: DataFrame, queries: DataFrame, index: lexical.Index | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, id, score) of what vectors and BM25 find, fused, as a written table.

    docs: key and text; vectors: (id, v); queries: (query_id, text, v); index: of docs, by the engine's tokenizer, which
    is built where it isn't there yet. Both searches see the rewritten question.
    """
    found = vector.cosine_top(vectors, queries.select("query_id", "v"), engine.vector_k)
    if not engine.fusion:
        return stored(found.drop("rank"))
    words = rewrite_synonyms(F.col("text")) if engine.rewrite else F.col("text")
    searched = queries.select("query_id", engine.tokenizer(words).alias("tokens"))
    index = index or lexical.built(lexical.tokens_of(docs, key, text, engine.tokenizer))
    return stored(ranking.fuse(found, lexical.indexed_top(index, searched, engine.lexical_k), *engine.fusion))


def pool(found: DataFrame, docs: DataFrame, tokenizer: Callable[[Column], Column], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tokens) of the documents found for any query, as a written table: later steps read no others."""
    ids = found.select(F.col("id").alias(key)).distinct()
    return stored(lexical.tokens_of(docs.join(ids, key, "left_semi"), key, text, tokenizer))


def retrieve(engine: Engine, docs: DataFrame, vectors: DataFrame, queries: DataFrame, entities: DataFrame | None = None, index: lexical.Index | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, id, score, rank): the final chunks of each query. Boost and reranker see the question as asked."""
    found = candidates(engine, docs, vectors, queries, index, key, text)
    tokens = pool(found, docs, engine.tokenizer, key, text)
    asked = queries.select("query_id", engine.tokenizer(F.col("text")).alias("tokens"))
    if engine.boost and entities is not None:
        found = stored(ranking.boost(found, tokens, asked, stored(entities), engine.boost))
    return ranking.rerank(found, asked, tokens, engine.rerank_k, engine.final_k, engine.score)
