"""From ranked lists to a context: rank fusion, entity boost, reranking, the final choice and its sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import rules
from quernstone.functions.text import tokenize
from quernstone.operators.lexical import ranked

ENTITY_BONUS, MAX_BONUS, ADDED_SHARE = 0.02, 0.08, 0.1


def fuse(vector: DataFrame, lexical: DataFrame, k: int = 30, vector_weight: float = 0.45, lexical_weight: float = 0.55) -> DataFrame:
    """(query_id, id, score): the sum of weight / (k + rank) over both lists, whose ranks begin at 1."""
    part = lambda df, w, name: df.select("query_id", "id", (F.lit(float(w)) / (k + F.col("rank"))).alias(name))
    both = part(vector, vector_weight, "_v").join(part(lexical, lexical_weight, "_l"), ["query_id", "id"], "full")
    return both.select("query_id", "id", F.round(F.coalesce("_v", F.lit(0.0)) + F.coalesce("_l", F.lit(0.0)), 9).alias("score"))


def query_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity): entities that share a token with a query. queries: (query_id, tokens); entities: (entity, tokens)."""
    asked = queries.select("query_id", F.explode("tokens").alias("token"))
    known = entities.select("entity", F.explode("tokens").alias("token"))
    return asked.join(known, "token").select("query_id", "entity").distinct()


def known_entities(spark: SparkSession, extra: DataFrame | None = None, base: Iterable[str] = tuple(rules.BASE_ENTITIES)) -> DataFrame:
    """(entity, tokens) of the built-in entities and those found in a corpus, each once; names under three letters are noise."""
    names = spark.createDataFrame([(b,) for b in base], "entity string")
    if extra is not None:
        names = names.unionByName(extra.select(F.lower(F.btrim("entity")).alias("entity")).where(F.length("entity") >= 3))
    return names.distinct().withColumn("tokens", tokenize(F.col("entity")))


def boost(fused: DataFrame, tokens: DataFrame, queries: DataFrame, entities: DataFrame, how: str = "add") -> DataFrame:
    """Scores raised for each entity of the query that a document shares a token with, up to a bound.

    how: add a tenth of the bonus (canonical), or multiply by one plus the bonus.
    """
    wanted = query_entities(queries, entities).join(entities.select("entity", F.explode("tokens").alias("token")), "entity")
    # Documents' tokens that no question's entity has go before they meet the questions.
    telling = tokens.select("id", F.explode(F.array_distinct("tokens")).alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    held = fused.select("query_id", "id").join(telling, "id")
    count = held.join(wanted, ["query_id", "token"]).groupBy("query_id", "id").agg(F.count_distinct("entity").alias("n"))
    bonus = F.least(F.lit(ENTITY_BONUS) * F.coalesce("n", F.lit(0)), F.lit(MAX_BONUS))
    score = F.col("score") + bonus * ADDED_SHARE if how == "add" else F.col("score") * (1 + bonus)
    return fused.join(count, ["query_id", "id"], "left").select("query_id", "id", F.round(score, 9).alias("score"))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token lists, the offline stand-in of a cross-encoder."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, queries: DataFrame, tokens: DataFrame, window: int = 10, keep: int = 5, score: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """The window best candidates of each query, scored anew against the query as it was asked; the keep best of them."""
    head = ranked(candidates, window).select("query_id", "id")
    asked = queries.select("query_id", F.col("tokens").alias("asked"))
    scored = head.join(tokens, "id").join(asked, "query_id").select("query_id", "id", F.round(score(F.col("asked"), F.col("tokens")), 6).alias("score"))
    return ranked(scored, keep)


def context(final: DataFrame, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query_id, n_chunks, n_chars, ids): the size of what a model is to read for each query, ids in rank order."""
    rows = final.join(docs.select(F.col(key).alias("id"), F.length(text).alias("chars")), "id")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    return rows.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.sum("chars").alias("n_chars"), F.array_join(in_order, ",").alias("ids"))


def sources(final: DataFrame, pages: DataFrame, most: int = 3, prefixes: Iterable[str] = rules.TITLE_PREFIXES) -> DataFrame:
    """(query_id, place, url, title, score): the first distinct urls in rank order; pages: (id, url, title)."""
    title = F.btrim(F.coalesce("title", F.lit("Источник")))
    named = F.lit(False)
    for p in prefixes:
        named = named | F.startswith(title, F.lit(p))
    dot = F.locate(". ", title)
    title = F.when(named & (dot > 0), F.substr(title, dot + 2)).otherwise(title)
    rows = final.join(pages.where("url <> ''"), "id").select("query_id", "rank", "id", "url", F.substring(title, 1, 100).alias("title"), F.round("score", 4).alias("score"))
    first = Window.partitionBy("query_id", "url").orderBy("rank", "id")
    place = Window.partitionBy("query_id").orderBy("rank", "id")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("place", F.row_number().over(place))
    return rows.where(F.col("place") <= most).select("query_id", "place", "url", "title", "score")
