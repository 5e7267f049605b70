"""From questions to answers: guard, retrieval, prompt, synthesis and answer events, for many questions at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import models
from quernstone.operators import lexical, ranking, serving
from quernstone.plans.engines import ENGINES, Engine, retrieve
from quernstone.session import worker_path
from quernstone.storage import stored


def synthesizer(answer: Callable[[str, Sequence[str]], str] = models.extractive_answer):
    """A column function (prompt, chunks, mode) -> answer."""

    @F.pandas_udf("string")
    def run(prompt: pd.Series, chunks: pd.Series, mode: pd.Series) -> pd.Series:
        return pd.Series([models.synthesize(p, list(c) if c is not None else [], m, answer) for p, c, m in zip(prompt, chunks, mode, strict=True)])

    return run


def answered(questions: DataFrame, docs: DataFrame, vectors: DataFrame, pages: DataFrame, entities: DataFrame | None = None, engine: Engine = ENGINES["canonical"], people: Sequence[tuple[str, Sequence[str]]] = (), answer=models.extractive_answer, index: lexical.Index | None = None) -> DataFrame:
    """(query_id, refused, route, answer, sources, image): one row for each question.

    questions: (query_id, text, v); docs: (doc_id, text); vectors: (id, v); pages: (id, url, title, image). Refused
    questions and those that nothing is found for get the constant answer.
    """
    worker_path(questions.sparkSession)
    routes = serving.ROUTES[engine.modes]
    judged = questions.withColumn("refused", serving.guard_reason(F.col("text"))).withColumn("_r", serving.route_mode(F.col("text"), routes))
    allowed = questions.join(judged.where("refused IS NULL").select("query_id"), "query_id", "left_semi")
    final = stored(retrieve(engine, docs, vectors, allowed, entities, index))
    texts = final.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])  # at most final_k a question
    chunks = texts.groupBy("query_id").agg(in_order.alias("chunks"))
    places = ranking.sources(final, pages.select("id", "url", "title"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "url", "title", "score"))), lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"), x["score"].alias("score")))
    cited = places.groupBy("query_id").agg(listed.alias("sources"))
    images = final.join(pages.select("id", F.nullif("image", F.lit("")).alias("image")), "id").groupBy("query_id").agg(F.min_by("image", F.when(F.col("image").isNotNull(), F.col("rank"))).alias("top_image"))
    rows = judged.join(chunks, "query_id", "left").join(cited, "query_id", "left").join(images, "query_id", "left")
    said = F.when(F.col("chunks").isNotNull(), synthesizer(answer)(serving.prompt(F.col("text")), F.col("chunks"), F.col("_r.mode")))
    rows = rows.withColumn("_said", serving.fallback_answer(said)).withColumn("image", F.when(F.col("chunks").isNotNull(), serving.illustration(F.col("_said"), people, F.col("top_image"))))
    return rows.select("query_id", "refused", F.col("_r.route").alias("route"), serving.decorated(F.col("_said"), F.col("image")).alias("answer"), F.coalesce("sources", F.array().cast("array<struct<url:string,title:string,score:double>>")).alias("sources"), "image")


def answer_events(answers: DataFrame) -> DataFrame:
    """(query_id, seq, type, content): metadata with the sources, the answer word by word, the end."""
    event = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"))
    meta = F.to_json(F.struct("sources", (F.size("sources") > 0).alias("has_answer"), "image"))
    words = F.transform(F.split("answer", "(?<= )"), lambda w: event("text", w))
    return answers.select("query_id", F.posexplode(F.concat(F.array(event("metadata", meta)), words, F.array(event("end", F.lit(""))))).alias("seq", "_e")).select("query_id", "seq", "_e.type", "_e.content")
