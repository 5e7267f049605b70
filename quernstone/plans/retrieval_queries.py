"""Queries of the lexical and vector indexes, of fusion, boost, reranking and the engine variants.

Questions are the benchmark's texts; a question's vector is the one whose id is its item id.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import tokenize, tokenize_long
from quernstone.operators import lexical, ranking, vector
from quernstone.plans import answering
from quernstone.plans.engines import ENGINES, candidates, pool, retrieve
from quernstone.plans.registry import query
from quernstone.session import table
from quernstone.storage import stored

ENTITIES = 50


def sql_tokens(text: str, longer_than: int = 1) -> str:
    """The tokenizers in SQL."""
    return rf"[x FOR x IN string_split_regex(regexp_replace(lower(coalesce({text}, '')), '[^а-яa-z0-9\s]', ' ', 'g'), '\s+') IF len(x) > {longer_than}]"


def sql_lexical(longer_than: int = 1) -> str:
    """Common table expressions up to lex (query_id, id, score) and ltop (with rank)."""
    return rf"""
docs AS (SELECT doc_id AS id, {sql_tokens('text', longer_than)} AS tokens FROM documents
), q AS (SELECT item_id AS query_id, {sql_tokens('text', longer_than)} AS tokens FROM benchmark
), tot AS (SELECT count(*) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens FROM docs
), voc AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM docs) GROUP BY term
), raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS w FROM voc, tot
), st AS (SELECT n_docs, n_tokens, n_tokens / n_docs AS avgdl, (SELECT count(*) FROM raw) AS n_terms, 0.25 * (SELECT sum(w) FROM raw) / (SELECT count(*) FROM raw) AS floor FROM tot
), idf AS (SELECT term, df, CASE WHEN w < 0 THEN floor ELSE w END AS idf FROM raw, st
), asked AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(tokens) AS term FROM q) GROUP BY ALL
), tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), lex AS (
  SELECT query_id, id, round(sum(qf * (idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM tf JOIN idf USING (term) JOIN asked USING (term), st GROUP BY query_id, id
), ltop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex WHERE score > 0) WHERE rank <= 30)"""


def sql_vectors(k: int) -> str:
    return rf"""
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), vq AS (SELECT id AS query_id, v FROM v WHERE id IN (SELECT item_id FROM benchmark)
), vtop AS (SELECT * FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, v.id, round(list_cosine_similarity(v.v, vq.v), 6) AS score FROM v, vq)) WHERE rank <= {k})"""


def sql_fused(k: int, a: float, b: float) -> str:
    return rf"""
fused AS (SELECT query_id, id, round(sum(part), 9) AS score FROM (
  SELECT query_id, id, CAST({a} AS DOUBLE) / ({k} + rank) AS part FROM vtop UNION ALL SELECT query_id, id, CAST({b} AS DOUBLE) / ({k} + rank) FROM ltop) GROUP BY query_id, id)"""


def sql_boosted(how: str, source: str = "fused", most: int | None = ENTITIES) -> str:
    score = "score + bonus * 0.1" if how == "add" else "score * (1 + bonus)"
    return rf"""
ent AS (SELECT term AS entity FROM voc WHERE len(term) >= 4 {f'ORDER BY df DESC, term LIMIT {most}' if most else ''}
), qe AS (SELECT DISTINCT query_id, entity FROM asked JOIN ent ON term = entity
), held AS (SELECT query_id, id, unnest(list_distinct(tokens)) AS token FROM fused JOIN docs USING (id)
), hits AS (SELECT query_id, id, count(DISTINCT entity) AS n FROM held JOIN qe USING (query_id) WHERE token = entity GROUP BY ALL
), boosted AS (SELECT query_id, id, round({score}, 9) AS score FROM (
  SELECT f.query_id, f.id, score, least(CAST(0.02 AS DOUBLE) * coalesce(n, 0), CAST(0.08 AS DOUBLE)) AS bonus FROM {source} f LEFT JOIN hits USING (query_id, id)))"""


def sql_reranked(source: str, window: int, keep: int, name: str = "final") -> str:
    return rf"""
head_{name} AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {source}) WHERE rank <= {window}
), again_{name} AS (
  SELECT query_id, id, round(CASE WHEN len(list_distinct(list_concat(q.tokens, docs.tokens))) = 0 THEN 0 ELSE len(list_intersect(list_distinct(q.tokens), list_distinct(docs.tokens))) / len(list_distinct(list_concat(q.tokens, docs.tokens))) END, 6) AS score
  FROM head_{name} JOIN docs USING (id) JOIN q USING (query_id)
), {name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM again_{name}) WHERE rank <= {keep})"""


RANKED = "query_id, id AS doc_id, score, CAST(rank AS INTEGER) AS rank"


def _docs(spark: SparkSession, sf_dir: str, tokenizer=tokenize) -> DataFrame:
    return lexical.tokens_of(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, v): benchmark questions, with a vector where there is one."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.join(_vectors(spark, sf_dir).withColumnRenamed("id", "query_id"), "query_id", "left")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _asked(spark: SparkSession, sf_dir: str, tokenizer=tokenize) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokenizer(F.col("text")).alias("tokens"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def every_entity(counts: DataFrame) -> DataFrame:
    """(entity, tokens): the built-in entities and all terms of four letters and more, in place of an extracted entity list."""
    terms = lexical.vocabulary(counts).where(F.length("term") >= 4)
    return ranking.known_entities(counts.sparkSession, terms.select(F.col("term").alias("entity")))


def asked_entities(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """The entities that share a token with some question; no other can raise a score."""
    terms = asked.select(F.explode("tokens").alias("term")).distinct()
    named = entities.select("entity", F.explode("tokens").alias("term")).join(terms, "term", "left_semi").select("entity").distinct()
    return entities.join(named, "entity", "left_semi")


def frequent_terms(counts: DataFrame, n: int = ENTITIES) -> DataFrame:
    """(entity, tokens): the most frequent terms of four letters and more, as the SQL of the boosted queries takes them."""
    terms = lexical.vocabulary(counts).where(F.length("term") >= 4).orderBy(F.desc("df"), "term").limit(n)
    return terms.select(F.col("term").alias("entity"), F.array("term").alias("tokens"))


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {sql_tokens('text', 2)} AS t FROM documents)")
def tokenize_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tokenize_long(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"WITH {sql_lexical()} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lexical.counted(_docs(spark, sf_dir))
    return lexical.inverse_frequencies(lexical.vocabulary(counts), lexical.corpus_stats(counts)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {sql_lexical()} SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_places, max(tf) AS most FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM docs) GROUP BY ALL) GROUP BY term")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of every term, summed up by term."""
    rows = lexical.postings(_docs(spark, sf_dir))
    return rows.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_places"), F.max("tf").alias("most"))


@query(f"WITH {sql_lexical()} SELECT n_docs, n_tokens, round(avgdl, 6) AS avgdl, n_terms, round(floor, 6) AS floor FROM st")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(lexical.counted(_docs(spark, sf_dir))).select("n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"), "n_terms", F.round("floor", 6).alias("floor"))


@query(f"WITH {sql_lexical()} SELECT {RANKED} FROM ltop WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark question."""
    return _shown(lexical.bm25_top(_docs(spark, sf_dir), _asked(spark, sf_dir), 10))


@query(
    r"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), s AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(v.v, q.v), 6) AS score FROM v, v q WHERE q.id % 100 = 0)
SELECT query_id, id AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 30"""
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 nearest vectors, by cosine, of every vector whose id is divisible by 100."""
    v = _vectors(spark, sf_dir)
    return _shown(vector.cosine_top(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v"), 30))


def _fused(spark: SparkSession, sf_dir: str, k: int, a: float, b: float, index: lexical.Index | None = None) -> DataFrame:
    engine = replace(ENGINES["canonical"], fusion=(k, a, b), rewrite=False)
    return candidates(engine, table(spark, sf_dir, "documents").select("doc_id", "text"), _vectors(spark, sf_dir), _questions(spark, sf_dir), index)


FUSED = f"WITH {sql_lexical()}, {sql_vectors(30)}, "
ALL_FUSED = "SELECT query_id, id AS doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused"


@query(FUSED + sql_fused(30, 0.45, 0.55) + ALL_FUSED)
def rrf_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(lexical.ranked(_fused(spark, sf_dir, 30, 0.45, 0.55), 60))


@query(FUSED + sql_fused(60, 1, 1) + ALL_FUSED)
def rrf_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(lexical.ranked(_fused(spark, sf_dir, 60, 1, 1), 60))


@query(FUSED + sql_fused(30, 0.4, 0.6) + ALL_FUSED)
def rrf_dated_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(lexical.ranked(_fused(spark, sf_dir, 30, 0.4, 0.6), 60))


def _boosted(spark: SparkSession, sf_dir: str, how: str) -> tuple[DataFrame, DataFrame]:
    """Boosted candidates, and the tokens of all documents among them."""
    index = lexical.built(_docs(spark, sf_dir))
    found = _fused(spark, sf_dir, 30, 0.45, 0.55, index)
    tokens = pool(found, table(spark, sf_dir, "documents").select("doc_id", "text"), tokenize)
    return ranking.boost(found, tokens, _asked(spark, sf_dir), stored(frequent_terms(index.counts)), how), tokens


CANONICAL = FUSED + sql_fused(30, 0.45, 0.55) + ", "


@query(CANONICAL + sql_boosted("add") + "SELECT query_id, id AS doc_id, score FROM boosted")
def entity_boost_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir, "add")[0].withColumnRenamed("id", "doc_id")


@query(CANONICAL + sql_boosted("multiply") + "SELECT query_id, id AS doc_id, score FROM boosted")
def entity_boost_multiplicative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir, "multiply")[0].withColumnRenamed("id", "doc_id")


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, tokens = _boosted(spark, sf_dir, "add")
    return ranking.rerank(found, _asked(spark, sf_dir), tokens)


FINAL = CANONICAL + sql_boosted("add") + ", " + sql_reranked("boosted", 10, 5)


@query(FINAL + f"SELECT {RANKED} FROM final")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_final(spark, sf_dir))


@query(FINAL + "SELECT query_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM final JOIN documents ON doc_id = id GROUP BY query_id")
def final_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.context(_final(spark, sf_dir), table(spark, sf_dir, "documents"))


@query(
    FINAL
    + r""", p AS (SELECT page_id AS id, url, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages WHERE url <> ''
), r AS (SELECT f.query_id, f.rank, f.id, p.url, left(p.title, 100) AS title, round(f.score, 4) AS score FROM final f JOIN p USING (id)
), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY rank, id) AS n FROM r) WHERE n = 1)
SELECT query_id, CAST(place AS INTEGER) AS place, url, title, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS place FROM o) WHERE place <= 3"""
)
def sources_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    return ranking.sources(_final(spark, sf_dir), pages)


def _engine_sql(name: str) -> str:
    e = ENGINES[name]
    out = f"WITH {sql_lexical(2 if e.long_tokens else 1)}, {sql_vectors(e.vector_k)}, "
    source = "vtop"
    if e.fusion:
        out, source = out + sql_fused(*e.fusion) + ", ", "fused"
    if e.boost:
        out, source = out + sql_boosted(e.boost) + ", ", "boosted"
    return out + sql_reranked(source, e.rerank_k, e.final_k) + f"SELECT {RANKED} FROM final"


def _engine(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = ENGINES[name]
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        index = lexical.built(_docs(spark, sf_dir, engine.tokenizer)) if engine.fusion else None
        entities = frequent_terms(index.counts) if engine.boost else None
        return _shown(retrieve(engine, docs, _vectors(spark, sf_dir), _questions(spark, sf_dir), entities, index))

    return run


for _name in ENGINES:
    query(_engine_sql(_name), f"engine_{_name}")(_engine(_name))


@query(CANONICAL + sql_boosted("add", most=None) + "SELECT query_id, id AS doc_id, score FROM boosted")
def entity_boost_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The additive boost by every term of four letters and more, however many there are."""
    index = lexical.built(_docs(spark, sf_dir))
    found = _fused(spark, sf_dir, 30, 0.45, 0.55, index)
    tokens = pool(found, table(spark, sf_dir, "documents").select("doc_id", "text"), tokenize)
    asked = _asked(spark, sf_dir)
    return ranking.boost(found, tokens, asked, stored(asked_entities(every_entity(index.counts), asked))).withColumnRenamed("id", "doc_id")


@query(CANONICAL + sql_boosted("add", most=None) + ", " + sql_reranked("boosted", 10, 5) + f"SELECT {RANKED} FROM final")
def engine_canonical_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical engine with every entity."""
    index = lexical.built(_docs(spark, sf_dir))
    docs, questions = table(spark, sf_dir, "documents").select("doc_id", "text"), _questions(spark, sf_dir)
    entities = asked_entities(every_entity(index.counts), _asked(spark, sf_dir))
    return _shown(retrieve(replace(ENGINES["canonical"], rewrite=False), docs, _vectors(spark, sf_dir), questions, entities, index))


@query()
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guard, retrieval, prompt and an extractive answer for every benchmark question (models are beyond SQL)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.lit("").alias("image"))
    index = lexical.built(_docs(spark, sf_dir))
    rows = answering.answered(_questions(spark, sf_dir), docs, _vectors(spark, sf_dir), pages, every_entity(index.counts), index=index)
    return answering.answer_events(rows)
