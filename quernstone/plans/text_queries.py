"""Queries of projections, text functions and filters over whole tables; legal texts are made of the tables' columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import models, rules, text as T
from quernstone.functions.regex import bound
from quernstone.functions.stem import stem_tokens
from quernstone.operators import chunk, graph, lexical, ranking, serving
from quernstone.plans import graph_queries as G
from quernstone.plans.engines import ENGINES
from quernstone.plans.registry import query
from quernstone.plans.retrieval_queries import RANKED, _shown, sql_lexical
from quernstone.session import table, worker_path
from quernstone.sources import readers as R


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(
    """SELECT doc_id, 'НАЗВАНИЕ: ' || coalesce(source, '') || chr(10) || 'СОДЕРЖАНИЕ: ' || coalesce(text, '') AS document,
CASE WHEN lang = 'en' THEN concat_ws(chr(10), source, text) ELSE text END AS embedded, 'title: ' || coalesce(source, '') || chr(10) || 'source_url: ' || coalesce(lang, '') || chr(10) || chr(10) || coalesce(text, '') AS rendered FROM documents"""
)
def document_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as it is shown, as it is embedded (title first for some) and as the lexical index reads it."""
    title, text = F.col("source"), F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", R.document_text(title, text).alias("document"), R.indexed_text(title, text, F.col("lang") == "en").alias("embedded"), R.rendered_node(title, F.col("lang"), text).alias("rendered"))


def _graph(text: Column) -> Column:
    """A graph whose entities are a text's words, those over five letters with a description, each related to the next."""

    def of(words: Column) -> Column:
        entity = F.transform(words, lambda w: F.struct(w.alias("name"), F.when(F.length(w) > 5, F.repeat(w, 8)).otherwise("").alias("description")))
        pairs = F.transform(words, lambda w, i: F.struct(w.alias("source"), F.coalesce(F.get(words, i + 1), F.lit("")).alias("target"), F.when(i % 2 == 1, F.lit("содержит")).otherwise(F.lit("иное")).alias("relation")))
        return F.struct(entity.alias("entities"), pairs.alias("relationships"))

    return bound(F.split(text, " "), of)


@query("SELECT doc_id, array_to_string([CASE WHEN length(w) > 5 THEN w || ' (' || left(repeat(w, 8), 50) || ')' ELSE w END FOR w IN string_split(text, ' ')[1:7]], '; ') AS graph FROM documents")
def graph_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven entities of each document's graph as one text."""
    return table(spark, sf_dir, "documents").select("doc_id", R.graph_text(_graph(F.col("text"))).alias("graph"))


_WORDS = r"w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)"


@query(
    rf"""WITH {_WORDS}, e AS (SELECT doc_id, generate_subscripts(w[1:12], 1) - 1 AS i, trim(unnest(w[1:12])) AS name FROM w)
SELECT doc_id AS chunk, CAST(doc_id * 12 + i AS BIGINT) AS seq, name, CASE WHEN length(name) > 5 THEN repeat(name, 8) ELSE '' END AS description FROM e WHERE length(name) >= 3"""
)
def graph_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve entities of each document's graph that are long enough, numbered in order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("seq"), _graph(F.col("text")).alias("graph"))
    return graph.mentions(rows, "doc_id").select("chunk", "seq", "name", "description")


@query(
    rf"""WITH {_WORDS}, r AS (SELECT doc_id, i, trim(w[i]) AS source, trim(coalesce(w[i + 1], '')) AS target FROM (SELECT doc_id, w, unnest(range(1, 16)) AS i FROM w))
SELECT doc_id AS chunk, CAST(doc_id * 15 + i - 1 AS BIGINT) AS seq, source, target, 'содержит' AS relation FROM r WHERE i % 2 = 0 AND source <> '' AND target <> ''"""
)
def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of a known kind among the first fifteen of each document's graph."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("seq"), _graph(F.col("text")).alias("graph"))
    return graph.relations(rows, "doc_id")


@query(r"SELECT doc_id, regexp_replace(coalesce(text, ''), '([_*\[\]()~`>#+\-=|{}.!])', '\\\1', 'g') AS text FROM documents")
def escape_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_markdown(F.col("text")).alias("text"))


def _sql_safe(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9а-яё]', '_', 'g'), '_+', '_', 'g'), '_')"


@query(f"SELECT p_partkey, 'part_' || {_sql_safe('p_brand')} || '_' || {_sql_safe('p_type')} || '_' || p_partkey AS id FROM part")
def chunk_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_ids(table(spark, sf_dir, "part"), "part", "p_brand", "p_type", "p_partkey").select("p_partkey", "id")


@query(
    r"""SELECT c_nationkey AS nation, '• ' || c_name || ' | КОД: `01-2-3-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '` | ГРУППА: ' || CASE WHEN c_mktsegment < 'F' THEN 'Без группы' ELSE 'Высшая группа должностей' END
|| ' | КАТЕГОРИЯ: Должности категории ' || c_mktsegment || ' | Раздел 1' AS text FROM customer"""
)
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry for each nation, of customers under their segment, with the headings above each row stitched to it."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.concat(F.lit("| "), "c_name", F.lit(" | 01-2-3-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(" |")).alias("line"))
    parts = rows.groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    group = F.when(F.col("c_mktsegment") >= "F", "Высшая группа должностей\n").otherwise("")
    part = F.struct("c_mktsegment", F.concat(F.lit("Должности категории "), "c_mktsegment", F.lit("\n"), group, "lines").alias("t"))
    whole = parts.groupBy("c_nationkey").agg(F.concat(F.lit("Раздел 1\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n")).alias("text"))
    return chunk.registry_rows(whole, "c_nationkey", "text").select(F.col("c_nationkey").alias("nation"), "text")


@query(
    r"""SELECT doc_id, 'kept' || CASE WHEN text = '' THEN '' ELSE '' END || chr(10) || array_to_string([CASE WHEN trim(x, E' \t\r\n') = '' THEN '' ELSE x END FOR x IN string_split(text, chr(10)) IF NOT regexp_full_match(trim(x, E' \t\r\n'), '#+')], chr(10)) || chr(10) || 'end' AS text FROM documents WHERE text IS NOT NULL"""
)
def service_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts among marks of editing, which go."""
    marked = F.concat(F.lit("Абзац.\nkept\n###\n(Статья в редакции закона)\n"), "text", F.lit("\n(Наименование главы)\nend"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.drop_service_lines(marked).alias("text"))


@query(
    """SELECT p_partkey, p_size || '.' || p_partkey % 10 AS number, CASE WHEN p_partkey % 1000 >= 100 THEN left(CAST(p_partkey % 1000 AS VARCHAR), 2) || '.' || substr(CAST(p_partkey % 1000 AS VARCHAR), 3) ELSE CAST(p_partkey % 1000 AS VARCHAR) END AS split,
'Статья ' || p_size || '.' || p_partkey % 10 || '. ' || p_name AS title FROM part"""
)
def article_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and titles of articles, from headings written in several ways."""
    size, last = F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string")
    header = F.concat(F.lit("### Статья "), size, F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("."), last, F.lit(". "), "p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.article_number(F.concat(F.lit("<b> "), size, F.lit("</b> - "), last, F.lit("."))).alias("number"), T.split_article_number((F.col("p_partkey") % 1000).cast("string")).alias("split"), T.article_title(header)["title"].alias("title")
    )


@query("SELECT l_orderkey, l_linenumber, l_linenumber <= 3 AS orphan FROM lineitem")
def orphan_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunks hold nothing but a number behind their prefix."""
    number = F.col("l_linenumber").cast("string")
    text = F.concat(F.lit("[ACT] [Article 5] "), number, F.lit("."), number, F.when(F.col("l_linenumber") <= 3, ".").otherwise(". text"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.is_orphan_number(text).alias("orphan"))


@query(
    r"""SELECT p_partkey, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS heading, CASE p_size % 3 WHEN 0 THEN 'IV' WHEN 1 THEN 'XII' END AS roman, p_size % 2 = 0 AS is_table FROM part"""
)
def heading_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings without marks, their Roman numbers, and starts of tables."""
    roman = F.when(F.col("p_size") % 3 == 0, "«IV. ").when(F.col("p_size") % 3 == 1, "XII. ").otherwise("1. ")
    start = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Таблица № "), F.col("p_size").cast("string"))).otherwise("Строка таблицы № 1")
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_heading(F.concat(F.lit("** "), "p_name", F.lit(" **"))).alias("heading"), T.roman_numeral(F.concat(roman, F.col("p_name"))).alias("roman"), T.is_table_start(start).alias("is_table"))


@query("SELECT event_id, '{\"type\":\"' || event_type || '\", \"title\":{\"text\":\"t\"}, \"data\":[' || user_id || ',2]}' AS chart, 'before ' || chr(10) || '• one' || chr(10) || '• two' AS chat FROM events")
def chart_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of answers whose JSON is cut short and loosely written, and the rest of the answer in lines."""
    broken = F.concat(F.lit("before • one• two[chart_json]```json{type:'"), "event_type", F.lit("', \"title\": 't', data:["), F.col("user_id").cast("string"), F.lit(",2,[/chart_json]"))
    whole = F.replace(broken, F.lit(",2,["), F.lit(",2["))
    return table(spark, sf_dir, "events").select("event_id", T.repair_chart(whole).alias("chart"), T.chat_breaks(whole).alias("chat"))


@query("SELECT doc_id, (contains(lower(text), 'token') OR contains(lower(text), 'password')) AND NOT contains(lower(text), 'документ') AS blocked, FALSE AS by_default FROM documents WHERE text IS NOT NULL")
def bot_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chat bot's guard blocks by a table of patterns, and by its empty default."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", serving.bot_guard(F.col("text"), ["token", "pass(word)"]).alias("blocked"), serving.bot_guard(F.col("text")).alias("by_default"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'другой ответ' ELSE 'Ответ: ' || event_type END AS answer FROM events")
def polite_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that sound like a refusal, replaced."""
    said = F.when(F.col("event_type") == "click", "Извините, сейчас нельзя").otherwise(F.concat(F.lit("Ответ: "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", serving.polite(said, F.lit("другой ответ")).alias("answer"))


@query(f"SELECT DISTINCT entity FROM (SELECT lower(trim(p_type)) AS entity FROM part UNION ALL SELECT lower(s_name) FROM supplier UNION ALL SELECT unnest([{_quoted(rules.BASE_ENTITIES)}])) WHERE length(entity) >= 3")
def entity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in entities and those of the tables, each once."""
    found = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_type").alias("entity")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("entity")))
    return ranking.known_entities(spark, found).select("entity")


@query(f"WITH {G.SQL_EDGES} SELECT 'concept' AS source_type, relation, 'concept' AS target_type, count(*) AS n FROM e GROUP BY relation")
def edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges there are of each kind of source, relation and target."""
    return graph.edge_types(graph.edge_rollup(G._relations(spark, sf_dir)))


@query(f"WITH {G.SQL_EDGES}, b AS (SELECT source AS s, target AS t, weight FROM g UNION ALL SELECT target, source, 1 FROM g UNION ALL SELECT source, source, 1 FROM g) SELECT least(s, t) AS a, greatest(s, t) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM b WHERE s <> t GROUP BY ALL")
def edges_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of both directions and self-loops as one undirected graph."""
    edges = G._merged(spark, sf_dir).select("source", "target", "weight")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1).cast("long").alias("weight"))
    loops = edges.select("source", F.col("source").alias("target"), F.lit(1).cast("long").alias("weight"))
    return graph.undirected(edges.unionByName(back).unionByName(loops))


_STEMS = {"служебного": "служебн", "контракта": "контракт", "государственная": "государствен", "отпуском": "отпуск", "комиссии": "комисс", "увольнение": "увольнен", "нанимателя": "нанимател"}


@query(f"SELECT event_id, word, stem FROM events, (SELECT unnest([{_quoted(_STEMS)}]) AS word, unnest([{_quoted(_STEMS.values())}]) AS stem) WHERE event_id % 7 = (length(word) + ascii(word)) % 7")
def stemmed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Russian words of each event and their stems, against a dictionary."""
    worker_path(spark)
    words = F.array(*(F.lit(w) for w in _STEMS))
    mine = F.filter(words, lambda w: F.col("event_id") % 7 == (F.length(w) + F.ascii(w)) % 7)
    rows = table(spark, sf_dir, "events").select("event_id", mine.alias("words")).where(F.size("words") > 0)
    both = rows.select("event_id", F.explode(F.arrays_zip("words", stem_tokens("words").alias("stems"))).alias("x"))
    return both.select("event_id", F.col("x.words").alias("word"), F.col("x.stems").alias("stem"))


@query(
    f"""WITH documents_ru AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' служебн контракт' WHEN doc_id % 3 = 1 THEN ' контракт' ELSE '' END AS text FROM documents
), benchmark_ru AS (SELECT item_id, text || ' служебн контракт' AS text FROM benchmark), {sql_lexical().replace('FROM documents', 'FROM documents_ru').replace('FROM benchmark', 'FROM benchmark_ru')} SELECT {RANKED} FROM ltop WHERE rank <= 10"""
)
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every question, where Russian words in one form ask for texts that have them in another."""
    worker_path(spark)
    cut = replace(ENGINES["canonical"], stem=True).tokenizer
    form = F.when(F.col("doc_id") % 3 == 0, " служебного контракта").when(F.col("doc_id") % 3 == 1, " контрактами").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), form).alias("text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), cut(F.concat("text", F.lit(" служебному контракту"))).alias("tokens"))
    return _shown(lexical.indexed_top(lexical.built(lexical.tokens_of(docs, "doc_id", "text", cut)), asked, 10))


def _sql_word_set(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'))"


@query(
    f"""WITH {sql_lexical()}, p AS (SELECT l.query_id, l.id, {_sql_word_set('b.text')} AS q, {_sql_word_set('left(d.text, 4000)')} AS t FROM ltop l JOIN benchmark b ON b.item_id = l.query_id JOIN documents d ON d.doc_id = l.id WHERE l.rank <= 10
), s AS (SELECT query_id, id, round(len(list_intersect(q, t)) / greatest(1, len(list_distinct(list_concat(q, t)))), 6) AS score FROM p)
SELECT query_id, id AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"""
)
def model_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of ten documents of every question by the reranking model, over pairs of question and passage."""
    worker_path(spark)
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), T.tokenize(F.col("text")).alias("tokens"))
    head = lexical.indexed_top(lexical.built(lexical.tokens_of(docs, "doc_id", "text")), asked, 10).select("query_id", "id")
    pairs = head.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    scored = pairs.select("query_id", "id", F.round(models.reranker()("question", "text"), 6).alias("score"))
    return _shown(lexical.ranked(scored, 5))
