"""Queries of the serving logic: guards, routers, lookups, prompts and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import rules
from quernstone.functions.text import rewrite_synonyms
from quernstone.operators import serving
from quernstone.plans.registry import query
from quernstone.session import table

#: Phrases for the test tables, which are in Latin script.
SYNONYMS = {"the re": "a re", "there": "here", "the": "thy", "and": "or", "of the": "from a", "thy": "thine"}
ROUTES = serving.RouteRules((("negative", "compact", ("not ", "no las")), ("biography", "compact", ("was the", "est le")), ("fact", "compact", ("when", "with"))))
PEOPLE = [("Tion.jpg", ("ention the", "tiontion")), ("Whor.jpg", ("whorth", "of the re")), ("Eau.jpg", ("eaueau", "les ément"))]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(text: str, needles) -> str:
    return "(" + (" OR ".join(f"contains({text}, {_quote(n)})" for n in needles) or "false") + ")"


def sql_pairs(text: str, pairs) -> str:
    return "(" + " OR ".join(f"(contains({text}, {_quote(a)}) AND contains({text}, {_quote(b)}))" for a, b in pairs) + ")"


def sql_cases(text: str, routes: serving.RouteRules, which: int) -> str:
    cases = " ".join(f"WHEN {sql_any(f'lower({text})', r[2])} THEN {_quote(r[which])}" for r in routes.table)
    return f"CASE {cases} ELSE {_quote(routes.default[which])} END"


def _sql_synonyms(text: str) -> str:
    out = f"lower({text})"
    for k, v in sorted(SYNONYMS.items(), key=lambda kv: -len(kv[0])):
        out = f"replace({out}, {_quote(k)}, {_quote(v)})"
    return out


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query(f"SELECT conv_id, turn, {_sql_synonyms('text')} AS text FROM conversations")
def synonym_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", rewrite_synonyms(F.col("text"), SYNONYMS).alias("text"))


_G = serving.GuardRules()
_FORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(
    f"""SELECT doc_id, CASE WHEN text IS NULL OR trim(regexp_replace(text, '\\s+', '', 'g')) = '' OR {sql_any(_FORM, _G.safe)} THEN NULL WHEN {sql_pairs(_FORM, _G.pairs)} THEN 'pair'
WHEN {sql_any(f"replace({_FORM}, ' ', '')", _G.spaceless)} THEN 'spaceless' WHEN {' OR '.join(f"regexp_matches(text, {_quote('(?i)' + p)})" for p in _G.patterns)} THEN 'pattern'
WHEN length(text) > 2000 THEN 'length' WHEN {sql_pairs(f"translate(lower(text), '{_G.homoglyphs[0]}', '{_G.homoglyphs[1]}')", _G.pairs)} THEN 'homoglyph' END AS reason FROM documents"""
)
def guard_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", serving.guard_reason(F.col("text")).alias("reason"))


@query(f"SELECT conv_id, turn, {sql_cases('text', ROUTES, 0)} AS route, {sql_cases('text', ROUTES, 1)} AS mode FROM conversations")
def route_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", serving.route_mode(F.col("text"), ROUTES).alias("r")).select("conv_id", "turn", "r.route", "r.mode")


@query(f"SELECT conv_id, turn, {sql_cases('text', serving.ROUTES['router_dated'], 0)} AS route, CASE WHEN contains(lower(text), 'tion') AND NOT contains(lower(text), 'the') THEN 'persona' ELSE 'rag' END AS request FROM conversations")
def route_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select(
        "conv_id", "turn", serving.route_mode(F.col("text"), serving.ROUTES["router_dated"])["route"].alias("route"), serving.route_request(F.col("text"), ["tion"], ["the"]).alias("request")
    )


@query(
    f"""SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN {' OR '.join(f"list_has_any(string_split_regex(lower(text), '\\s+'), [{', '.join(map(_quote, k))}])" for _, k in rules.COINS.values())} THEN 'prices'
WHEN ({sql_any('lower(text)', ['мультик', 'наложик'])} OR turn % 2 = 1) AND {sql_any('lower(text)', rules.DOMAIN_WORDS)} THEN 'domain' WHEN {sql_any('lower(text)', ['мультик', 'наложик'])} OR turn % 2 = 1 THEN 'persona' END AS route FROM conversations"""
)
def route_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", serving.route_message(F.col("text"), F.col("turn") % 2 == 1).alias("route"))


_COINS = {"the": ("T", ["the", "of"]), "que": ("Q", ["que", "la"]), **rules.COINS}


@query("SELECT doc_id, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN list_has_any(string_split_regex(lower(text), '\\s+'), [{', '.join(map(_quote, k))}]) THEN {_quote(c)} END" for c, (_, k) in _COINS.items()) + "] IF x IS NOT NULL], ',') AS coins FROM documents")
def coin_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(serving.coins_of(F.col("text"), _COINS), ",").alias("coins"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {sql_any('lower(text)', v)} THEN {_quote(f)}" for f, v in PEOPLE) + " END AS person FROM documents")
def person_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", serving.person_in(F.lower("text"), PEOPLE).alias("person"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, trim(lower(text)) AS low, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations
), c AS (SELECT conv_id, turn, q, coalesce(nullif(trim(regexp_replace(low, '\b(and|of)\b', '', 'g')), ''), low) AS clean FROM t)
SELECT conv_id, turn, CASE WHEN coalesce(q, '') <> '' THEN 'КОНТЕКСТ: ' || CASE WHEN length(q) > 600 THEN left(q, 600) || '...' ELSE q END || chr(10) || chr(10) || 'ВОПРОС: ' || clean ELSE clean END AS prompt FROM c"""
)
def reply_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.previous_turn(_turns(spark, sf_dir)).select("conv_id", "turn", serving.reply_prompt(F.col("text"), F.col("quoted"), r"\b(and|of)\b").alias("prompt"))


@query(
    f"""SELECT doc_id, regexp_matches(lower(text), {_quote(rules.EMPTY_ANSWER)}) AS is_empty, contains(lower(text), '[chart_json]') AS is_chart,
contains(text, '|---') OR contains(text, '| :---') OR length(text) - length(replace(text, '|', '')) > 10 AS is_table FROM documents"""
)
def answer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *serving.answer_flags(F.col("text")))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.chat_text(_turns(spark, sf_dir))


@query(
    """SELECT event_id, '💰 ' || CASE event_type WHEN 'view' THEN 'BTC' ELSE upper(event_type) END || chr(10) || '💵 $' || format('{:,.2f}', value) || chr(10) || '₽ ' || format('{:,.2f}', value * 90) || chr(10)
|| CASE WHEN value - 50 > 0 THEN '📈' ELSE '📉' END || ' ' || format('{:+.2f}', value - 50) || '% (24h)' AS message FROM events"""
)
def price_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    coin = F.when(F.col("event_type") == "view", "bitcoin").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", serving.price_text(coin, F.col("value"), F.col("value") * 90, F.col("value") - 50).alias("message"))


@query(
    f"""SELECT item_id, 'ВОПРОС:' || chr(10) || text || chr(10) || chr(10) || {_quote(rules.PROMPT_RULES)} || CASE WHEN {sql_any('lower(text)', ['the re', 'que '])} THEN {_quote(rules.PROMPT_NEGATIVE)} ELSE '' END AS prompt FROM benchmark"""
)
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", serving.prompt(F.col("text"), ["the re", "que "]).alias("prompt"))


@query(
    """WITH a AS (SELECT lower(trim(text)) AS key, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, conv_id * 1000 + turn AS seq FROM conversations
), c AS (SELECT key, arg_min(answer, seq) AS answer FROM a WHERE answer IS NOT NULL GROUP BY key)
SELECT conv_id, turn, c.answer AS cached FROM conversations LEFT JOIN c ON key = lower(trim(text))"""
)
def response_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the first answer that any turn of the same text got."""
    turns = _turns(spark, sf_dir)
    answers = turns.select(F.col("text").alias("query"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    cache = serving.cache_of(answers.where("answer IS NOT NULL"))
    return serving.with_cached(turns.select("conv_id", "turn", "text"), cache, "text").select("conv_id", "turn", F.col("answer").alias("cached"))
