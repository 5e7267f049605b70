"""Serving logic as columns: the query guard, routers, lookups in answers, prompts, prices, and the response cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions import rules
from quernstone.functions.regex import any_contained, any_matched, bound, folded
from quernstone.functions.text import guard_form, nfkc, percent_encode
from quernstone.storage import new_path, stored


@dataclass(frozen=True)
class GuardRules:
    """What the guard looks for; the defaults are the built-in lists."""

    safe: Sequence[str] = tuple(rules.SAFE_PHRASES)
    pairs: Sequence[tuple[str, str]] = tuple(rules.DANGEROUS_PAIRS)
    spaceless: Sequence[str] = tuple(rules.DANGEROUS_SPACELESS)
    patterns: Sequence[str] = tuple(rules.DANGEROUS_PATTERNS)
    homoglyphs: tuple[str, str] = rules.HOMOGLYPHS
    max_chars: int = rules.MAX_QUERY_CHARS


def _any_pair(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    out = F.lit(False)
    for a, b in pairs:
        out = out | (F.contains(text, F.lit(a)) & F.contains(text, F.lit(b)))
    return out


def guard_reason(query: Column, guard: GuardRules | None = None, compatible: Callable[[Column], Column] = nfkc) -> Column:
    """Why a query is refused: pair, spaceless, pattern, length or homoglyph; null if it isn't. The first reason counts.

    Blank queries and those with a safe phrase pass. Patterns look at the query as it came, all else at its normal form.
    """
    g = guard or GuardRules()
    none = F.lit(None).cast("string")
    # The normal form, the same without blanks, and the query with look-alike letters exchanged.
    form = guard_form(query, compatible)
    forms = F.struct(query.alias("raw"), form.alias("form"), F.translate(F.lower(query), *g.homoglyphs).alias("alike"))

    def reason(x: Column) -> Column:
        bare = lambda y: F.regexp_replace(y, F.lit(r"(?U)\s+"), F.lit(""))
        return (
            F.when(x["raw"].isNull() | F.rlike(x["raw"], F.lit(r"(?U)^\s*$")) | any_contained(x["form"], g.safe), none)
            .when(_any_pair(x["form"], g.pairs), "pair")
            .when(bound(bare(x["form"]), lambda y: any_contained(y, g.spaceless)), "spaceless")
            .when(any_matched(x["raw"], g.patterns), "pattern")
            .when(F.length(x["raw"]) > g.max_chars, "length")
            .when(_any_pair(x["alike"], g.pairs), "homoglyph")
            .otherwise(none)
        )

    return bound(forms, reason)


def bot_guard(text: Column, patterns: Sequence[str] = (), whitelist: Sequence[str] = tuple(rules.BOT_WHITELIST)) -> Column:
    """The chat bot's guard: a table of patterns (empty by default), and words that always pass."""
    low = F.btrim(F.lower(text))
    return ~any_contained(low, whitelist) & any_matched(low, patterns)


@dataclass(frozen=True)
class RouteRules:
    """(route, mode, phrases) in order; the first whose phrase occurs wins."""

    table: Sequence[tuple[str, str, Sequence[str]]] = field(
        default_factory=lambda: (("negative", "compact", tuple(rules.NEGATIVE_PHRASES)), ("biography", "compact", tuple(rules.BIOGRAPHY_PHRASES)), ("fact", "compact", tuple(rules.FACT_PHRASES)))
    )
    default: tuple[str, str] = ("default", "tree")


ROUTES = {
    "router": RouteRules(),
    "router_dated": RouteRules(
        (("negative", "compact", tuple(rules.NEGATIVE_PHRASES_DATED)), ("biography", "compact", tuple(rules.BIOGRAPHY_PHRASES)), ("fact", "compact", tuple(rules.FACT_PHRASES_DATED)), ("summary", "tree", tuple(rules.SUMMARY_PHRASES)))
    ),
    "visual_simple": RouteRules((("visual", "compact", tuple(rules.VISUAL_STEMS)),), ("default", "simple")),
    "visual_tree": RouteRules((("visual", "compact", tuple(rules.VISUAL_STEMS)),), ("default", "tree")),
    "compact": RouteRules((), ("default", "compact")),
    "simple": RouteRules((), ("default", "simple")),
}


def route_mode(query: Column, routes: RouteRules | None = None) -> Column:
    """struct(route, mode) of a query."""
    r = routes or ROUTES["router"]
    pair = lambda a, b: F.struct(F.lit(a).alias("route"), F.lit(b).alias("mode"))
    out = pair(*r.default)
    for route, mode, phrases in reversed(list(r.table)):
        out = F.when(any_contained(F.lower(query), phrases), pair(route, mode)).otherwise(out)
    return out


def route_request(query: Column, persona: Sequence[str] = tuple(rules.PERSONA_WORDS), domain: Sequence[str] = tuple(rules.DOMAIN_WORDS)) -> Column:
    """persona if a persona word and no domain word occurs, else rag."""
    low = F.lower(query)
    return F.when(any_contained(low, persona) & ~any_contained(low, domain), "persona").otherwise("rag")


def coins_of(text: Column, coins: dict[str, tuple[str, list[str]]] | None = None) -> Column:
    """Ids of the coins one of whose words is a whole word of the text, in the table's order."""
    table = (coins or rules.COINS).items()
    hits = lambda words: F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, keys))), F.lit(coin)) for coin, (_, keys) in table))
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"))
    return F.filter(bound(words, hits), lambda x: x.isNotNull())


def route_message(text: Column, is_reply: Column, hacking: Column | None = None) -> Column:
    """Where a chat message goes: refused, prices, domain, persona, or nowhere (null)."""
    low = F.lower(text)
    addressed = any_contained(low, [*rules.PERSONA_WORDS, rules.DOMAIN_WORDS[0]]) | F.coalesce(is_reply, F.lit(False))
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(bot_guard(text) if hacking is None else hacking, "refused")
        .when(F.size(coins_of(text)) > 0, "prices")
        .when(addressed & any_contained(low, rules.DOMAIN_WORDS), "domain")
        .when(addressed, "persona")
    )


def name_variants(file: Column) -> Column:
    """What a file's person is called: the name without its ending, its first word and its first two, over five letters."""
    name = F.lower(F.regexp_replace(file, F.lit(r"\.[^.]*$"), F.lit("")))
    parts = F.split(F.btrim(name), r"\s+")
    two = F.when(F.size(parts) >= 2, F.concat_ws(" ", parts[0], parts[1]))
    return F.filter(F.array(name, parts[0], two), lambda v: F.length(v) > 5)


def person_in(text: Column, people: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first person of a bounded list one of whose variants occurs in the lower-case text, or null."""
    out = F.lit(None).cast("string")
    for file, variants in reversed(list(people)):
        out = F.when(any_contained(text, variants), F.lit(file)).otherwise(out)
    return out


def illustration(answer: Column, people: Sequence[tuple[str, Sequence[str]]], top_image: Column) -> Column:
    """The person's picture, else that of the best chunk."""
    return F.coalesce(person_in(F.lower(answer), people), F.nullif(top_image, F.lit("")))


def answer_flags(answer: Column) -> list[Column]:
    """is_empty, is_chart, is_table."""
    low = F.lower(answer)
    pipes = F.length(low) - F.length(F.replace(low, F.lit("|"), F.lit("")))
    table = any_contained(low, rules.TABLE_RULES) | (pipes > rules.TABLE_PIPES)
    return [F.rlike(low, F.lit(folded(rules.EMPTY_ANSWER))).alias("is_empty"), F.contains(low, F.lit(rules.CHART_TAG)).alias("is_chart"), table.alias("is_table")]


def decorated(answer: Column, image: Column) -> Column:
    """The answer with its picture behind it, if it is plain text with something to say and not about the assistant."""
    empty, chart, is_table = answer_flags(answer)
    plain = ~(empty | chart | is_table | F.contains(F.lower(answer), F.lit(rules.SELF_MENTION)))
    return F.when(plain & image.isNotNull(), F.concat(answer, F.lit("\n\n![photo](/images/"), percent_encode(image), F.lit(")"))).otherwise(answer)


def fallback_answer(answer: Column) -> Column:
    return F.coalesce(F.nullif(answer, F.lit("")), F.lit(rules.NOT_FOUND_ANSWER))


def polite(answer: Column, instead: Column) -> Column:
    """The answer, or another where it sounds like a refusal."""
    return F.when(any_contained(F.lower(answer), rules.IMPOLITE_MARKS), instead).otherwise(answer)


def prompt(query: Column, negatives: Sequence[str] = tuple(rules.NEGATIVE_PHRASES)) -> Column:
    """What the model is asked: the question, its rules, and more of them for a question in the negative."""
    extra = F.when(any_contained(F.lower(query), negatives), F.lit(rules.PROMPT_NEGATIVE)).otherwise(F.lit(""))
    return F.concat(F.lit("ВОПРОС:\n"), query, F.lit("\n\n" + rules.PROMPT_RULES), extra)


def reply_prompt(text: Column, quoted: Column, names: str = rules.BOT_NAMES, quote_chars: int = 600) -> Column:
    """A message without the bot's names, behind the message that it answers, cut to so many characters."""
    low = F.btrim(F.lower(text))
    clean = F.coalesce(F.nullif(F.btrim(F.regexp_replace(low, F.lit("(?iuU)" + names), F.lit(""))), F.lit("")), low)
    cut = F.when(F.length(quoted) > quote_chars, F.concat(F.substring(quoted, 1, quote_chars), F.lit("..."))).otherwise(quoted)
    return F.when(F.coalesce(quoted, F.lit("")) != "", F.concat(F.lit("КОНТЕКСТ: "), cut, F.lit("\n\nВОПРОС: "), clean)).otherwise(clean)


def price_text(coin: Column, usd: Column, rub: Column, change: Column) -> Column:
    """A price message; coins without a short name are shown in capitals."""
    short = F.create_map(*(F.lit(x) for coin_id, (name, _) in rules.COINS.items() for x in (coin_id, name)))
    icon = F.when(change > 0, "📈").otherwise("📉")
    return F.concat(
        F.lit("💰 "), F.coalesce(F.element_at(short, coin), F.upper(coin)), F.lit("\n💵 $"), F.format_number(usd, 2), F.lit("\n₽ "), F.format_number(rub, 2), F.lit("\n"), icon, F.lit(" "), F.format_string("%+.2f", change), F.lit("% (24h)")
    )


def split_messages(parts: Column, most: int = 4_000, group: int = 3) -> Column:
    """One message of all parts, or messages of three parts each if it were too long."""
    whole = F.array_join(parts, "\n\n")
    groups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(group)), lambda i: F.array_join(F.slice(parts, i, group), "\n\n"))
    return F.when(F.length(whole) > most, groups).otherwise(F.array(whole))


def cache_key(query: Column) -> Column:
    return F.lower(F.btrim(query))


def with_cached(requests: DataFrame, cache: DataFrame, query: str = "query") -> DataFrame:
    """Requests with the cached answer (null if there is none); cache: (key, answer), one row for each key."""
    return requests.withColumn("_key", cache_key(F.col(query))).join(cache.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def cache_of(answers: DataFrame, query: str = "query", answer: str = "answer", order: str = "seq", is_error: Column | None = None) -> DataFrame:
    """(key, answer): the first answer to each distinct query; errors aren't kept."""
    rows = answers if is_error is None else answers.where(~is_error)
    return rows.groupBy(cache_key(F.col(query)).alias("key")).agg(F.min_by(answer, order).alias("answer"))


def events_of(answers: DataFrame, request: str = "request_id", tokens: str = "tokens") -> DataFrame:
    """(request, seq, type, content): metadata, the text events of a token list in order, and the end."""
    event = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"))
    has = F.size(F.coalesce(tokens, F.array().cast("array<string>"))) > 0
    texts = F.when(has, F.transform(tokens, lambda t: event("text", t))).otherwise(F.array(event("text", F.lit(rules.NOT_FOUND_ANSWER))))
    return answers.select(F.col(request), F.posexplode(F.concat(F.array(event("metadata", has.cast("string"))), texts, F.array(event("end", F.lit(""))))).alias("seq", "_e")).select(request, "seq", "_e.type", "_e.content")


def answers_of(events: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, n_tokens, answer): text events in order as one text."""
    texts = events.where("type = 'text'").groupBy(request).agg(F.sort_array(F.collect_list(F.struct("seq", "content"))).alias("_t"))
    return texts.select(request, F.size("_t").alias("n_tokens"), F.array_join(F.transform("_t", lambda x: x["content"]), "").alias("answer"))


def chat_text(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = "%s: %s") -> DataFrame:
    """(key, n_turns, text): the turns of each conversation in order as one text."""
    line = F.format_string(template, F.coalesce(role, F.lit("")), F.coalesce(text, F.lit("")))
    rows = turns.groupBy(key).agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), line.alias("line")))).alias("_t"))
    return rows.select(key, "n_turns", F.array_join(F.transform("_t", lambda x: x["line"]), "\n").alias("text"))


def previous_turn(turns: DataFrame, key: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    return turns.withColumn("quoted", F.lag(text).over(Window.partitionBy(key).orderBy(turn)))


def healthy(spark: SparkSession) -> bool:
    """Whether executors run a task and the shared folder takes and gives back a file."""
    path = new_path(spark, "probe")
    try:
        spark.range(1).write.parquet(path)
        return spark.read.parquet(path).count() == 1
    except PySparkException:
        return False


def fanned_out(rows: DataFrame, key: str, work: Callable[[object, pd.DataFrame], dict], fields: str, timeout: float = 20.0) -> DataFrame:
    """(key, fields): what work gives for each key's rows, all keys at once by Spark's tasks; null for those that take too
    long, whose thread is left behind."""
    schema = T._parse_datatype_string(fields)
    names = schema.fieldNames()

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        pool = ThreadPoolExecutor(1)
        try:
            values = pool.submit(work, group[0], frame).result(timeout)
        except FutureTimeout:
            values = {}
        finally:
            pool.shutdown(wait=False)
        return pd.DataFrame([[group[0], *(values.get(n) for n in names)]], columns=[key, *names])

    return rows.groupBy(key).applyInPandas(run, T.StructType([rows.schema[key], *schema.fields]))


def timed(rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, float]:
    """A request's answer as a written table, and the seconds that it took."""
    began = time.perf_counter()
    out = stored(work(rows))
    return out, time.perf_counter() - began
