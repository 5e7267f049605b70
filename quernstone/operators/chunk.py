"""Chunking: one document, many bounded pieces, as folds over ordered units without a shuffle.

A chunker is a choice of units (sentences, numbered blocks, lines, ...), of finer units for those beyond the limit, of
what is repeated at the start of the next chunk, and of filters. Units carry their token count, so any counter fits: the
default counts words, an Arrow function over the unit list may count a model's tokens. No chunk is ever empty, none is
cut inside a word, and repeated text is left out where it would break the limit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import rules, text as T
from quernstone.functions.regex import split_before

UNIT = "array<struct<t:string,n:int,b:boolean,o:int,s:string>>"
CHUNK = "array<struct<text:string,n:int>>"
Counter = Callable[[Column], Column]
Splitter = Callable[[Column], Column]


# Splitters: text -> array of pieces without blanks around them and without empty ones.


def _clean(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Cut behind a full stop, exclamation or question mark and white space."""
    return _clean(F.split(F.regexp_replace(text, F.lit(r"([.!?])\s+"), F.lit("$1\x1f")), "\x1f"))


def legal_sentences(text: Column) -> Column:
    """Cut behind . ! ? ; and white space where a capital or a digit follows."""
    return _clean(F.split(text, r"(?<=[.!?;])\s+(?=[А-ЯA-Z0-9])"))


def words(text: Column) -> Column:
    return T.split_blanks(text)


def paragraphs(text: Column) -> Column:
    return _clean(F.split(text, r"\n\n+"))


def lines(text: Column) -> Column:
    return _clean(F.split(text, "\n"))


def numbered(mark: str) -> Splitter:
    """Cut before lines that start with a mark."""
    return lambda text: split_before(text, mark)


POINTS = numbered(r"\d+\.\s")
BLOCKS = numbered(r"\d+\.\d+\.\s|\d+\.\s")
BLOCKS_DEEP = numbered(r"\d+(?:\.\d+)*\.\s|\d+\)\s|[а-яa-zА-ЯA-Z]\)\s")
PARAGRAPH_POINTS = numbered(r"\d+(?:\.\d+)*\.\s+[А-ЯA-Z]")
DECREE_POINTS = numbered(r"\d+\.\s|\d+[¹²³]\.\s|\d+\s*\.\s")


# Units and their packing.


def units(parts: Column, count: Counter = T.count_words, repeat: int = 0, separator: str = " ") -> Column:
    """Pieces as units: t(ext), n (tokens), b(reak before), o (units repeated if a chunk begins here), s(eparator)."""
    return F.transform(parts, lambda p: F.struct(p.alias("t"), count(p).cast("int").alias("n"), F.lit(False).alias("b"), F.lit(repeat).alias("o"), F.lit(separator).alias("s"))).cast(UNIT)


def refine(us: Column, limit: Column, split: Splitter, count: Counter = T.count_words, repeat: int = 0, separator: str = " ", apart: bool = False) -> Column:
    """Units beyond the limit cut into finer ones, the first of which begins a chunk; apart: so does what follows them."""

    def all_of(x: Column) -> Column:  # x is a variable of a lambda, so the units are made once
        def one(u: Column, i: Column) -> Column:
            behind = F.when(i > 0, F.get(x, i - 1)["n"] > limit).otherwise(False) if apart else F.lit(False)
            same = F.array(F.struct(u["t"].alias("t"), u["n"].alias("n"), (u["b"] | behind).alias("b"), u["o"].alias("o"), u["s"].alias("s"))).cast(UNIT)
            finer = F.transform(split(u["t"]), lambda p, k: F.struct(p.alias("t"), count(p).cast("int").alias("n"), (k == 0).alias("b"), F.lit(repeat).alias("o"), F.lit(separator).alias("s"))).cast(UNIT)
            return F.when(u["n"] <= limit, same).otherwise(finer)

        return F.flatten(F.transform(x, one))

    return F.transform(F.array(us), all_of)[0]


def _join(us: Column) -> Column:
    """Texts with each unit's separator before it, but for the first."""
    return F.array_join(F.transform(us, lambda u, i: F.when(i == 0, u["t"]).otherwise(F.concat(u["s"], u["t"]))), "")


def _total(us: Column) -> Column:
    return F.aggregate(us, F.lit(0), lambda a, u: a + u["n"])


def pack(us: Column, limit: Column) -> Column:
    """Chunks (text, n) by a greedy fold: a unit that doesn't fit begins the next chunk, behind what it repeats.

    The fold carries places and sums, not texts, so that its cost is one step for each unit.
    """
    span = "array<struct<a:int,z:int,n:int>>"

    def all_of(x: Column) -> Column:
        begin = F.struct(F.array().cast(span).alias("done"), F.lit(0).alias("start"), F.lit(0).alias("i"), F.lit(0).alias("total"))
        close = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["start"].alias("a"), acc["i"].alias("z"), acc["total"].alias("n"))).cast(span))
        state = lambda done, start, i, total: F.struct(done.alias("done"), start.alias("start"), i.alias("i"), total.alias("total"))

        def step(acc: Column, u: Column) -> Column:
            full = (acc["i"] > acc["start"]) & (u["b"] | (acc["total"] + u["n"] > limit))
            first = F.greatest(acc["i"] - F.when(u["b"], 0).otherwise(u["o"]), acc["start"])
            tail = F.when(first < acc["i"], _total(F.slice(x, first + 1, acc["i"] - first))).otherwise(F.lit(0))
            whole = tail + u["n"] <= limit
            begun = state(close(acc), F.when(whole, first).otherwise(acc["i"]), acc["i"] + 1, F.when(whole, tail + u["n"]).otherwise(u["n"]))
            return F.when(full, begun).otherwise(state(acc["done"], acc["start"], acc["i"] + 1, acc["total"] + u["n"]))

        spans = F.aggregate(x, begin, step, lambda acc: F.when(acc["i"] > acc["start"], close(acc)).otherwise(acc["done"]))
        return F.transform(spans, lambda c: F.struct(_join(F.slice(x, c["a"] + 1, c["z"] - c["a"])).alias("text"), c["n"].alias("n"))).cast(CHUNK)

    return F.transform(F.array(us), all_of)[0]


def merge_small(chunks: Column, least: int, most: int, separator: str = "\n\n") -> Column:
    """Chunks under the least size joined with the next one, and a small last one with the one before, within most."""
    one = lambda t, n: F.struct(t.alias("text"), n.alias("n"))
    both = lambda a, b: one(F.concat(a["text"], F.lit(separator), b["text"]), (a["n"] + b["n"]).cast("int"))
    start = F.array().cast(CHUNK)

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.coalesce(last["n"], F.lit(0)) < least) & (F.coalesce(last["n"], F.lit(0)) + c["n"] <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both(last, c)))).otherwise(F.concat(acc, F.array(c))).cast(CHUNK)

    def finish(acc: Column) -> Column:
        last, before = F.element_at(acc, -1), F.try_element_at(acc, F.lit(-2))
        fits = (F.size(acc) > 1) & (last["n"] < least) & (before["n"] + last["n"] <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 2, F.lit(0))), F.array(both(before, last)))).otherwise(acc).cast(CHUNK)

    return F.transform(F.array(F.aggregate(chunks, start, step)), lambda acc: F.when(F.size(acc) > 0, finish(acc)).otherwise(acc))[0]


def exploded(df: DataFrame, chunks: Column, keep: Sequence[str]) -> DataFrame:
    """(keep, idx, text, n): a row for each chunk, numbered from 1."""
    rows = df.select(*keep, F.posexplode(chunks).alias("_i", "_c"))
    return rows.select(*keep, (F.col("_i") + 1).alias("idx"), F.col("_c.text").alias("text"), F.col("_c.n").alias("n"))


# Chunkers over a table (key, text).


def fixed_windows(df: DataFrame, key: str, text: str, size: int = 450, overlap: int = 50) -> DataFrame:
    """Windows of so many words, each beginning overlap words before the last one's end."""
    rows = df.select(F.col(key), T.split_blanks(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    rows = rows.select(key, "_w", F.posexplode(starts).alias("_i", "_s")).select(key, (F.col("_i") + 1).alias("idx"), F.slice("_w", F.col("_s") + 1, size).alias("_p"))
    return rows.select(key, "idx", F.array_join("_p", " ").alias("text"), F.size("_p").alias("n"))


def strict_sentences(df: DataFrame, key: str, text: str, limit: int = 400, count: Counter = T.count_words) -> DataFrame:
    """Sentences up to the limit; one beyond it is cut into words."""
    us = refine(units(sentences(F.col(text)), count), F.lit(limit), words, count)
    return exploded(df, pack(us, F.lit(limit)), [key])


def overlapping_sentences(df: DataFrame, key: str, text: str, limit: int = 400, repeat: int = 1, repeat_words: int = 6, count: Counter = T.count_words) -> DataFrame:
    """The same, where a chunk repeats the last sentence, or the last words of a cut one."""
    us = refine(units(sentences(F.col(text)), count, repeat), F.lit(limit), words, count, repeat_words)
    return exploded(df, pack(us, F.lit(limit)), [key])


def decree_points(df: DataFrame, key: str, text: str, limit: int = 480, least_chars: int = 50, count: Counter = T.count_words) -> DataFrame:
    """Points of a decree, each by itself; one beyond the limit by lines. Points under 50 characters are noise."""
    points = F.filter(DECREE_POINTS(F.col(text)), lambda p: F.length(p) >= least_chars)
    us = F.transform(units(points, count, separator="\n"), lambda u: F.struct(u["t"].alias("t"), u["n"].alias("n"), F.lit(True).alias("b"), u["o"].alias("o"), u["s"].alias("s"))).cast(UNIT)
    return exploded(df, pack(refine(us, F.lit(limit), lines, count, separator="\n"), F.lit(limit)), [key])


def section_points(df: DataFrame, key: str, text: str, limit: int = 400, count: Counter = T.count_words) -> DataFrame:
    """Sections by headings, their points joined up to the limit with the last one repeated; longer points by sentences."""
    sections = split_before(F.col(text), r"###\s+|\*\*[^*\n]+\*\*")
    rows = df.select(key, F.posexplode(sections).alias("section", "_t"))
    title = F.btrim(F.regexp_replace(F.substring_index("_t", "\n", 1), F.lit(r"###|\*\*"), F.lit("")))
    body = F.when(F.locate("\n", F.col("_t")) > 0, F.expr("substring(_t, locate('\n', _t) + 1)")).otherwise("")
    us = refine(units(POINTS(body), count, 1, "\n\n"), F.lit(limit), sentences, count, separator="\n")
    return exploded(rows.withColumn("title", title), pack(us, F.lit(limit)), [key, "section", "title"])


#: Versions of the legal chunker: units, finer units for long ones, repeated blocks and words, cleaning, limits.
LEGAL = {
    0: {"split": BLOCKS, "finer": (words,), "repeat": 1, "repeat_words": 20, "limit": 350, "hard": 512, "least_chars": 80, "small": 80},
    1: {"split": BLOCKS_DEEP, "finer": (paragraphs, words), "limit": 350, "hard": 500, "least_chars": 50},
    2: {"split": BLOCKS_DEEP, "finer": (paragraphs, words), "limit": 350, "hard": 500, "least_chars": 50},
    3: {"split": BLOCKS_DEEP, "finer": (paragraphs, words), "limit": 350, "hard": 500, "least_chars": 50},
    4: {"split": BLOCKS_DEEP, "finer": (paragraphs, legal_sentences), "limit": 350, "hard": 500, "least_chars": 50, "unique": True},
    5: {"split": PARAGRAPH_POINTS, "finer": (legal_sentences,), "limit": 512, "hard": 512, "least_tokens": 50, "unique": True},
}


def legal_chunks(df: DataFrame, key: str, text: str, version: int = 5, limit: int | None = None, count: Counter = T.count_words, clean: bool = True) -> DataFrame:
    """Articles' numbered blocks packed up to a limit, by version: (key, idx, text, n).

    Blocks beyond the limit stay apart from others. Chunks beyond the hard limit, too short ones, lone numbers and, in the
    later versions, repeated ones of a document are dropped; indexes count what is kept.
    """
    v = LEGAL[version]
    soft = F.lit(limit or v["limit"])
    body = T.clean_legal(F.col(text), version) if clean else F.col(text)
    us = units(v["split"](body), count, v.get("repeat", 0), "\n\n")
    for i, finer in enumerate(v["finer"]):
        us = refine(us, soft, finer, count, v.get("repeat_words", 0), "\n\n" if finer is paragraphs else " ", apart=i == 0 and version > 0)
    chunks = pack(us, soft)
    if "small" in v:
        chunks = merge_small(chunks, v["small"], limit or v["limit"])
    good = F.filter(chunks, lambda c: (c["n"] <= v["hard"]) & (c["n"] >= v.get("least_tokens", 0)) & (F.length(c["text"]) >= v.get("least_chars", 0)) & ~T.is_orphan_number(c["text"]))
    return exploded(df, F.array_distinct(good) if v.get("unique") else good, [key])


def atomic_parts(df: DataFrame, key: str, text: str, source: Column, least_chars: int = 10) -> DataFrame:
    """(key, chapter, article, idx, title, text): every numbered part of every article, under its chapter's heading."""
    sections = split_before(F.regexp_replace(F.col(text), F.lit(r"[ \t]+"), F.lit(" ")), r"###\s+Статья|#\s+Глава|Раздел\s+")
    rows = df.select(key, source.alias("_source"), F.posexplode(sections).alias("_pos", "_t"))
    head = F.substring_index("_t", "\n", 1)
    rows = rows.withColumn("_head", F.btrim(F.replace(head, F.lit("#"), F.lit("")))).withColumn("_is_chapter", F.startswith(head, F.lit("# ")) | F.startswith(head, F.lit("Раздел")))
    above = Window.partitionBy(key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_chapter", F.last(F.when(F.col("_is_chapter"), F.col("_head")), ignorenulls=True).over(above)).where(~F.col("_is_chapter"))
    number = lambda c, word: F.regexp_extract(c, rf"(?:{word})\s+(\d+)", 1)
    chapter = F.coalesce(F.nullif(number(F.coalesce("_chapter", F.lit("")), "Глава|Раздел"), F.lit("")), F.lit("0"))
    article = F.coalesce(F.nullif(number(F.col("_head"), "Статья"), F.lit("")), F.lit("info"))
    body = F.when(F.locate("\n", F.col("_t")) > 0, F.expr("substring(_t, locate('\n', _t) + 1)")).otherwise("")
    rows = rows.select(key, "_source", "_head", F.coalesce("_chapter", F.lit("Общие сведения")).alias("_chapter"), chapter.alias("chapter"), article.alias("article"), F.posexplode(POINTS(body)).alias("_i", "_p"))
    passport = F.format_string("[%s] [%s] [%s]\n%s", "_source", "_chapter", "_head", "_p")
    return rows.where(F.length("_p") >= least_chars).select(key, "chapter", "article", (F.col("_i") + 1).alias("idx"), F.substring("_head", 1, 80).alias("title"), passport.alias("text"))


def registry_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, text): rows of a registry's table that hold a code, stitched to the headings above them."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "_l")).withColumn("_l", F.btrim(F.col("_l"), F.lit(" \t\r|")))
    noise = F.col("_l") == ""
    for n in rules.REGISTRY_NOISE:
        noise = noise | F.contains("_l", F.lit(n))
    rows = rows.where(~noise)
    is_section, is_category = F.contains("_l", F.lit("Раздел")), F.contains("_l", F.lit("Должности категории"))
    is_group = F.contains(F.lower("_l"), F.lit("группа должностей"))
    above = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = lambda when, default: F.coalesce(F.last(F.when(when, F.col("_l")), ignorenulls=True).over(above), F.lit(default))
    code = F.regexp_extract("_l", r"\d+-\d+-\d+-\d+[\d.*]*", 0)
    rows = rows.select(
        key, "pos", "_l", kept(is_section, "Общие сведения").alias("_section"), kept(~is_section & is_category, "Без категории").alias("_category"), kept(~is_section & ~is_category & is_group, "Без группы").alias("_group"),
        code.alias("_code"), (is_section | is_category | is_group).alias("_heading"),
    )
    name = F.btrim(F.substring_index("_l", "|", 1))
    return rows.where("NOT _heading AND _code <> ''").select(key, "pos", F.format_string("• %s | КОД: `%s` | ГРУППА: %s | КАТЕГОРИЯ: %s | %s", name, "_code", "_group", "_category", "_section").alias("text"))


def _packed_rows(rows: DataFrame, by: list[str], limit: Column, count: Counter, separator: str = "\n") -> DataFrame:
    """Rows (by, pos, text) packed in order within each group."""
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_rows"))
    us = units(F.transform("_rows", lambda r: r["text"]), count, separator=separator)
    return exploded(listed, pack(us, limit), by)


def registry_chunks(df: DataFrame, key: str, text: str, limit: int = 450, count: Counter = T.count_words) -> DataFrame:
    return _packed_rows(registry_rows(df, key, text), [key], F.lit(limit), count)


def colon_context(df: DataFrame, key: str, text: str, limit: int = 450, count: Counter = T.count_words) -> DataFrame:
    """(key, part, context, idx, text, n): lines under the line with a colon that introduces them, else under the preamble."""
    preamble = F.btrim(F.regexp_extract(F.col(text), r"(?s)^(.*?)\n1\.\s", 1), F.lit(" \t\r\n"))
    preamble = F.when(F.length(preamble) > 150, F.concat(F.substring(preamble, 1, 147), F.lit("..."))).otherwise(preamble)
    rows = df.select(key, preamble.alias("_preamble"), F.posexplode(lines(F.col(text))).alias("pos", "text"))
    is_context = F.endswith("text", F.lit(":")) & (F.length("text") > 10)
    above = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_ctx": is_context, "part": F.sum(is_context.cast("int")).over(above), "context": F.coalesce(F.last(F.when(is_context, F.col("text")), ignorenulls=True).over(above), F.col("_preamble"))})
    return _packed_rows(rows.where("NOT _ctx"), [key, "part", "context"], F.greatest(F.lit(limit) - count(F.col("context")), F.lit(1)), count)


def method_recommendations(df: DataFrame, key: str, text: str, limit: int = 800, count: Counter = T.count_words) -> DataFrame:
    """(key, grp, kind, path, idx, text, n): points and tables whole, or by sentences beyond the limit, and plain text,
    under the path of headings above them. A path names its section, so numbering that starts anew makes new ids."""
    rows = df.select(key, F.posexplode(lines(F.regexp_replace(F.col(text), F.lit(r"[ \t]+"), F.lit(" ")))).alias("pos", "text"))
    roman = T.roman_numeral(F.col("text"))
    section = F.rlike("text", F.lit(r"^# ")) | (roman.isNotNull() & ~F.startswith("text", F.lit("#")))
    sub, table_, point = F.rlike("text", F.lit(r"^##+ ")), T.is_table_start(F.col("text")), F.rlike("text", F.lit(r"^\d+\.\s+"))
    kind = F.when(section, "section").when(sub, "sub").when(table_, "table").when(point, "point")
    above = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_kind", kind).withColumn("grp", F.count("_kind").over(above)).withColumn("kind", F.coalesce(F.last("_kind", ignorenulls=True).over(above), F.lit("text")))
    heading = T.normalize_heading(F.regexp_replace("text", F.lit(r"^#+ "), F.lit("")))
    rows = rows.withColumn("_section", F.coalesce(F.last(F.when(F.col("_kind") == "section", heading), ignorenulls=True).over(above), F.lit("Введение")))
    rows = rows.withColumn("_s", F.count(F.when(F.col("_kind") == "section", 1)).over(above))
    within = Window.partitionBy(key, "_s").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sub", F.last(F.when(F.col("_kind") == "sub", heading), ignorenulls=True).over(within))
    number = F.last(F.when(F.col("_kind") == "point", F.regexp_extract("text", r"^(\d+)\.", 1)), ignorenulls=True).over(within)
    rows = rows.withColumn("_point", F.when(F.col("kind") == "point", F.concat(F.lit("Пункт "), number)).when(F.col("kind") == "table", F.lit("Таблица")))
    rows = rows.withColumn("path", F.concat_ws(" → ", "_section", "_sub", "_point"))
    plain = F.col("kind").isin("section", "sub", "text")
    rows = rows.where(~(plain & (F.col("_kind").isNotNull() | (F.length("text") <= 20) | F.startswith("text", F.lit("**")))))
    rows = rows.withColumn("kind", F.when(plain, "text").otherwise(F.col("kind"))).withColumn("grp", F.when(plain, F.col("pos") + 1_000_000_000).otherwise(F.col("grp")))
    rows = rows.withColumn("text", F.regexp_replace(F.when(F.col("_kind") == "point", F.regexp_replace("text", F.lit(r"^\d+\.\s+"), F.lit(""))).otherwise(F.col("text")), F.lit(r"\*\*([^*]+)\*\*"), F.lit("$1")))
    listed = rows.groupBy(key, "grp", "kind", "path").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_rows"))
    whole = F.array_join(F.transform("_rows", lambda r: r["text"]), "\n")
    us = refine(units(F.array(whole), count), F.lit(limit), legal_sentences, count)
    return exploded(listed, pack(us, F.lit(limit)), [key, "grp", "kind", "path"])


def chunk_ids(df: DataFrame, prefix: str, *parts: str) -> DataFrame:
    """df with an id: the prefix, then parts in letters, digits and single underscores."""
    safe = [F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.col(p).cast("string")), F.lit("[^a-z0-9а-яё]"), F.lit("_")), F.lit("_+"), F.lit("_")), F.lit("_")) for p in parts]
    return df.withColumn("id", F.concat_ws("_", F.lit(prefix), *safe))


def audit(chunks: DataFrame, text: str = "text", count: Counter = T.count_words, most: int = 512, small: int = 150) -> DataFrame:
    """One row: number of chunks, the largest and mean size, and how many are too large or small."""
    n = count(F.col(text))
    return chunks.select(n.alias("n")).agg(F.count("*").alias("n_chunks"), F.max("n").alias("max_tokens"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.count_if(F.col("n") > most).alias("n_large"), F.count_if(F.col("n") < small).alias("n_small"))
