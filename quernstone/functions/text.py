"""Text functions as column expressions: tokenising, normalising, cleaning programs, titles and numbers, JSON repair."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions import regex, rules

TokenCounter = Callable[[Column], Column]


def _words(text: Column, least: int) -> Column:
    """Lower-case runs of so many and more Latin and basic Cyrillic letters and digits; anything else separates. One
    search for the runs: splitting by what separates takes seven times as long."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[а-яa-z0-9]{{{least},}}"), F.lit(0))


def tokenize(text: Column, stem: Callable[[Column], Column] | None = None) -> Column:
    """Tokens of two letters and more, the negation не among them; stem maps a token list (identity by default)."""
    tokens = _words(text, 2)
    return stem(tokens) if stem else tokens


def tokenize_long(text: Column, stem: Callable[[Column], Column] | None = None) -> Column:
    """The older tokeniser: tokens of three letters and more; stem as for tokenize."""
    tokens = _words(text, 3)
    return stem(tokens) if stem else tokens


def split_blanks(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """The default token counter; a model's tokenizer has the same shape, as an Arrow function."""
    return F.size(split_blanks(text))


def squeeze(text: Column) -> Column:
    """White space to one blank; four and more of the same character to one."""
    return F.regexp_replace(F.regexp_replace(text, F.lit(r"(?U)\s+"), F.lit(" ")), F.lit(r"(.)\1{3,}"), F.lit("$1"))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def guard_form(text: Column, compatible: Callable[[Column], Column] = nfkc) -> Column:
    return F.btrim(squeeze(compatible(F.lower(text))))


def rewrite_synonyms(text: Column, table: dict[str, str] | None = None) -> Column:
    """Lower-case text with synonyms replaced, longest first; a replacement may be replaced again by a shorter one."""
    out = F.lower(text)
    for key, value in sorted((table or rules.SYNONYMS).items(), key=lambda kv: -len(kv[0])):
        out = F.replace(out, F.lit(key), F.lit(value))
    return out


#: Programs of (pattern, replacement), in order. RE2-safe ones give the same in SQL.
SPACES = [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")]
LINE_ENDS = [(" ", " "), (r"\r\n?", "\n")]
MARKUP = [*LINE_ENDS, (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\]\([^)]+\)", " "), (r"(?m)^#{1,6}[ \t]*", ""), (r"(?m)^[ \t]*-[ \t]+", ""), (r"<[^>]+>", " "), *SPACES]
_JOINS = [(r"(?iu)([а-яa-z])\n-\s*([а-яa-z])", "$1$2"), (r"(?iu)([а-яa-z,;:])\n([а-яa-z])", "$1 $2")]
_EDITORIAL = [(rf"(?iu)\({word}[^)]*\)", " ") for word in ("В редакции", "Дополнение", "Утратил силу", "Наименование")]
_ORPHANS = [(r"(?miu)^\s*(?:\d+\.\s*)?Абзац\.\s*$", ""), (r"k6cl[a-zA-Z0-9:=&/?._-]+", " ")]
_LISTS = [(r"(?m)^\s*-\s*(\d+\))", "$1"), (r"(?miu)^\s*-\s*([а-яa-z]\))", "$1")]
_BASE = [*LINE_ENDS, (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\]\([^)]+\)", " "), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s*-\s+", ""), (r"<[^>]+>", " ")]
#: Cleaning of legal texts by version: each adds to the one before. A number at the very end is dropped only on demand.
LEGAL_PROGRAMS: dict[int, list[tuple[str, str]]] = {
    0: [*_BASE, *_EDITORIAL, *SPACES],
    1: [*_BASE, *_JOINS, *_EDITORIAL, *SPACES],
    2: [*_BASE, *_JOINS, *_EDITORIAL, *_ORPHANS, *SPACES],
    3: [*_BASE, *_JOINS, *_EDITORIAL, *_ORPHANS, *_LISTS, *SPACES],
    4: [*_BASE, *_JOINS, *_EDITORIAL, *_ORPHANS, *_LISTS, (r"(?m)^(\s*\d+)[ \t]+(\d+)\s*\.", "$1.$2."), *SPACES],
    5: [
        *_BASE, *_JOINS, *_EDITORIAL, *_ORPHANS, (r"(?m)^(\s*\d+)[ \t]+(\d+)\s+\.", "$1.$2."), (r"(?m)^(\s*\d+)[ \t]+(\d+)-(\d+)\s*\.", "$1.$2$3."), (r"(\d+\.\d+)\s+\.", "$1."),
        (r"(\d+)\s+(\d+)(?=\s*(?:настоящего|статьи|Кодекса|пункта|главы|части|раздела|счета|договора))", "$1.$2"), (r"(?m)^\s*(\d+(?:\.\d+)*\.)\s+", "$1 "), *_LISTS,
        (r"(\d{2,3})ФЗ", "$1-ФЗ"), (r"(?U)№\s*\n\s*(\d+-\w+)", "№ $1"), *SPACES,
    ],
}
TRAILING_NUMBER = (r"\s+(\d+(?:\.\d+)*\.?)\s*$", "")


def clean_markup(text: Column) -> Column:
    return F.btrim(regex.program(F.coalesce(text, F.lit("")), MARKUP), F.lit(" \t\r\n"))


def clean_legal(text: Column, version: int = 5, drop_trailing_number: bool = False) -> Column:
    steps = LEGAL_PROGRAMS[version] + ([TRAILING_NUMBER] if drop_trailing_number else [])
    return F.btrim(regex.program(F.coalesce(text, F.lit("")), steps), F.lit(" \t\r\n"))


NORMAL_FORMS = {
    "legal": [*LINE_ENDS, *SPACES],
    "headless": [*LINE_ENDS[:1], (r"#+", " "), *LINE_ENDS[1:], (r"(?<!\n)-\s+", "\n- "), (r"\n{3,}", "\n\n"), (r"[ \t]+", " ")],
    "numbers": [*LINE_ENDS, *SPACES, (r"(?m)^(\d+)\s+(\d+)\.", "$1.$2.")],
    "flat": [(r"(?U)\s+", " ")],
}


def normalize(text: Column, form: str = "legal") -> Column:
    return F.btrim(regex.program(F.coalesce(text, F.lit("")), NORMAL_FORMS[form]), F.lit(" \t\r\n"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def is_garbage(line: Column, titles: Iterable[str] = tuple(rules.GARBAGE_LINES), shortest: int = 2, starts: Iterable[str] = ("http",)) -> Column:
    """Lines too short to mean anything, titles of site parts, and addresses."""
    s = F.lower(F.btrim(line, F.lit(" \t\r\n")))
    out = (F.length(s) < shortest) | s.isin(*titles)
    for start in starts:
        out = out | F.startswith(s, F.lit(start))
    return out


def drop_garbage_lines(text: Column, **options) -> Column:
    return F.array_join(F.filter(lines_of(text), lambda x: ~is_garbage(x, **options)), "\n")


def is_service_line(line: Column) -> Column:
    s = F.btrim(line, F.lit(" \t\r\n"))
    return F.rlike(s, F.lit(r"(?iu)^(#+|Абзац\.|\(Статья в редакции.*\)|\(Наименование.*\))$"))


def drop_service_lines(text: Column) -> Column:
    """Lines of editing marks go; blank lines stay, as empty ones."""
    kept = F.filter(lines_of(text), lambda x: ~is_service_line(x))
    return F.array_join(F.transform(kept, lambda x: F.when(F.btrim(x, F.lit(" \t\r\n")) == "", F.lit("")).otherwise(x)), "\n")


def drop_repeated_header(text: Column) -> Column:
    """Later lines that equal the first line go."""
    lines = F.filter(F.transform(lines_of(text), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    rest = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x != lines[0])
    return F.when(F.size(lines) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), rest), "\n")).otherwise(F.lit(""))


def article_number(number: Column) -> Column:
    """The dotted form of an article's number: tags gone, blanks and dashes as dots, none at the ends."""
    return F.btrim(regex.program(number, [(r"<[^>]+>", ""), (r"-", "."), (r"\s+", "."), (r"\.+", ".")]), F.lit("."))


def split_article_number(number: Column) -> Column:
    """591 as 59.1 and 5910 as 59.10; other numbers in dotted form."""
    dotted = article_number(number)
    return F.when(F.rlike(dotted, F.lit(r"^\d{3,4}$")), F.concat(F.substring(dotted, 1, 2), F.lit("."), F.substring(dotted, 3, 2))).otherwise(dotted)


def article_title(header: Column, word: str = "Статья") -> Column:
    """struct(number, title) of a header line; null without the word and a number."""
    pattern = rf"{word}\s+([\d.\-\s]+)"
    number = article_number(F.regexp_extract(header, pattern, 1))
    rest = F.regexp_replace(F.btrim(F.regexp_replace(header, F.lit(rf"(?s)^.*?{pattern}"), F.lit(""))), F.lit(r"^\.+"), F.lit(""))
    title = F.btrim(F.concat(F.lit(word + " "), number, F.lit(". "), F.btrim(rest)))
    return F.when(F.rlike(header, F.lit(pattern)) & (number != ""), F.struct(number.alias("number"), title.alias("title")))


def is_orphan_number(text: Column, prefix: str = r"^(\[[^\]]*\]\s*)*") -> Column:
    """Whether a chunk holds nothing but a point's number behind its bracketed prefix."""
    bare = F.regexp_replace(F.regexp_replace(text, F.lit(prefix), F.lit("")), F.lit(r"\s"), F.lit(""))
    return F.rlike(bare, F.lit(r"^\d+(\.\d+)*\.?$"))


def normalize_heading(text: Column) -> Column:
    return F.btrim(regex.program(text, [(r"\*+", ""), (r"(?U)\s+", " ")]))


def roman_numeral(text: Column) -> Column:
    """The Roman number that starts a heading, or null."""
    found = F.regexp_extract(F.regexp_replace(text, F.lit(r"(?U)[^\w\s.]"), F.lit(" ")), r"^\s*([IVX]+)\.\s*", 1)
    return F.when(found != "", found)


def is_table_start(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^([Тт]аблица\s+№\s*\d+|Перечень ситуаций|[Пп]ример)"))


def document_type(text: Column, table: Iterable[tuple[str, str]] = tuple(rules.DOCUMENT_TYPES)) -> Column:
    """The first type whose pattern is found, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(list(table)):
        out = F.when(F.rlike(text, F.lit(regex.folded(pattern))), F.lit(name)).otherwise(out)
    return out


def entity_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """A name without quotes, in lower case and single blanks, by its alias if it has one."""
    plain = regex.program(F.lower(F.regexp_replace(F.btrim(name, F.lit(" \t\r\n")), F.lit("[\"«»“”']"), F.lit(""))), [(r"(?U)\s+", " ")])
    table = rules.ENTITY_ALIASES if aliases is None else aliases
    if not table:
        return plain
    lookup = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(lookup, plain), plain)


def json_object(text: Column) -> Column:
    """The outermost braces of a model's answer, rid of code fences; null if there are none or they don't parse."""
    bare = regex.program(text, [(r"```(json)?\s*", "")])
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.expr("true") & (found != "") & F.try_parse_json(found).isNotNull(), found)


def repair_chart(text: Column) -> Column:
    """The JSON between chart tags with the faults that models make mended; null if it still doesn't parse."""
    inner = F.regexp_extract(text, r"(?is)\[chart_json\](.*?)(\[/chart_json\]|$)", 1)
    mended = regex.program(inner, [(r"```(json)?", ""), (r"(?s)/\*.*?\*/", ""), (r"(?m)(?<!:)//.*$", ""), ("﻿", ""), ("'", '"'), (r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":'), (r",\s*([}\]])", "$1")])
    mended = F.btrim(mended, F.lit(" \t\r\n"))
    missing = lambda a, b: F.greatest(F.length(F.replace(mended, F.lit(b), F.lit(""))) - F.length(F.replace(mended, F.lit(a), F.lit(""))), F.lit(0)).cast("int")
    whole = F.concat(mended, F.repeat(F.lit("]"), missing("[", "]")), F.repeat(F.lit("}"), missing("{", "}")))
    whole = F.regexp_replace(whole, F.lit(r'"title"\s*:\s*("[^"]*")'), F.lit('"title":{"text":$1}'))
    return F.when((inner != "") & F.try_parse_json(whole).isNotNull(), whole)


def scrub_summary(text: Column) -> Column:
    """A summary without banned names and lead-ins; the default if 15 characters or fewer are left."""
    clean = regex.program(F.btrim(text), [(regex.unicode_classes(regex.folded(p)), rules.SUMMARY_BANNED_TO) for p in rules.SUMMARY_BANNED])
    return F.regexp_replace(F.when(F.length(clean) > 15, clean).otherwise(F.lit(rules.SUMMARY_DEFAULT)), F.lit(rules.SUMMARY_LEADS), F.lit(""))


def markdown_to_html(text: Column) -> Column:
    """Bold, bullets and headings as HTML."""
    return regex.program(text, [(r"\*\*(.*?)\*\*", "<b>$1</b>"), (r"(?m)^\s*[*\-]\s+", "• "), (r"(?m)^#+\s+(.*?)$", "<b>$1</b>")])


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"([_*\[\]()~`>#+\-=|{}.!])"), F.lit(r"\\$1"))


def chat_breaks(text: Column) -> Column:
    """The text part of an answer for a chat window: without its chart, a new line before bullets."""
    return F.regexp_replace(F.regexp_replace(text, F.lit(r"(?is)\[chart_json\].*?(\[/chart_json\]|$)"), F.lit("")), F.lit(r"(?<!\n)([•*] )"), F.lit("\n$1"))


def percent_encode(text: Column) -> Column:
    """A path part, percent-encoded; slashes stay."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
