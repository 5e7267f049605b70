"""Queries that clean texts and cut them into chunks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import rules, text as T
from quernstone.functions.regex import split_before
from quernstone.operators import chunk, dedupe
from quernstone.plans.registry import query
from quernstone.session import table

LIMIT = 60
#: Document types of the test corpus, which is in Latin script.
DOC_TYPES = [("license", "licensed under|permission is hereby"), ("secret", "token =|password|api_key"), ("table", r"\| [^|]+ \|"), ("legal", "article|section")]
HEADING_WORDS = 3


def sql_program(text: str, steps: Iterable[tuple[str, str]]) -> str:
    """A cleaning program of RE2-safe patterns in SQL."""
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$', chr(92))}', 'g')"
    return text


def sql_words(text: str) -> str:
    return rf"[x FOR x IN string_split_regex(coalesce({text}, ''), '\s+') IF x <> '']"


def sql_packed(limit: int, repeat: int, repeat_words: int) -> str:
    """Greedy packing of sentences, beyond the limit of words, as a recursion over numbered units: (doc_id, idx, text, n)."""
    return rf"""WITH RECURSIVE s AS (
  SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS pos FROM (
    SELECT doc_id, [x FOR x IN [trim(y, E' \t\r\n') FOR y IN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))] IF x <> ''] AS p FROM documents)
), w AS (SELECT doc_id, pos, t, {sql_words('t')} AS ws FROM s
), f AS (
  SELECT doc_id, pos, 0 AS sub, t, len(ws) AS n, false AS b, {repeat} AS o FROM w WHERE len(ws) <= {limit}
  UNION ALL SELECT doc_id, pos, sub, t, 1, sub = 1, {repeat_words} FROM (SELECT doc_id, pos, unnest(ws) AS t, generate_subscripts(ws, 1) AS sub FROM w WHERE len(ws) > {limit})
), u0 AS (SELECT doc_id, row_number() OVER d AS i, t, n, b, o, CAST(sum(n) OVER d AS BIGINT) AS cum FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY pos, sub)
), u AS (SELECT u.*, u.cum - u.n - coalesce(p.cum, 0) AS tail FROM u0 u LEFT JOIN u0 p ON p.doc_id = u.doc_id AND p.i = u.i - u.o - 1
), r AS (
  SELECT doc_id, i, i AS start, n AS total, 1 AS idx FROM u WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN NOT is_full THEN start WHEN b OR tail_n + n > {limit} THEN i ELSE greatest(i - o, start) END,
         CASE WHEN NOT is_full THEN total + n WHEN b OR tail_n + n > {limit} THEN n ELSE tail_n + n END, CASE WHEN is_full THEN idx + 1 ELSE idx END
  FROM (SELECT u.*, r.start, r.total, r.idx, u.b OR r.total + u.n > {limit} AS is_full, CASE WHEN r.start >= u.i - u.o THEN CASE WHEN u.o = 0 THEN 0 ELSE r.total END ELSE u.tail END AS tail_n
        FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i + 1)
), c AS (SELECT doc_id, idx, max(start) AS start, max(i) AS stop FROM r GROUP BY doc_id, idx)
SELECT c.doc_id, CAST(c.idx AS INTEGER) AS idx, string_agg(u.t, ' ' ORDER BY u.i) AS text, CAST(sum(u.n) AS INTEGER) AS n
FROM c JOIN u ON u.doc_id = c.doc_id AND u.i BETWEEN c.start AND c.stop GROUP BY c.doc_id, c.idx"""


FIXED = rf"""w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents
), c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 50, 1), 400)) AS s FROM w WHERE len(w) > 0
), chunks AS (SELECT doc_id, CAST(s // 400 + 1 AS INTEGER) AS idx, array_to_string(w[s + 1 : s + 450], ' ') AS text, CAST(len(w[s + 1 : s + 450]) AS INTEGER) AS n FROM c)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT page_id, trim({sql_program('html', T.MARKUP)}, E' \\t\\r\\n') AS text FROM pages")
def clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.clean_markup(F.col("html")).alias("text"))


@query()
def clean_legal_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest cleaning program; it looks around and refers back, which SQL's regular expressions can't."""
    return _documents(spark, sf_dir).select("doc_id", T.clean_legal(F.col("text"), 5).alias("text"))


@query(f"SELECT doc_id, trim({sql_program('text', T.NORMAL_FORMS['legal'])}, E' \\t\\r\\n') AS legal, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.normalize(F.col("text"), "legal").alias("legal"), T.normalize(F.col("text"), "flat").alias("flat"))


_GARBAGE = f"(length(s) < 2 OR s IN ({', '.join(repr(x) for x in rules.GARBAGE_LINES)}) OR starts_with(s, 'http'))"


@query(
    rf"""WITH l AS (SELECT doc_id, lower(trim(unnest(string_split(text, chr(10))), E' \t\r\n')) AS s FROM documents)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER ({_GARBAGE}) AS INTEGER) AS n_garbage FROM l GROUP BY doc_id"""
)
def garbage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir).select("doc_id", T.lines_of(F.col("text")).alias("l"))
    return lines.select("doc_id", F.size("l").alias("n_lines"), F.size(F.filter("l", lambda x: T.is_garbage(x))).alias("n_garbage"))


@query(
    r"""WITH l AS (SELECT doc_id, [x FOR x IN [trim(y, E' \t\r\n') FOR y IN string_split(text, chr(10))] IF x <> ''] AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) = 0 THEN '' ELSE array_to_string(list_concat(l[1:1], [x FOR x IN l[2:] IF x <> l[1]]), chr(10)) END AS text FROM l"""
)
def dedupe_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.drop_repeated_header(F.col("text")).alias("text"))


@query(
    r"""WITH p AS (SELECT doc_id, [x FOR x IN [trim(y, E' \t\r\n') FOR y IN string_split(regexp_replace(text, '(^|\n)([A-Z][a-z]+ )', '\1' || chr(31) || '\2', 'g'), chr(31))] IF x <> ''] AS p FROM documents)
SELECT doc_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS idx, unnest(p) AS text FROM p"""
)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections before every line that starts with a capitalised word."""
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(split_before(F.col("text"), "[A-Z][a-z]+ ")).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + 1).alias("idx"), "text")


@query(f"WITH {FIXED} SELECT doc_id, idx, text, n FROM chunks")
def chunk_fixed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.fixed_windows(_documents(spark, sf_dir), "doc_id", "text")


@query(sql_packed(LIMIT, 0, 0))
def chunk_greedy_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.strict_sentences(_documents(spark, sf_dir), "doc_id", "text", LIMIT)


@query(sql_packed(LIMIT, 1, 6))
def chunk_greedy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.overlapping_sentences(_documents(spark, sf_dir), "doc_id", "text", LIMIT)


@query(f"WITH {FIXED} SELECT count(*) AS n_chunks, max(n) AS max_tokens, round(avg(n), 6) AS mean_tokens, count(*) FILTER (n > 512) AS n_large, count(*) FILTER (n < 150) AS n_small FROM chunks")
def chunk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.audit(chunk_fixed_overlap(spark, sf_dir))


def _legal(version: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk.legal_chunks(_documents(spark, sf_dir), "doc_id", "text", version)

    return run


for _v in chunk.LEGAL:
    query(name=f"chunk_legal_v{_v}")(_legal(_v))


@query()
def chunk_decree_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.decree_points(_documents(spark, sf_dir), "doc_id", "text")


@query()
def chunk_section_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.section_points(_documents(spark, sf_dir), "doc_id", "text")


@query()
def chunk_colon_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.colon_context(_documents(spark, sf_dir), "doc_id", "text")


@query()
def chunk_method_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.method_recommendations(_documents(spark, sf_dir), "doc_id", "text")


@query(
    rf"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
), h AS (SELECT *, CASE WHEN len({sql_words('line')}) BETWEEN 1 AND {HEADING_WORDS} THEN line END AS h FROM l)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading, CAST(length(line) AS INTEGER) AS n_chars FROM h"""
)
def carry_forward_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line under the last short line above it."""
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("pos", "line"))
    above = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(T.count_words(F.col("line")).between(1, HEADING_WORDS), F.col("line")), ignorenulls=True).over(above)
    return rows.select("doc_id", "pos", heading.alias("heading"), F.length("line").alias("n_chars"))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def chunk_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.keep_first_text(_documents(spark, sf_dir).select("doc_id", "text"), "text", ["doc_id"])


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p in DOC_TYPES) + " END AS doc_type FROM documents")
def doc_type_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.document_type(F.col("text"), DOC_TYPES).alias("doc_type"))


@query(f"SELECT doc_id, {sql_program('text', [('[*][*](.*?)[*][*]', '<b>$1</b>'), (r'(?m)^\s*[*\-]\s+', '• '), (r'(?m)^#+\s+(.*?)$', '<b>$1</b>')])} AS html FROM documents")
def markdown_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.markdown_to_html(F.col("text")).alias("html"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't labelled yet."""
    return dedupe.unprocessed(_documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    """SELECT 'doc_' || doc_id AS id, text, 'chunk' AS type, NULL AS num_nodes FROM documents
UNION ALL SELECT 'community_' || source, 'Community ' || source, 'community_summary', count(*) FROM documents GROUP BY source"""
)
def summaries_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and summaries of their groups as one table."""
    docs = _documents(spark, sf_dir)
    chunks = docs.select(F.concat(F.lit("doc_"), "doc_id").alias("id"), "text", F.lit("chunk").alias("type"))
    groups = docs.groupBy("source").agg(F.count("*").alias("num_nodes"))
    summaries = groups.select(F.concat(F.lit("community_"), "source").alias("id"), F.concat(F.lit("Community "), "source").alias("text"), F.lit("community_summary").alias("type"), "num_nodes")
    return dedupe.union_all(chunks, summaries)
