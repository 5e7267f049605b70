"""Operator 3: line deduplication by site-relative frequency, with DataFrame functions only.

For each host the pages that contain a line are divided by the host's pages; lines beyond the boilerplate ratio, on
enough pages, are dropped from all pages of the host. A page counts once for a line however often it repeats it.

Counts are summed before the shuffle and keyed by (host, 128 bits of the line), so that a hot host or a hot line
spreads over tasks and a task's share is one number. The lines found go to all tasks as a broadcast of checked size;
beyond it they are joined to the pages that hold them. Lines are compared without blanks, tabs and carriage returns at
their ends; blank lines are structure and never dropped, other line breaks and the remaining lines stay as they are.

A null host is a host of its own. A null text stays null. Repeated rows count as pages each. All columns pass through,
also those named like the helpers here; n_lines and n_dropped are added where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import read, stored

RATIO = 0.1
MIN_PAGES = 5
#: Boilerplate lines of all hosts together, at some 100 bytes each, up to which they are broadcast. A host has at most
#: 1 / RATIO times as many as a page of it has lines on average.
MAX_BROADCAST_LINES = 100_000


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(trimmed: Column) -> Column:
    """128 bits of a line: two hashes with different seeds."""
    return F.struct(F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit(1), trimmed).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _distinct_keys(text: Column) -> Column:
    """Keys of a text's distinct lines that aren't blank; strings are told apart by hashing, so long texts stay linear."""
    return F.transform(F.array_distinct(F.filter(F.transform(_lines(text), _trim), lambda x: x != "")), _key)


def boilerplate(df: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, pages, host_pages): keys of the lines to drop."""
    pages = df.select(F.col(host).alias("host"), F.col(text).alias("text"))
    keyed = pages.select("host", F.explode(_distinct_keys(F.col("text"))).alias("line"))
    counts = keyed.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    joined = counts.join(totals.withColumnRenamed("host", "total_host"), F.col("host").eqNullSafe(F.col("total_host")))
    return joined.where(F.col("pages") > ratio * F.col("host_pages")).select("host", "line", "pages", "host_pages")


def drop_boilerplate(df: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False, max_broadcast: int = MAX_BROADCAST_LINES) -> DataFrame:
    """df with its text rid of boilerplate lines; with n_lines and n_dropped if counts."""
    bad = stored(boilerplate(df, text, host, ratio, min_pages).select(F.col("host").alias("bad_host"), F.col("line").alias("bad_line")))
    if bad.count() <= max_broadcast:
        joined = _by_host(df, bad, host)
    else:
        joined = _by_page(df, bad, text, host)
    old = F.col("row").getField(text)
    lines = _lines(old)
    kept = F.filter(lines, lambda x: ~F.array_contains("bad_lines", _key(_trim(x))))
    new = F.when(F.col("bad_lines").isNull(), old).otherwise(F.array_join(kept, "\n"))
    out = [new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns]
    if counts:
        dropped = F.when(F.col("bad_lines").isNull(), 0).otherwise(F.size(lines) - F.size(kept))
        out += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*out)


def _rows(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def _by_host(df: DataFrame, bad: DataFrame, host: str) -> DataFrame:
    """Each row with its host's lines to drop, from a broadcast of checked size: no text is shuffled."""
    per_host = bad.groupBy("bad_host").agg(F.collect_set("bad_line").alias("bad_lines"))
    rows = df.select(_rows(df), F.col(host).alias("host"))
    return rows.join(F.broadcast(per_host), rows["host"].eqNullSafe(per_host["bad_host"]), "left")


def _by_page(df: DataFrame, bad: DataFrame, text: str, host: str) -> DataFrame:
    """The same beyond that size: distinct texts of a host, by 128 bits of the text, with the lines to drop from each."""
    seen = df.select(F.col(host).alias("host"), _key(F.col(text)).alias("page"), F.explode(_distinct_keys(F.col(text))).alias("line"))
    hit = seen.join(bad, seen["host"].eqNullSafe(bad["bad_host"]) & (seen["line"] == bad["bad_line"]))
    per_page = hit.groupBy("host", "page").agg(F.collect_set("line").alias("bad_lines")).select(F.col("host").alias("hit_host"), F.col("page").alias("hit_page"), "bad_lines")
    rows = df.select(_rows(df), F.col(host).alias("host"), _key(F.col(text)).alias("page"))
    return rows.join(per_page, rows["host"].eqNullSafe(per_page["hit_host"]) & (rows["page"] == per_page["hit_page"]), "left")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, pos, line, trim(line, E' \t\r') AS k
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), totals AS (SELECT source, count(*) AS n FROM documents GROUP BY source
), bad AS (
  SELECT l.source, l.k FROM l JOIN totals t ON l.source = t.source WHERE l.k <> ''
  GROUP BY l.source, l.k, t.n HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) > 0.1 * t.n
), marked AS (
  SELECT l.*, bad.k IS NOT NULL AS is_bad FROM l LEFT JOIN bad ON l.source = bad.source AND l.k = bad.k
)
SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_bad), '') AS text,
       count(*) AS n_lines, count(*) FILTER (is_bad) AS n_dropped
FROM marked GROUP BY doc_id, source
"""
