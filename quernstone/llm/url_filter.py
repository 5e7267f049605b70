"""Operator 2: URL filter by a trie over reversed host labels and path segments.

A rule is an entry "host/path"; it fits its host and all subdomains if the url's path starts with the rule's path.
The longest entry that fits wins: more host labels first, then the longer path; of an allow and a block entry that
are alike, block wins. Urls that no rule fits get the default verdict.

The trie goes to the executors as a broadcast of checked size; above the bound the same answer comes from a join of
each url's possible entries with the rules. Null urls and urls without "://" have an empty host and path and get the
default verdict. Repeated rows each give a row; further columns may have any name, the result holds only the key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import read

BLOCK, ALLOW = "block", "allow"
RULES = [(BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/")]
#: Characters of all rules together up to which the trie is broadcast.
MAX_BROADCAST_CHARS = 20_000_000


class Trie:
    """Nodes are dicts: host labels from the right, then whole path segments; "" holds (rest of path, rule, verdict)."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in sorted(rules, key=lambda r: r[0] == BLOCK):  # block entries overwrite equal allow entries
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(_lower(host).split(".")):
                node = node.setdefault(("h", label), {})
            segments = (slash + path).split("/")
            for segment in segments[:-1]:
                node = node.setdefault(("p", segment), {})
            node.setdefault("", {})[segments[-1]] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest entry that fits, as (rule, verdict)."""
        best = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            best = self._path(node, segments) or best
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for i, segment in enumerate(segments):
            ends = node.get("")
            if ends:
                fits = [rest for rest in ends if segment.startswith(rest)]
                if fits:
                    best = ends[max(fits, key=len)]
            node = node.get(("p", segment)) if i + 1 < len(segments) else None
            if node is None:
                break
        return best


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host (A-Z lower-cased) and path, by column expressions."""
    rest = F.when(F.locate("://", F.col(url)) > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def judge(df: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", default: str = ALLOW, max_broadcast_chars: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """(key, host, path, rule, verdict) of each url."""
    parts = host_and_path(df.select(key, F.col(url).alias("url")), "url").select(key, "host", "path")
    if sum(len(r) for _, r in rules) > max_broadcast_chars:
        return _by_join(parts, rules, key, default)
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look_up(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        found = [find(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    out = parts.withColumn("found", look_up("host", "path"))
    return out.select(key, "host", "path", "found.rule", "found.verdict")


def _by_join(parts: DataFrame, rules: list[tuple[str, str]], key: str, default: str) -> DataFrame:
    """The same from a join of the entries that may fit each distinct url: each end of its host with each start of its path."""
    spark = parts.sparkSession
    table = spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string").select(
        "rule", "verdict", F.translate(F.regexp_extract("rule", "^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("end"), F.regexp_extract("rule", "^[^/]*(.*)", 1).alias("start")
    )
    ends = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 1000000), '.'))")
    starts = F.expr("transform(sequence(0, length(path)), i -> substring(path, 1, i))")
    urls = parts.select("host", "path").distinct()
    keys = urls.withColumn("end", F.explode(ends)).withColumn("start", F.explode(starts))
    rank = F.struct(F.length("end"), F.length("start"), (F.col("verdict") == BLOCK).cast("int"))
    best = keys.join(table, ["end", "start"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("found"))
    return parts.join(best, ["host", "path"], "left").select(key, "host", "path", "found.rule", F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), RULES)


ORACLE_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(verdict, rule, rhost, rpath) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), fits AS (
  SELECT p.host, p.path, arg_max(rule, length(rhost) * 100000 + length(rpath)) AS rule,
         arg_max(verdict, length(rhost) * 100000 + length(rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
    ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  GROUP BY p.host, p.path
)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path
"""
