"""Streaming queries, run over all that the tables hold now; their SQL is the same in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import serving
from quernstone.plans.registry import query
from quernstone.session import table
from quernstone.streaming import operators as S

TTL = 6 * 3600.0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; event times without a zone become UTC instants, as watermarks need."""
    return S.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.append_once(S.first_of_keys(_events(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"]))


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_dedupe_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates among the last 2,000 keys of each user."""
    rows = _events(spark, sf_dir).select("user_id", "event_id")
    return S.append_once(S.first_of_last_keys(rows, "user_id", "event_id", "event_id"))


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), r AS (SELECT user_id, event_id, i, t AS at, value AS served FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t - r.at >= {TTL} THEN e.t ELSE r.at END, CASE WHEN e.t - r.at >= {TTL} THEN e.value ELSE r.served END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, served AS served_value FROM r"""
)
def stream_ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that a cache of six hours would serve each user at each event."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts", "value")
    return S.append_once(S.with_cache_expiry(rows, "user_id", "ts", "value", TTL, "event_id")).select("user_id", "event_id", "served_value")


@query(
    """SELECT user_id, CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS start, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL"""
)
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each user and day."""
    last = S.last_in_window(_events(spark, sf_dir), "ts", "1 day", ["user_id"], ["ts", "event_id"], "value")
    return S.complete_once(last).select("user_id", F.unix_timestamp("start").alias("start"), "value")


@query("SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.complete_once(S.windowed_counts(_events(spark, sf_dir), "ts", "1 hour", by=["event_type"])).select("event_type", F.unix_timestamp("start").alias("start"), "n")


@query("SELECT conv_id, CAST(count(*) AS INTEGER) AS n, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def stream_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table_stream(spark, f"{sf_dir}/conversations.parquet")
    return S.complete_once(S.joined_tokens(rows, "conv_id", "turn", "text", " "))


@query(
    """WITH c AS (SELECT lower(trim(text)) AS key, arg_min(conv_id, conv_id * 1000 + turn) AS answer FROM conversations WHERE role = 'user' GROUP BY ALL)
SELECT conv_id, turn, answer AS first_conv FROM conversations LEFT JOIN c ON key = lower(trim(text))"""
)
def stream_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of turns with the first conversation that asked the same."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    cache = serving.cache_of(asked.select(F.col("text").alias("query"), F.col("conv_id").alias("answer"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")))
    rows = S.table_stream(spark, f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return S.append_once(S.with_cached_answers(rows, cache, "text")).select("conv_id", "turn", F.col("answer").alias("first_conv"))
