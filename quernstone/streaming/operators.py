"""Streams: duplicate suppression, a cache with expiry, throttled snapshots, answers put together, cached replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.operators.serving import cache_key
from quernstone.session import worker_path
from quernstone.storage import new_path

SEEN_KEYS = 2_000
TTL_SECONDS = 30.0


def first_of_keys(stream: DataFrame, keys: Sequence[str], ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; with a time column, keys are forgotten once the watermark has passed them."""
    if ts is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def _stateful(stream: DataFrame, by: Sequence[str], state: str, step: Callable[[tuple, pd.DataFrame, Any], tuple[pd.DataFrame, tuple]], schema: T.StructType, idle: float | None) -> DataFrame:
    """step(key, rows of a batch, state or None) -> (rows out, new state), for each key. The state of a key that has no
    rows for idle seconds of processing goes; a stream with such a limit runs until it is stopped, also when it is asked
    for what is available now."""
    worker_path(stream.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True)
        out, new = step(key, rows, held.get if held.exists else None)
        held.update(new)
        if idle is not None:
            held.setTimeoutDuration(max(1, round(idle * 1000)))
        yield out

    return stream.groupBy(*by).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


def first_of_last_keys(stream: DataFrame, by: str, key: str, order: str, most: int = SEEN_KEYS, idle: float | None = None) -> DataFrame:
    """Rows whose key isn't among the last so many new keys of their group, first in, first out; a group that is idle for
    so many seconds, if given, is forgotten."""

    def step(_, rows: pd.DataFrame, held) -> tuple[pd.DataFrame, tuple]:
        seen = list(held[0]) if held else []
        there, keep = set(seen), []
        for k in rows.sort_values(order, kind="stable")[key].astype(str):
            keep.append(k not in there)
            if keep[-1]:
                seen.append(k)
                there.add(k)
                if len(seen) > most:
                    there.discard(seen.pop(0))
        return rows.sort_values(order, kind="stable")[keep], (seen,)

    return _stateful(stream, [by], "seen array<string>", step, stream.schema, idle)


def refreshed(times: Sequence[float], ttl: float, last: float | None = None) -> list[float]:
    """For each time in order the time of the value that a cache serves: the last refresh, or now if that is ttl old."""
    out = []
    for t in times:
        if last is None or t - last >= ttl:
            last = t
        out.append(last)
    return out


def with_cache_expiry(stream: DataFrame, by: str, ts: str, value: str, ttl: float = TTL_SECONDS, tie: str | None = None, idle: float | None = None) -> DataFrame:
    """Rows with served_value and served_at: each key's value as of its last refresh. An age counts from the refresh, not
    from the last hit. A key that is idle for so many seconds, if
    given, is forgotten; ttl or more loses nothing."""
    kind = stream.schema[value].dataType
    schema = T.StructType([*stream.schema.fields, T.StructField("served_value", kind), T.StructField("served_at", T.TimestampType())])
    state = f"at bigint, value {kind.simpleString()}"

    def step(_, rows: pd.DataFrame, held) -> tuple[pd.DataFrame, tuple]:
        rows = rows.sort_values([ts, *([tie] if tie else [])], kind="stable").reset_index(drop=True)
        micros = rows[ts].astype("datetime64[us]").astype("int64")
        at = refreshed(micros.tolist(), round(ttl * 1e6), held[0] if held else None)
        known = {held[0]: held[1]} if held else {}
        values = []
        for own, now, v in zip(at, micros.tolist(), rows[value].tolist(), strict=True):
            if own == now and own not in known:
                known[own] = v
            values.append(known[own])
        out = rows.assign(served_value=values, served_at=pd.Series(at).astype("datetime64[us]"))
        return out, (at[-1], known[at[-1]])

    return _stateful(stream, [by], state, step, schema, idle)


def last_in_window(rows: DataFrame, ts: str, width: str, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(by, start, value): the last value of each tumbling window, a throttle that lets one snapshot through."""
    return rows.groupBy(*by, F.window(ts, width).alias("_w")).agg(F.max_by(value, F.struct(*order)).alias(value)).select(*by, F.col("_w.start").alias("start"), value)


def joined_tokens(rows: DataFrame, by: str, seq: str, token: str, separator: str = "") -> DataFrame:
    """(by, n, text): tokens in order as one text."""
    listed = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(token).alias("t")))).alias("_l"))
    return listed.select(by, F.size("_l").alias("n"), F.array_join(F.transform("_l", lambda x: F.coalesce(x["t"], F.lit(""))), separator).alias("text"))


def with_cached_answers(requests: DataFrame, cache: DataFrame, query: str = "query") -> DataFrame:
    """A stream of requests joined to the static cache (key, answer)."""
    return requests.join(cache.withColumnRenamed("key", "_key"), cache_key(F.col(query)) == F.col("_key"), "left").drop("_key")


def windowed_counts(rows: DataFrame, ts: str, width: str, slide: str | None = None, by: Sequence[str] = (), delay: str = "10 minutes") -> DataFrame:
    """(by, start, n) by event time, tumbling or sliding; rows later than the watermark are left out."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.withWatermark(ts, delay).groupBy(*by, window.alias("_w")).agg(F.count("*").alias("n")).select(*by, F.col("_w.start").alias("start"), "n")


def session_counts(rows: DataFrame, ts: str, gap: str, by: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(ts, delay).groupBy(*by, F.session_window(ts, gap).alias("_w")).agg(F.count("*").alias("n")).select(*by, F.col("_w.start").alias("start"), "n")


def append_once(stream: DataFrame, path: str | None = None) -> DataFrame:
    """All that is there now, as a written table (append mode, checkpointed in the shared folder)."""
    spark = stream.sparkSession
    path = path or new_path(spark, "stream")
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def complete_once(stream: DataFrame, path: str | None = None) -> DataFrame:
    """The whole result of a streaming aggregate, rewritten by each batch."""
    spark = stream.sparkSession
    path = path or new_path(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(path)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    run = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def keep_cache(answers: DataFrame, path: str, key: str = "key", answer: str = "answer", is_error: Column | None = None):
    """A stream of answers written to the response cache, errors left out; a later answer doesn't replace the first."""
    from quernstone.operators.dedupe import keep_first

    def write(batch: DataFrame, number: int) -> None:
        good = batch if is_error is None else batch.where(~is_error)
        fresh = keep_first(good.select(key, answer), [key], [answer])
        try:
            fresh = fresh.join(batch.sparkSession.read.parquet(path), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return answers.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint")


def audited(df: DataFrame, name: str, tokens: str) -> DataFrame:
    """df, which also reports rows and tokens to listeners under a name, without another pass."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.sum(tokens).alias("tokens"))


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet file or folder of the batch tables as a stream."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only by a pattern that matches it
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
