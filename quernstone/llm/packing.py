"""Operator 6: packing by non-negative least squares.

Token sequences (ids and an end id) are cut into full windows and one rest. Rests are counted by length, in steps of
UNIT tokens rounded up; shallow combinations of lengths that fill a window are enumerated, the repeat count of each is
solved against the histogram by non-negative least squares and rounded down, and what is left is packed greedily, most
frequent long lengths first, still by counts. Only the histogram (at most MAX / UNIT + 1 rows) comes to the driver.

Each piece then gets its rank within its length; ranks are split over salted groups, so that a length that holds a
third of all pieces is not one task. Rank and plan give the sequence; offsets are sums over the few pieces of one.

Null texts count as empty: they hold the end id alone. Repeated rows and ids are packed as often as they come. An
empty table gives no sequences. A null doc_id is kept. Any further columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm import bpe
from quernstone.llm.common import read, stored, text_slices, tidied

TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS = 2048
END_ID = 1
UNIT = 8
#: Lengths of a combination at most, and combinations that the solver holds at most.
DEPTH, MAX_COLUMNS = 3, 6_000
#: Pieces of one length that a ranking task is meant to hold.
RANK_ROWS = 50_000
#: Bytes of text that are encoded at a time; a longer text is encoded alone.
BATCH_BYTES = 500_000


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): full windows and the rest of each document."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    kind = df.schema[key].dataType.simpleString()

    def run(blocks):
        encoder, end = bpe.encoder(path), np.array([end_id], "<u4").tobytes()
        for block in tidied(blocks):
            row, start, length, crc, tokens = [], [], [], [], []
            at = 0
            for texts in text_slices(block.column(1), BATCH_BYTES):
                ids, ends = encoder.encode(texts)
                data, ends = memoryview(ids.astype("<u4", copy=False).tobytes()), ends.tolist()
                for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    total = hi - lo + 1
                    for s in range(0, total, max_tokens):
                        n = min(max_tokens, total - s)
                        last = s + n == total
                        c = zlib.crc32(data[4 * (lo + s) : 4 * (lo + s + n - last)])
                        row.append(at + i)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(end, c) if last else c)
                        tokens.append(total)
                at += len(texts)
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([block.column(0).take(long(row)), long(start), long(length), long(crc), long(tokens)], names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(lengths: list[int], window: int, depth: int = DEPTH, most: int = MAX_COLUMNS) -> list[tuple[int, ...]]:
    """Combinations of up to depth lengths that fill a window; with fewer lengths first."""
    there, out = set(lengths), []
    for d in range(1, depth + 1):
        for head in combinations_with_replacement(sorted(lengths, reverse=True), d - 1):
            last = window - sum(head)
            if last in there and (not head or last <= head[-1]):
                out.append((*head, last))
                if len(out) >= most:
                    return out
    return out


def solve(columns: np.ndarray, b: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Non-negative least squares by projected gradient steps with momentum and restarts.

    columns: the rows that each column of the matrix has a one in, a row as often as its entry says; len(b) is padding.
    """
    depth, n = columns.shape[1], len(b)
    apply = lambda y: np.bincount(columns.ravel(), np.repeat(y, depth), n + 1)[:n]
    back = lambda r: np.append(r, 0.0)[columns].sum(1)
    v = np.ones(len(columns))
    for _ in range(30):  # the largest eigenvalue of the matrix times its transpose
        v = back(apply(v))
        v /= max(np.linalg.norm(v), 1e-300)
    step = 0.98 / max(1e-9, np.linalg.norm(apply(v)) ** 2)
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        slope = back(apply(y) - b)
        new = np.maximum(0, y - step * slope)
        if slope @ (new - x) > 0:  # momentum that leads uphill starts anew
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that use up the histogram of lengths."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def use(combo: tuple[int, ...], n: int) -> None:
        if n > 0:
            out.append((combo, n))
            for k in combo:
                left[k] -= n

    lengths = sorted(left)
    columns = combinations(lengths, window)
    if columns:
        where = {k: i for i, k in enumerate(lengths)}
        a = np.full((len(columns), DEPTH), len(lengths))
        for j, c in enumerate(columns):
            a[j, : len(c)] = [where[k] for k in c]
        # In shares of all pieces, so that the steps are alike at every size.
        b = np.array([left[k] for k in lengths], float)
        x = solve(a, b / b.sum()) * b.sum()
        for j in np.argsort(-x, kind="stable").tolist():
            combo = columns[j]
            use(combo, min(int(x[j] + 1e-6), *(left[k] // combo.count(k) for k in combo)))
    # What is left: the longest length, then the longest that fit, as often as the counts allow.
    while lengths := sorted((k for k, v in left.items() if v > 0), reverse=True):
        combo, room = [], window
        for k in lengths:
            n = min(room // k, left[k])
            combo += [k] * n
            room -= k * n
        use(tuple(combo), min(left[k] // combo.count(k) for k in set(combo)))
    return out


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of ranks: first rank, first sequence, pieces of this length in one sequence, place of the first."""
    runs: dict[int, list] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for combo, n in made:
        for k in dict.fromkeys(combo):
            each = combo.count(k)
            runs.setdefault(k, []).append((next_rank.get(k, 0), sequence, each, combo.index(k)))
            next_rank[k] = next_rank.get(k, 0) + n * each
        sequence += n
    return {k: tuple(np.array(v, np.int64).T) for k, v in runs.items()}


def pack(parts: DataFrame, max_tokens: int = MAX_TOKENS, unit: int = UNIT) -> DataFrame:
    """parts with sequence_id and offset; parts needs a length from 1 to max_tokens."""
    spark = parts.sparkSession
    parts = stored(parts.withColumn("_bin", F.ceil(F.col("length") / unit).cast("int")).withColumn("_at", F.monotonically_increasing_id()))
    histogram = {r["_bin"]: r["n"] for r in parts.groupBy("_bin").agg(F.count("*").alias("n")).collect()}  # by length, bounded
    salts = max(1, -(-max(histogram.values(), default=0) // RANK_ROWS), min(64, sum(histogram.values()) // 4096))
    parts = parts.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(salts)).cast("int"))
    per_salt = parts.groupBy("_bin", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_bin").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = per_salt.select("_bin", "_salt", F.coalesce(before, F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_bin", "_salt").orderBy("_at")) - 1
    ranked = parts.withColumn("_local", local).join(bases, ["_bin", "_salt"]).withColumn("_rank", F.col("_local") + F.col("_base"))
    table = spark.sparkContext.broadcast(slots(plan(histogram, max_tokens // unit)))

    @F.pandas_udf("sequence_id long, place long")
    def seat(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        lengths, ranks = lengths.to_numpy(), ranks.to_numpy()
        for k in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == k)
            first, start, each, where = table.value[k]
            run = np.searchsorted(first, ranks[at], side="right") - 1
            since = ranks[at] - first[run]
            sequence[at] = start[run] + since // each[run]
            place[at] = where[run] + since % each[run]
        return pd.DataFrame({"sequence_id": sequence, "place": place})

    seated = ranked.withColumn("_seat", seat("_bin", "_rank")).withColumn("sequence_id", F.col("_seat.sequence_id")).withColumn("_place", F.col("_seat.place"))
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    return seated.withColumn("offset", F.coalesce(ahead, F.lit(0))).drop("_bin", "_at", "_salt", "_local", "_base", "_rank", "_seat", "_place")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    return pack(pieces(df, key, text, **options)).select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
