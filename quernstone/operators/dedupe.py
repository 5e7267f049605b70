"""Keeping first rows, set differences against what is done, and unions of unlike tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group in an order: a window whose rows are pruned before the shuffle."""
    first = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")


def keep_first_text(df: DataFrame, text: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The same for long texts: groups are found by 128 bits of the text, so the texts themselves aren't sort keys."""
    keyed = df.withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text)})
    return keep_first(keyed, [*by, "_h1", "_h2"], order).drop("_h1", "_h2")


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet; null keys are never done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def resume(df: DataFrame, done: DataFrame, key: str, work) -> DataFrame:
    """What is done, and the work on what isn't."""
    return done.unionByName(work(unprocessed(df, done, key)), allowMissingColumns=True)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all tables by column name; columns that a table lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
