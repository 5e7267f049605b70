"""Operator 10: token counts by rank-synchronous array merging.

Every batch of texts becomes ragged numpy arrays of distinct pre-tokens (see bpe.py); in each round every sequence
applies its own lowest-ranked pair at all its places at once, and the surviving symbols are counted.

Null texts count as empty: no bytes, no tokens. Repeated rows and ids each give a row. Further columns pass through
untouched, except that columns named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm import bpe
from quernstone.llm.common import read, text_slices, tidied

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text that are held as arrays at a time; a longer text is a batch of its own.
BATCH_BYTES = 500_000
MAX_TOKENS = 512


def count_tokens(df: DataFrame, text: str = "text", tokenizer: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """df without its text and with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    kept = [c for c in df.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(blocks):
        encoder = bpe.encoder(path)
        for block in tidied(blocks):
            counts = [encoder.count(texts) for texts in text_slices(block.column(0), BATCH_BYTES)]
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            sizes = pc.fill_null(pc.binary_length(block.column(0)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*block.columns[1:], sizes, pa.array(counts, pa.int64())], names=[*kept, "n_bytes", "n_tokens"]
            )

    return df.select(text, *kept).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))
