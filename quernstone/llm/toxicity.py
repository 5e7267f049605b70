"""Operator 1: toxicity, by a bidirectional gated recurrent network with attention pooling (see bigru.py).

The network is trained in numpy, by one task of an executor, on a bounded sample of labelled documents: of all rows
that may be learnt from and have at most TRAIN_CHARS characters, the first TRAIN_TOXIC toxic and TRAIN_CLEAN clean ones
by a hash of their id. Rows whose crc32(doc_id as text) mod 3 is 1 are held out. A score depends on the text alone: the highest probability of all its
overlapping windows of 64 words, every 32 words, over the whole text.

Null and empty texts, and texts without a word, have one empty window and so a score too. Repeated rows each get their
row. Labels that are null or of unknown documents are not used, and of contrary labels of an id toxic counts. Without
labels of both kinds all scores are the share of toxic ones (0 without any). Null ids are not held out. Columns of the
input that are named like results are replaced by them; all others pass through. An empty table gives no rows.
"""

from __future__ import annotations

import multiprocessing
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bigru
from quernstone.llm.common import read, text_slices, tidied
from quernstone.session import worker_path

THRESHOLD = 0.7
#: Bounds of the sample that the network is trained on.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1_500, 4_500, 10_000


class Constant:
    """The model without labels of both kinds."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.score)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(t, y) in a fixed order: texts and labels to learn from, bounded by TRAIN_TOXIC, TRAIN_CLEAN and TRAIN_CHARS."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.length("t") <= TRAIN_CHARS)
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("k")))
    order = F.xxhash64(F.lit("train"), F.col("k"))
    known = known.groupBy("k").agg(F.max("y").cast("int").alias("y")).join(rows.select("k"), "k", "left_semi").withColumn("h", order)
    chosen = known.where("y = 1").orderBy("h").limit(TRAIN_TOXIC).unionByName(known.where("y = 0").orderBy("h").limit(TRAIN_CLEAN))
    return rows.join(F.broadcast(chosen), "k").orderBy("h", "t").limit(TRAIN_TOXIC + TRAIN_CLEAN).select("t", "y")


def train(texts: list[str], y: list[int]):
    return bigru.train(texts, y) if 0 < sum(y) < len(y) else Constant(sum(y) / max(1, len(y)))


def trained_apart(texts: list[str], y: list[int]) -> bytes:
    """The trained model, pickled. It is trained in a process of its own, whose memory goes with it: Spark keeps workers."""
    fork = multiprocessing.get_context("fork")
    receive, send = fork.Pipe(duplex=False)

    def run() -> None:
        send.send_bytes(pickle.dumps(train(texts, y)))

    child = fork.Process(target=run)
    child.start()
    send.close()
    try:
        return receive.recv_bytes()
    except EOFError:
        raise RuntimeError("training ended without a model") from None
    finally:
        child.join()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"):
    """The model. Its bounded sample meets in one task of an executor, which trains and gives back the weights alone;
    a task that is lost runs again to the same weights."""
    worker_path(docs.sparkSession)

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for block in blocks:
            texts += block.column(0).to_pylist()
            y += block.column(1).to_pylist()
        yield from tidied(iter([pa.RecordBatch.from_pydict({"model": [trained_apart(texts, y)]})]))

    found = sample(docs, labels, key, text, label).coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Constant(0.0)


def scorer(spark: SparkSession, model):
    """A column function: the model's score of a text column."""
    shared = worker_path(spark).sparkContext.broadcast(model)  # of bounded size: rows that training met, 25 MB at most

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in tidied(columns):
            parts = [shared.value.scores(texts) for texts in text_slices(column, bigru.CHARS_AT_A_TIME)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def score_documents(df: DataFrame, model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1) and predicted (1 from the threshold on)."""
    score = scorer(df.sparkSession, model)
    out = df.withColumn("score", score(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score below the threshold, with their columns as they are."""
    score = scorer(docs.sparkSession, fit(docs, labels, key, text))
    return docs.where(score(F.col(text)) < threshold)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score_documents(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
