"""The lexical index: postings, corpus statistics and Okapi BM25 for many queries at once.

Queries' terms are known before documents are exploded for scoring, so only matching tokens reach that shuffle. The
whole vocabulary is counted once, with partial sums, because the floor of negative weights is a mean over all terms.
An index keeps a document's postings together, so it is written without a shuffle; documents and queries meet in cells of
bounded size, which give at most k rows a query, so that pairs of documents and queries are no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import tokenize
from quernstone.session import worker_path
from quernstone.storage import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Postings and documents of a cell, and terms and queries, on average: some 100 MB of scores at most.
CELL_POSTINGS, CELL_DOCUMENTS, CELL_ASKED, CELL_QUERIES = 2_000_000, 8_192, 20_000, 1_024
Tokenizer = Callable[[Column], Column]


def tokens_of(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(id, tokens) of each document."""
    return docs.select(F.col(key).alias("id"), tokenizer(F.col(text)).alias("tokens"))


def terms_of(tokens: DataFrame, *columns: str | Column, terms: Column | None = None) -> DataFrame:
    """A row for each token. An outer explode: an inner one would have Spark tokenise each text once more, to drop
    documents without tokens beforehand."""
    return tokens.select(*columns, F.explode_outer(F.col("tokens") if terms is None else terms).alias("term")).where("term IS NOT NULL")


def postings(tokens: DataFrame) -> DataFrame:
    """(term, id, tf, dl): the inverted index, ready to be written partitioned or bucketed by term."""
    rows = terms_of(tokens, "id", F.size("tokens").alias("dl"))
    return rows.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")).select("term", "id", "tf", "dl")


def counted(tokens: DataFrame) -> DataFrame:
    """(term, df, n): the one pass over a corpus that all weights come from, as a written table.

    df is in how many documents a term occurs. The empty term stands for the corpus: its df is the number of documents
    and its n the number of tokens.
    """
    with_corpus = F.concat(F.array(F.lit("")), F.array_distinct("tokens"))
    rows = terms_of(tokens, F.size("tokens").cast("long").alias("dl"), terms=with_corpus)
    return stored(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("n")))


def index_of(tokens: DataFrame) -> DataFrame:
    """(id, dl, terms, tf): each document's postings, from which all weights and scores come. A row is made of its own
    tokens, sorted, so that no token is shuffled and a hot term is in every part of the table."""
    rows = tokens.select("id", F.size("tokens").cast("long").alias("dl"), F.sort_array("tokens").alias("_s"))
    starts = F.array_compact(F.transform("_s", lambda t, i: F.when(~F.get(F.col("_s"), i - 1).eqNullSafe(t), i)))
    rows = rows.select("id", "dl", "_s", starts.alias("_at"))
    tf = F.transform("_at", lambda at, i: F.coalesce(F.get(F.col("_at"), i + 1), F.size("_s")) - at)
    return rows.select("id", "dl", F.transform("_at", lambda at: F.get(F.col("_s"), at)).alias("terms"), tf.alias("tf"))


@dataclass(frozen=True)
class Index:
    """A corpus as written tables: postings as of index_of, and counts as of counted."""

    postings: DataFrame
    counts: DataFrame


def built(tokens: DataFrame) -> Index:
    """The index of a corpus, from one tokenisation, for any number of query batches."""
    return loaded(stored(index_of(tokens)))


def loaded(postings: DataFrame) -> Index:
    """The index of postings that are written already."""
    rows = terms_of(postings, "dl", terms=F.concat(F.array(F.lit("")), "terms"))
    return Index(postings, stored(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("n"))))


def top_places(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row, of ties at the k-th place the first columns."""
    top = min(k, score.shape[1])
    floor = -np.partition(-score, top - 1, axis=1)[:, top - 1 : top]
    hit = score >= floor
    for r in np.flatnonzero(hit.sum(1) > top):
        tied = np.flatnonzero(score[r] == floor[r])
        hit[r, tied[len(tied) - (hit[r].sum() - top) :]] = False
    return np.nonzero(hit)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Places of the values among the distinct ones, and these in order."""
    both = column.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(both.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[both.indices.to_numpy()], both.dictionary.take(order)


def _best_of_cell(k: int, k1: float, b: float):
    def run(asked: pa.Table, docs: pa.Table) -> pa.Table:
        if not asked.num_rows or not docs.num_rows:
            return pa.table({"query_id": asked["query_id"].slice(0, 0), "id": docs["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        query, queries = _coded(asked["query_id"])
        term, terms = _coded(asked["term"])
        doc, ids = _coded(docs["id"])
        lists = docs["terms"].combine_chunks()
        found = pc.index_in(lists.flatten(), value_set=terms.cast(lists.type.value_type))
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        t, row = found.drop_null().to_numpy().astype(np.int64), pc.list_parent_indices(lists).to_numpy()[hit]
        tf = docs["tf"].combine_chunks().flatten().to_numpy()[hit].astype(float)
        dl = docs["dl"].to_numpy()
        if len(ids) < len(doc):  # rows with one id and length are one document
            key, at, same = np.unique(np.stack([doc[row], dl[row].astype(np.int64), t], 1), axis=0, return_index=True, return_inverse=True)
            tf, t, row = np.bincount(same.ravel(), tf, len(key)), t[at], row[at]
        idf = np.empty(len(terms))
        idf[term] = asked["idf"].to_numpy()
        part = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / asked["avgdl"][0].as_py()))
        order, by_term, qf = np.argsort(t, kind="stable"), np.argsort(term, kind="stable"), asked["qf"].to_numpy()
        place, part = doc[row][order], part[order]
        every = np.arange(len(terms))
        ends = zip(np.searchsorted(t[order], every), np.searchsorted(t[order], every, side="right"), np.searchsorted(term[by_term], every), np.searchsorted(term[by_term], every, side="right"), strict=True)
        score = np.zeros((len(queries), len(ids)))
        for lo, hi, first, last in ends:
            if lo < hi:
                who = by_term[first:last]
                where = query[who][:, None], place[lo:hi][None]
                if len(ids) < len(doc):
                    np.add.at(score, where, qf[who][:, None] * part[lo:hi])
                else:
                    score[where] += qf[who][:, None] * part[lo:hi]
        out = []
        for a in range(0, len(score), 256):
            block = np.round(score[a : a + 256], 6)
            r, c = top_places(block, k)
            kept = block[r, c] > 0
            out.append((r[kept] + a, c[kept], block[r[kept], c[kept]]))
        r, c, best = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": queries.take(pa.array(r)), "id": ids.take(pa.array(c)), "score": best})

    return run


def indexed_top(index: Index, queries: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, id, score, rank) as of bm25_top, from an index: no text is read or tokenised again."""
    worker_path(queries.sparkSession)
    asked = stored(terms_of(queries, "query_id").groupBy("query_id", "term").agg(F.count("*").alias("qf")))
    asked = stored(asked.join(_weights(asked, index.counts), "term").select("query_id", "term", "qf", "idf", "avgdl"))
    corpus = F.col("term") == ""
    sizes = index.counts.agg(F.sum(F.when(~corpus, F.col("df"))).alias("postings"), F.max(F.when(corpus, F.col("df"))).alias("docs")).first()
    wanted = asked.agg(F.count("*").alias("terms"), F.count_distinct("query_id").alias("queries")).first()
    cells = lambda *parts: max(1, *(-(-(n or 0) // size) for n, size in parts))
    n, m = cells((sizes.postings, CELL_POSTINGS), (sizes.docs, CELL_DOCUMENTS)), cells((wanted.terms, CELL_ASKED), (wanted.queries, CELL_QUERIES))
    deal = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    copies = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    right = index.postings.select(deal("id", n).alias("c"), "id", "dl", "terms", "tf").select("*", copies(m).alias("q"))
    left = asked.select("*", deal("query_id", m).alias("q")).select("*", copies(n).alias("c"))
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {index.postings.schema['id'].dataType.simpleString()}, score double"
    return ranked(left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(_best_of_cell(k, K1, B), kinds), k)


def vocabulary(counts: DataFrame) -> DataFrame:
    """(term, df) of all terms; counts as of counted."""
    return counts.where("term <> ''").select("term", "df")


def _raw_idf(n: Column, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def corpus_stats(counts: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens, avgdl, n_terms, and floor, the weight of terms that more than half the documents hold."""
    corpus = counts.where("term = ''").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n_docs"), F.coalesce(F.max("n"), F.lit(0)).alias("n_tokens"))
    # The sum of the raw weights needs the number of documents: terms are counted by df first, a short table.
    by_df = vocabulary(counts).groupBy("df").agg(F.count("*").alias("n"))
    weights = by_df.crossJoin(F.broadcast(corpus)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms"), F.sum(F.col("n") * _raw_idf(F.col("n_docs"), F.col("df"))).alias("raw"))
    return corpus.crossJoin(weights).select(  # one row by one row
        "n_docs", "n_tokens", F.try_divide("n_tokens", "n_docs").alias("avgdl"), "n_terms", F.try_divide(F.lit(EPSILON) * F.col("raw"), F.col("n_terms")).alias("floor")
    )


def inverse_frequencies(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf); negative weights become the floor."""
    raw = _raw_idf(F.col("n_docs"), F.col("df"))
    return terms.crossJoin(F.broadcast(stats)).select("term", "df", F.when(raw < 0, F.col("floor")).otherwise(raw).alias("idf"))  # stats is one row


def bm25(tokens: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, counts: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of all documents that share a term with a query; queries: (query_id, tokens).

    A term that a query repeats counts as often. counts: those of the corpus, if they are there already.
    """
    counts = counted(tokens) if counts is None else counts
    wanted = stored(terms_of(queries, "query_id").select("term").distinct())
    # Dealt by document once: counting terms and summing scores both happen where a document's tokens are.
    rows = terms_of(tokens, "id", F.size("tokens").alias("dl")).join(wanted, "term", "left_semi").repartition("id")
    return _scores(rows.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), queries, counts, k1, b)


def _weights(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, df, idf, avgdl) of the terms of asked."""
    stats = corpus_stats(counts)
    return inverse_frequencies(vocabulary(counts).join(asked.select("term").distinct(), "term", "left_semi"), stats).crossJoin(F.broadcast(stats.select("avgdl")))


def _scores(found: DataFrame, queries: DataFrame, counts: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) from postings (term, id, tf, dl)."""
    # A written table has a known size: where the questions' terms are few, the corpus's tokens aren't shuffled to meet them.
    asked = stored(terms_of(queries, "query_id").groupBy("query_id", "term").agg(F.count("*").alias("qf")))
    weights = stored(_weights(asked, counts))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = found.join(weights, "term").select("id", "term", part.alias("part"))
    return weighed.join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("qf") * F.col("part")), 6).alias("score"))


def ranked(scores: DataFrame, k: int, group: str = "query_id", key: str = "id") -> DataFrame:
    """The k best of each group with their rank from 1, ties to the smaller key; pruned before the shuffle."""
    best = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def bm25_top(tokens: DataFrame, queries: DataFrame, k: int = 30, counts: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k best documents with a positive score."""
    return ranked(bm25(tokens, queries, counts=counts).where("score > 0"), k)
