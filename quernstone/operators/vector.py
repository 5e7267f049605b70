"""Exact cosine top-k of many queries over all vectors, in blocks.

Queries and candidates meet in cells of bounded size; a cell gives at most k rows a query, so what is shuffled for the
final choice grows with the number of cells and not with the pairs. Vectors that are null, hold null or have no length
take no part. All vectors need the same length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.lexical import ranked, top_places
from quernstone.session import worker_path
from quernstone.storage import stored

CELL_CANDIDATES, CELL_QUERIES = 50_000, 2_048


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_list()).astype(float)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _best_of_cell(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        q, x, ids = _unit(queries["v"]), _unit(candidates["v"]), candidates["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        out = []
        for a in range(0, len(q), 256):
            score = np.round(q[a : a + 256] @ x.T, 6)
            row, col = top_places(score, k)  # of ties the smaller ids, which come first
            out.append(pd.DataFrame({"query_id": queries["query_id"].to_numpy()[a + row], "id": ids[col], "score": score[row, col]}))
        return pd.concat(out)

    return run


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, id, score, rank); vectors: (id, v), queries: (query_id, v)."""
    worker_path(vectors.sparkSession)
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0)
    # Written first: the rows that are counted are those that are dealt.
    vectors, queries = stored(vectors.select("id", "v").where(usable)), stored(queries.select("query_id", "v").where(usable))
    cells = lambda n, size: max(1, -(-n // size))
    n, m = cells(vectors.count(), CELL_CANDIDATES), cells(queries.count(), CELL_QUERIES)
    deal = lambda parts: F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")
    copies = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    right = vectors.select(deal(n).alias("c"), "id", "v").select("*", copies(m).alias("q"))
    left = queries.select(deal(m).alias("q"), "query_id", "v").select("*", copies(n).alias("c"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(_best_of_cell(k), kinds)
    return ranked(found, k)
