"""Operator 5: exact top-k search with multi-resolution segment statistics.

Vectors are cut into segments; a segment is known by its mean and its deviation (the length of what is left of the
mean). |q - x|^2 is at least the sum over segments of L (mq - mx)^2 + (sq - sx)^2, so the inner product, which is
(|q|^2 + |x|^2 - |q - x|^2) / 2, is at most what that lower bound leaves. Bounds are taken coarse to fine; a pair
that can't reach the query's k-th best score so far goes, and exact products are computed for the survivors.

Candidates lie in blocks of alike vectors: a tree of cells over segment statistics, fitted on a bounded sample, takes
every row, and a cell's rows are cut into blocks by id. A block is known by the range of its segments' statistics, which
bounds its inner products with a query from above. A query is searched in the first block of its own cell; then only the
blocks whose bound reaches its k-th score so far meet it, so that vectors are copied for the searches that are left and
not for every pair of blocks. Each task gives at most k rows a query, and the final choice prunes again before its
shuffle. Vectors that are null or hold null or non-finite components take no part; repeated
rows are candidates as often as they come, and no row is a candidate for its own key. Score ties go to the smaller key.
A query that comes more than once is searched once, whatever the blocks. A query key with several vectors is searched
by each of them, and a candidate row counts once, by its best score.
An empty table gives an empty result. All vectors need the same length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import read, stored
from quernstone.session import worker_path

K = 20
SCALE = 64
#: Segments at each resolution, coarse to fine.
RESOLUTIONS = (2, 8, 16)
#: Candidates and queries of a task, and candidates that a task compares at a time.
TASK_CANDIDATES, TASK_QUERIES, BLOCK = 8_192, 4_096, 1_024
#: Blocks, whose ranges (400 bytes each) every task gets; beyond so many they hold more candidates.
MAX_BLOCKS = 32_768
#: Rows that the cells are fitted on, and rows of the sample that a cell has at least.
SAMPLE, LEAST_SAMPLE = 20_000, 16


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation (unnormalised) of each segment of each row, and the segments' lengths."""
    borders = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    lengths = np.diff(borders)
    means = np.add.reduceat(x, borders[:-1], axis=1) / lengths
    squares = np.add.reduceat(x * x, borders[:-1], axis=1)
    return means, np.sqrt(np.maximum(squares - lengths * means * means, 0)), lengths


def distance_bound(q: tuple, x: tuple) -> np.ndarray:
    """Lower bounds of the squared distances between all rows of q and all rows of x, from their statistics."""
    (mq, sq, lengths), (mx, sx, _) = q, x
    a = np.hstack([mq * np.sqrt(lengths), sq])
    b = np.hstack([mx * np.sqrt(lengths), sx])
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def search_block(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int = K, x_rows: np.ndarray | None = None, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query position, candidate key, score) of each query's k best candidates, ties to the smaller key; x_rows
    stand for the keys in ties and in the result where they are given. Scores below a query's least may be left out."""
    x_rows = x_ids if x_rows is None else x_rows
    exact = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) ** 2 * q.shape[1] < 2**52
    if not exact:  # products beyond the whole numbers of a double
        q, x = q.astype(np.int64), x.astype(np.int64)
    qf, xf = q.astype(float), x.astype(float)
    qn, xn = (qf * qf).sum(1), (xf * xf).sum(1)
    levels = [(segment_statistics(qf, s), segment_statistics(xf, s)) for s in RESOLUTIONS]
    best_s = np.full((len(q), k), np.iinfo(np.int64).min + 1)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    known = np.full(len(q), np.iinfo(np.int64).min + 1) if least is None else least
    order = np.argsort(-xn, kind="stable")  # long vectors first: they raise the k-th score early
    for at in range(0, len(x), BLOCK):
        part = order[at : at + BLOCK]
        floor = np.maximum(best_s[:, -1], known).astype(float)
        slack = 1e-9 * (qn[:, None] + xn[part][None, :]) + 1e-6
        half = (qn[:, None] + xn[part][None, :]) / 2 + slack - floor[:, None]
        alive = np.ones((len(q), len(part)), bool)
        if at or least is not None:
            for qs, xs in levels:
                if not alive.any():
                    break
                rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
                bound = distance_bound(tuple(v[rows] for v in qs[:2]) + qs[2:], tuple(v[part[cols]] for v in xs[:2]) + xs[2:])
                keep = np.zeros_like(alive)
                keep[np.ix_(rows, cols)] = bound / 2 <= half[np.ix_(rows, cols)]
                alive &= keep
        alive &= q_ids[:, None] != x_ids[part][None, :]
        i, j = np.nonzero(alive)
        if not len(i):
            continue
        if len(i) * 4 > alive.size:
            score = (q @ x[part].T)[i, j]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 65536]], x[part[j[a : a + 65536]]]) for a in range(0, len(i), 65536)])
        score = score.astype(np.int64)
        good = score >= np.maximum(best_s[i, -1], known[i])
        i, j, score = i[good], j[good], score[good]
        if not len(i):
            continue
        touched = np.unique(i)
        all_q = np.concatenate([np.repeat(touched, k), i])
        all_s = np.concatenate([best_s[touched].ravel(), score])
        all_i = np.concatenate([best_i[touched].ravel(), x_rows[part[j]]])
        rank = np.lexsort((all_i, -all_s, all_q))
        all_q, all_s, all_i = all_q[rank], all_s[rank], all_i[rank]
        place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
        top = place < k
        best_s[touched] = all_s[top].reshape(-1, k)
        best_i[touched] = all_i[top].reshape(-1, k)
    row, col = np.nonzero(best_i != np.iinfo(np.int64).max)
    return row, best_i[row, col], best_s[row, col]


def _features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means over all segments, then deviations, scaled so that a plain product of two bounds the inner product."""
    means, deviations, lengths = segment_statistics(x, segments)
    return np.hstack([means * np.sqrt(lengths), deviations])


class Cells:
    """A tree over segment statistics: each node halves a sample at the median of the statistic that varies most."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # feature, border, left, right; leaves are ~cell
        self.count = 0
        self.root = self._grow(_features(sample, RESOLUTIONS[1]), cells) if len(sample) else ~0

    def _grow(self, f: np.ndarray, cells: int) -> int:
        wide = int(f.var(0).argmax())
        border = float(np.median(f[:, wide]))
        low = f[:, wide] <= border
        if cells <= 1 or len(f) < 2 * LEAST_SAMPLE or low.all():
            self.count += 1
            return ~(self.count - 1)
        self.nodes.append((wide, border, 0, 0))
        at = len(self.nodes) - 1
        left = self._grow(f[low], cells // 2)
        self.nodes[at] = (wide, border, left, self._grow(f[~low], cells - cells // 2))
        return at

    def of(self, x: np.ndarray) -> np.ndarray:
        f = _features(x, RESOLUTIONS[1])
        out, open_nodes = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if node < 0:
                out[rows] = ~node
                continue
            wide, border, left, right = self.nodes[node]
            low = f[rows, wide] <= border
            open_nodes += [(left, rows[low]), (right, rows[~low])]
        return out


def block_range(x: np.ndarray) -> list[float]:
    """What block_bounds needs of a block's vectors: least and largest mean and largest deviation of each segment."""
    means, deviations = np.hsplit(_features(x.astype(float), RESOLUTIONS[-1]), 2)
    return np.concatenate([means.min(0), means.max(0), deviations.max(0)]).tolist()


def block_bounds(q: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Whole numbers that no inner product of a query with a vector of a block exceeds; shape (queries, blocks)."""
    means, deviations = np.hsplit(_features(q.astype(float), RESOLUTIONS[-1]), 2)
    low, high, dev = np.hsplit(ranges, 3)
    bound = np.hstack([np.minimum(means, 0), np.maximum(means, 0), deviations]) @ np.hstack([low, high, dev]).T
    size = np.sqrt((q.astype(float) ** 2).sum(1))[:, None] * np.sqrt(np.maximum(np.maximum(np.abs(low), np.abs(high)) ** 2, 0).sum(1) + (dev**2).sum(1))[None]
    return np.floor(bound + 1e-9 * size + 1e-6)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def _blocks(placed: DataFrame, blocks: int) -> DataFrame:
    """(block, cell, first_id, range, ids, x): rows in the order of cell and id, in stretches of about the same length."""

    def run(frames):
        rows = [f for f in frames if len(f)]
        if not rows:
            return
        rows = pd.concat(rows)
        for n, (cell, part) in enumerate(rows.groupby("cell")):
            part = part.sort_values("id", kind="stable")
            ids, x = part["id"].to_numpy(np.int64), _matrix(part["v"])
            yield pd.DataFrame({"block": [TaskContext.get().partitionId() + (n << 32)], "cell": [cell], "first_id": [ids[0]], "range": [block_range(x)], "ids": [ids.tobytes()], "x": [x.tobytes()]})

    dealt = placed.select("cell", "id", "row", "v").repartitionByRange(blocks, "cell", "id", "row")
    return stored(dealt.mapInPandas(run, "block long, cell long, first_id long, range array<double>, ids binary, x binary"))


def _searched(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(unit, query_id, vec_id, row, score): the k best of each query (unit, id, v, least) in each block it is asked of."""
    per_block = asked.groupBy("block").agg(F.count("*").alias("n")).select("block", F.ceil(F.col("n") / TASK_QUERIES).alias("parts"))
    per_block = F.broadcast(stored(per_block))  # one row a block: MAX_BLOCKS and a few
    queries = asked.join(per_block, "block").withColumn("part", F.pmod(F.xxhash64("unit"), F.col("parts"))).drop("parts")
    copies = blocks.select("block", "ids", "x").join(per_block, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"unit": [], "query_id": [], "vec_id": [], "row": [], "score": []}, dtype="int64")
        ids = np.frombuffer(right["ids"].iloc[0], np.int64)
        x = np.frombuffer(right["x"].iloc[0], np.int64).reshape(len(ids), -1)
        q_ids = left["id"].to_numpy(np.int64)
        unit, at, score = search_block(q_ids, _matrix(left["v"]).astype(float), ids, x.astype(float), k, np.arange(len(ids)), left["least"].to_numpy(np.int64))
        return pd.DataFrame({"unit": left["unit"].to_numpy(np.int64)[unit], "query_id": q_ids[unit], "vec_id": ids[at], "row": (right["block"].iloc[0] << 20) + at, "score": score})

    return queries.groupBy("block", "part").cogroup(copies.groupBy("block", "part")).applyInPandas(run, "unit long, query_id long, vec_id long, row long, score long")


def top_k(vectors: DataFrame, is_query, k: int = K, key: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row with all other rows."""
    spark = worker_path(vectors.sparkSession)
    v = F.col(embedding)
    usable = v.isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias(embedding), is_query.alias("is_query")).where(usable)
    rows = stored(rows.select("id", whole.alias("v"), F.coalesce("is_query", F.lit(False)).alias("is_query")))
    n = rows.count()
    wanted = min(MAX_BLOCKS, max(1, -(-n // TASK_CANDIDATES)))
    sample = rows.select("v").orderBy(F.xxhash64("v", "id")).limit(SAMPLE).collect() if wanted > 1 else []
    cells = spark.sparkContext.broadcast(Cells(np.array([r["v"] for r in sample], float), wanted))

    def place(frames):
        for frame in frames:
            yield frame.assign(cell=cells.value.of(_matrix(frame["v"]).astype(float)) if len(frame) else np.zeros(0, np.int64))

    placed = rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(place, "id long, v array<long>, is_query boolean, row long, cell long")
    placed = stored(placed)
    blocks = _blocks(placed, wanted)
    units = stored(placed.where("is_query").select("id", "v", "cell").distinct().withColumn("unit", F.monotonically_increasing_id()))
    least = np.iinfo(np.int64).min + 1
    home = F.broadcast(blocks.groupBy("cell").agg(F.min_by("block", F.struct("first_id", "block")).alias("block")))
    found = stored(_searched(units.join(home, "cell").select("block", "unit", "id", "v", F.lit(int(least)).alias("least")), blocks, k))
    if wanted > 1:
        known = found.groupBy("unit").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("vec_id")).alias("before"))).alias("last"))
        full = F.col("n") == k
        asked = units.join(home, "cell").join(known, "unit", "left").select("unit", "id", "v", F.col("block").alias("home"), F.when(full, F.col("last.score")).otherwise(F.lit(int(least))).alias("least"), F.when(full, -F.col("last.before")).alias("last_id"))
        about = blocks.select("block", "first_id", "range").collect()  # MAX_BLOCKS and a few
        table = spark.sparkContext.broadcast((np.array([r["block"] for r in about], np.int64), np.array([r["first_id"] for r in about], np.int64), np.array([r["range"] for r in about]).reshape(len(about), -1)))

        def ask(frames):
            number, first_id, ranges = table.value
            for frame in frames:
                for at in range(0, len(frame), BLOCK):
                    part = frame.iloc[at : at + BLOCK]
                    bound, floor = block_bounds(_matrix(part["v"]), ranges), part["least"].to_numpy(float)[:, None]
                    last = part["last_id"].fillna(np.iinfo(np.int64).max).to_numpy(float)[:, None]
                    # At an equal score only smaller ids can still come in.
                    open_to = ((bound > floor) | (bound == floor) & (first_id.astype(float)[None] <= last)) & (number[None] != part["home"].to_numpy(np.int64)[:, None])
                    i, j = np.nonzero(open_to)
                    for a in range(0, len(i), 8 * BLOCK):
                        chosen = part.iloc[i[a : a + 8 * BLOCK]]
                        yield chosen[["unit", "id", "v", "least"]].assign(block=number[j[a : a + 8 * BLOCK]])

        more = asked.mapInPandas(ask, "unit long, id long, v array<long>, least long, block long")
        found = found.unionByName(_searched(more, blocks, k))
    # A key with several vectors counts a candidate row once, by its best score.
    found = found.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score")) if _repeated(units) else found
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _repeated(units: DataFrame) -> bool:
    return not units.groupBy("id").count().where("count > 1").isEmpty()


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
