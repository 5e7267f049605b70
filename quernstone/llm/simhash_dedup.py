"""Operator 9: SimHash near-duplicates by tiled exact comparison.

Fingerprints: one bit is set if it is set in over half the XXH64 values of a text's word shingles. Distinct
fingerprints are dealt to tiles by their population count, in large sets by the population counts of several segments of
their bits. The counts of two fingerprints within the radius differ by no more than the radius in sum, so tile pairs
further apart are skipped; the others are compared by numpy exclusive-or and bit counts. Inside a tile pair the bits are
cut into one block more than the radius: fingerprints within the radius are equal in one of them, so that only sub-tiles
of equal blocks are compared, and large sub-tiles are cut again by the bits that are left. Where fingerprints spread, one
meets some 300 of a full tile; where they don't, more, and no pair within the radius is missed.

A tile pair gives a spanning forest of its links instead of all links, so that a group of n copies gives n rows; inside a
large sub-tile what is linked already isn't compared again. A
fingerprint's rows are counted before they meet, and fingerprints of many rows get their component by a broadcast of
checked size, so that no group of copies goes through one task.

Null and empty texts have no words: fingerprint zero, linked like any other. Ties are by the smaller id. Rows are linked,
not ids: unlike texts of one id stay apart. Rows without an id take no part in linking; op9's result holds them with a
null component, and drop_near_duplicates keeps them, as they can't be named as a copy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import bounded, read, stored, text_slices, tidied
from quernstone.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Distinct fingerprints that a tile is meant to hold at most; sets with more are dealt by more segments.
TILE_ROWS = 1 << 19
#: Rows from which a fingerprint's rows are hot: they get their component by broadcast. There are at most one in so many
#: as there are rows, and no more than MAX_HOT.
HOT_ROWS, MAX_HOT = 10_000, 100_000
#: Pairs that are compared at a time; a sub-tile of more is large.
BLOCK = 1 << 20
#: Keys, at 8 bytes and a hash entry each, up to which those that go are broadcast.
MAX_BROADCAST_KEYS = 1_000_000
#: Bytes of text that are held as strings at a time.
BATCH_BYTES = 1_000_000


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the words between ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, k, digest = b" ".join(words), words_per_shingle, xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.append(0, ends[:-1])[: len(words) - k + 1].tolist()
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(begin, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype("<u8", copy=False)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """(key, fp, more) of each row; fp is the fingerprint as a signed 64-bit number."""
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType()), *(df.schema[c] for c in more)])

    def run(blocks):
        for block in tidied(blocks):
            values = np.array([fingerprint(t) for texts in text_slices(block.column(1), BATCH_BYTES) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(values), *block.columns[2:]], names=[key, "fp", *more])

    return df.select(key, text, *more).mapInArrow(run, schema)


def segments_of(n: int, tile_rows: int, most: int = 8) -> int:
    """The fewest segments by whose population counts the fullest tile of n random fingerprints has no more rows than that."""
    for k in range(1, most):
        widths = [64 // k + (i < 64 % k) for i in range(k)]
        if n * math.prod(math.comb(w, w // 2) / 2**w for w in widths) <= tile_rows:
            return k
    return most


def _steps(segments: int, radius: int) -> np.ndarray:
    """All whole vectors of so many places whose absolute values sum to the radius at most."""
    out = [[]]
    for _ in range(segments):
        out = [[*v, d] for v in out for d in range(-radius, radius + 1) if sum(map(abs, v)) + abs(d) <= radius]
    return np.array(out, np.int64)


def _deal(radius: int, segments: int):
    """Each (fp, rep) to every tile pair in which its tile takes part; a tile is its segments' counts, 7 bits each."""
    steps = _steps(segments, radius)
    widths = np.array([64 // segments + (i < 64 % segments) for i in range(segments)])
    lows = np.cumsum(widths) - widths
    places = 7 * np.arange(segments)

    def run(frames):
        for frame in frames:
            fp, rep = frame["fp"].to_numpy(np.int64), frame["rep"].to_numpy()
            bits = fp.view(np.uint64)
            counts = np.column_stack([np.bitwise_count((bits >> np.uint64(low)) & np.uint64((1 << int(w)) - 1)) for low, w in zip(lows, widths, strict=True)]).astype(np.int64)
            own = (counts << places).sum(1)
            for step in steps:
                near = counts + step
                ok = ((near >= 0) & (near <= widths)).all(1)
                mine, other = own[ok], (near[ok] << places).sum(1)
                yield pd.DataFrame({"t1": np.minimum(mine, other), "t2": np.maximum(mine, other), "first": mine <= other, "fp": fp[ok], "rep": rep[ok]})

    return run


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, trees=None):
    """Index pairs (i, j) of all a[i], b[j] within the radius, in blocks; a pair may come more than once.

    trees(i, j) gives the trees of a[i] and of b[j], if the caller joins the pairs as they come: then pairs of one tree
    may be left out.
    """
    if len(a) and len(b):
        yield from _sub_tiles(a, b, np.arange(len(a)), np.arange(len(b)), np.arange(64), radius, trees)


def _sub_tiles(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, places: np.ndarray, radius: int, trees):
    """close_pairs of a[ia], b[ib], which differ in these places only."""
    whole = len(ia) * len(ib)
    if whole <= BLOCK or len(places) <= radius:
        yield from _compared(a, b, ia, ib, radius, trees)
        return
    blocks = np.array_split(places, radius + 1)
    masks = [np.bitwise_or.reduce(np.uint64(1) << block.astype(np.uint64)) for block in blocks]
    if len(places) < 64 and sum(_meetings(a[ia] & mask, b[ib] & mask) for mask in masks) > whole // 2:
        yield from _compared(a, b, ia, ib, radius, trees)
        return
    for block, mask in zip(blocks, masks, strict=True):
        ka, kb = a[ia] & mask, b[ib] & mask
        oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        ka, kb, ja, jb = ka[oa], kb[ob], ia[oa], ib[ob]
        starts = np.flatnonzero(np.append(True, ka[1:] != ka[:-1]))
        sizes = np.diff(np.append(starts, len(ka)))
        lo, hi = np.searchsorted(kb, ka[starts]), np.searchsorted(kb, ka[starts], "right")
        large = sizes * (hi - lo) > BLOCK
        for s, n, p, q in zip(starts[large], sizes[large], lo[large], hi[large], strict=True):
            yield from _sub_tiles(a, b, ja[s : s + n], jb[p:q], np.setdiff1d(places, block), radius, trees)
        # The others, many at a time: row r meets the places lo to lo + wide of the other side.
        lo, wide = np.repeat(lo, sizes), np.repeat(np.where(large, 0, hi - lo), sizes)
        ends, at = np.cumsum(wide), 0
        while at < len(wide):
            done = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
            some = wide[at:end]
            rows = np.repeat(np.arange(at, end), some)
            cols = np.arange(len(rows)) + np.repeat(lo[at:end] - (ends[at:end] - some - done), some)
            i, j = ja[rows], jb[cols]
            hit = np.bitwise_count(a[i] ^ b[j]) <= radius
            if hit.any():
                yield i[hit], j[hit]
            at = end


def _meetings(ka: np.ndarray, kb: np.ndarray) -> int:
    """Pairs of equal keys."""
    (ka, na), (kb, nb) = np.unique(ka, return_counts=True), np.unique(kb, return_counts=True)
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    return int((na[i] * nb[j]).sum())


def _compared(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, radius: int, trees):
    """close_pairs of a[ia], b[ib], all against all but, in a large sub-tile, what is in one tree."""
    large = trees is not None and len(ia) * len(ib) > BLOCK
    if large:
        ia = ia[np.argsort(trees(ia, ib[:0])[0], kind="stable")]
    step = max(1, BLOCK // len(ib))
    for r in range(0, len(ia), step):
        rows, cols = ia[r : r + step], ib
        if large:
            mine, others = trees(rows, cols)
            if (mine == mine[0]).all():
                cols = cols[others != mine[0]]
        for c in range(0, len(cols), BLOCK):
            part = cols[c : c + BLOCK]
            i, j = np.nonzero(np.bitwise_count(a[rows][:, None] ^ b[part][None, :]) <= radius)
            if len(i):
                yield rows[i], part[j]


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The roots of x, which become their parents."""
    own = x
    while True:
        up = parent[x]
        if (up == x).all():
            parent[own] = x
            return x
        x = up


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j; smaller positions become roots."""
    while len(i):
        i, j = _root(parent, i), _root(parent, j)
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def _forest(radius: int):
    """Links of a tile pair, as edges from each fingerprint to the smallest representative it is linked to."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", kind="stable")
        fp, rep = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["rep"].to_numpy()
        same = frame["t1"].iloc[0] == frame["t2"].iloc[0]
        first = frame["first"].to_numpy(bool)
        left = np.arange(len(fp)) if same else np.flatnonzero(first)
        right = left if same else np.flatnonzero(~first)
        parent = np.arange(len(fp))
        trees = lambda i, j: (_root(parent, left[i]), _root(parent, right[j]))
        for i, j in close_pairs(fp[left], fp[right], radius, trees):
            _union(parent, left[i], right[j])
        root = _root(parent, np.arange(len(fp)))
        linked = root != np.arange(len(fp))
        return pd.DataFrame({"a": rep[linked], "b": rep[root[linked]]})

    return run


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) between representatives of distinct fingerprints (fp, rep) that connect what is within the radius."""
    segments = segments_of(prints.count(), tile_rows)
    dealt = prints.mapInPandas(_deal(radius, segments), "t1 long, t2 long, first boolean, fp long, rep long")
    return dealt.groupBy("t1", "t2").applyInPandas(_forest(radius), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id) of each row with a key: the smallest key reachable over links."""
    docs = stored(with_fingerprint(df.where(F.col(key).isNotNull()), key, text))
    return _labelled(docs, key, radius)


def _labelled(docs: DataFrame, key: str, radius: int) -> DataFrame:
    """docs, a written table with key and fp, with component_id."""
    prints = stored(docs.groupBy("fp").agg(F.min(key).cast("long").alias("low"), F.count("*").alias("n")))
    found = components(link_fingerprints(prints.select("fp", F.col("fp").alias("rep")), radius))
    # Nodes are fingerprints, so that unlike texts of one key stay apart; a component's id is its smallest key.
    rooted = prints.join(found.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    moved = rooted.join(lowest, "root").where("component_id <> low").select("fp", "component_id")
    label = stored(prints.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "low").alias("component_id")))
    hot_rows = max(HOT_ROWS, -(-docs.count() // MAX_HOT))
    hot = F.broadcast(label.where(F.col("n") >= hot_rows).select("fp", F.col("component_id").alias("hot_id")))
    marked = docs.join(hot, "fp", "left")
    cold = marked.where("hot_id IS NULL").join(label.where(F.col("n") < hot_rows).select("fp", "component_id"), "fp")
    out = [*docs.columns, "component_id"]
    return cold.select(*out).unionByName(marked.where("hot_id IS NOT NULL").withColumnRenamed("hot_id", "component_id").select(*out))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, max_broadcast: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """One row of each group, with its columns as they are: of the rows with the smallest key, that with the smallest
    hash of its text, and of equal rows (key and text) one.

    Rows are named by 128 bits of key and text. Those that go are broadcast up to a checked number, so that texts aren't
    shuffled; beyond it they are joined. Rows without a key can't be named as a copy and stay.
    """
    name = F.struct(F.xxhash64(F.col(key), F.col(text).isNull(), F.col(text)).alias("h1"), F.xxhash64(F.lit(1), F.col(key), F.col(text).isNull(), F.col(text)).alias("h2"))
    named = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), name.alias("_row"))
    docs = stored(with_fingerprint(named, "_key", "_text", "_row"))
    rows = _labelled(docs, "_key", radius).groupBy("component_id", "_key", "_row").agg(F.count("*").alias("_n"))
    rows = stored(rows)
    stay = rows.groupBy("component_id").agg(F.min(F.struct("_key", "_row")).alias("_first"))
    judged = stored(rows.join(stay, "component_id").select("_row", "_n", (F.col("_first") == F.struct("_key", "_row")).alias("_stay")))
    # A row's name may hold twice: two equal rows are one group, so never with both answers.
    gone, again = judged.where("NOT _stay").select("_row"), judged.where("_stay AND _n > 1").select("_row")
    kept = df.join(bounded(gone, max_broadcast), F.when(F.col(key).isNotNull(), name) == gone["_row"], "left_anti")
    if again.isEmpty():
        return kept
    again = bounded(again, max_broadcast)
    same = F.when(F.col(key).isNotNull(), name) == again["_row"]
    once = kept.join(again, same, "left_semi").dropDuplicates([key, text])
    return kept.join(again, same, "left_anti").unionByName(once)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    nameless = with_fingerprint(docs.where("doc_id IS NULL")).withColumn("component_id", F.lit(None).cast("long"))
    out = near_duplicates(docs).unionByName(nameless)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
