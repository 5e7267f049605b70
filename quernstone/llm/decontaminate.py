"""Operator 7: benchmark decontamination, with DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words (an item of fewer words is one shingle).
A document's windows have the size of an item. Windows that can reach the similarity to some item get a SimHash, and a
multi-index finds every pair of window and item fingerprints within the radius: fingerprints are cut into four blocks of
16 bits, and a pair within the radius differs by at most five bits in the first block or four in another, so each item is
filed under all such values of its blocks and each window meets the items of its size under its own values. Nothing but
the fingerprints pairs windows with items. Exact weighted-shingle similarity (sum of minima over sum of maxima of the
shingles' counts) decides.

Which windows can reach similarity t to an item of their size is known without loss from the shingles of all items of
that size: window and item must share at least 2 t / (1 + t) of their shingles, so (1) a window of m shingles has fewer
than m / 9 foreign ones at 0.8 and holds an item's shingle among its every-fourth ones, by which documents are looked up
first, and (2) of all such windows one that starts at an item's shingle, or ends with the document, is at least as
similar as any other it overlaps. Fingerprints are computed once for each distinct window.

The fingerprints can lose a pair: one at similarity 0.8 that differs by more than RADIUS bits (see the README for how
often), as is in the nature of the method; more similar ones differ less.

Null and empty texts have no windows; null and empty items match nothing. A text shorter than an item is one window.
Equal texts share their answer, so repeated rows are safe. Items are searched by their words: of an id with several
texts each is searched, and the most similar counts for the id. An item without an id has no row in the pairs, but a
document that holds it is dropped. Ties of windows go to the first. Only the columns named are read; others may have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import bounded, read, stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Of 64 bits. At similarity 0.8 about 10 bits differ, with a deviation of 3.
RADIUS = 20
#: Blocks of the index, and bits of each.
BLOCKS, WIDTH = 4, 16
#: Rows up to which items' shingles (16 bytes), names of texts (16 bytes, or 50 with what was found in them) and windows'
#: fingerprints (44 bytes) are broadcast; beyond that they are joined.
MAX_BROADCAST_SHINGLES, MAX_BROADCAST_TEXTS, MAX_BROADCAST_WINDOWS = 1_000_000, 1_000_000, 500_000
STRIDE = 4


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, size: int, stride: int = 1) -> Column:
    """Hashes of every stride-th shingle; words is bound once, as a lambda's variable."""

    def of(w: Column) -> Column:
        last = F.greatest(F.size(w) - size, F.lit(0))
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.xxhash64(F.slice(w, i + 1, size))))

    return F.transform(F.array(words), of)[0]


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _simhash(df: DataFrame, keys: list[str], shingles: str) -> DataFrame:
    """(keys, fp): bits set in over half of the shingles, each as often as it comes; two bits are counted in one sum."""
    rows = df.select(*keys, F.explode(shingles).alias("h"))
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"s{k}") for k in range(32)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *lanes)
    fp = F.lit(0).cast("long")
    for bit in range(64):
        votes = F.shiftrightunsigned(f"s{bit % 32}", 32 * (bit // 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        fp = fp.bitwiseOR(F.when(votes * 2 > F.col("n"), F.lit((1 << bit) - ((1 << 64) if bit == 63 else 0))).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def _thresholds(radius: int) -> list[int]:
    """Differing bits allowed in each of BLOCKS blocks: prints that differ by more in all of them are beyond the radius."""
    return [(radius + 1) // BLOCKS - 1 + (b < (radius + 1) % BLOCKS) for b in range(BLOCKS)]


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _blocks(fp: Column) -> Column:
    """(block, value) of each block of a fingerprint."""
    return F.array(*(F.struct(F.lit(b).alias("block"), _block(fp, b).alias("value")) for b in range(BLOCKS)))


def _probes(fp: Column, radius: int) -> Column:
    """(block, value) of all values within a block's threshold of its own."""

    def of(b: int, most: int) -> Column:
        # One text that Catalyst folds into an array, instead of an expression for each mask.
        masks = F.split(F.lit(" ".join(str(m) for m in range(1 << WIDTH) if m.bit_count() <= most)), " ").cast("array<int>")
        return F.transform(masks, lambda x: F.struct(F.lit(b).alias("block"), x.bitwiseXOR(_block(fp, b)).alias("value")))

    return F.concat(*(of(b, most) for b, most in enumerate(_thresholds(radius)) if most >= 0))


def _within(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """(w1, w2, m, span, item) of all pairs of prints (fp, item_fp) of one size m within the radius, each once.

    The items are the index: each is filed under every value near enough to its own in some block, and a window meets
    the items under its own values. A pair under several blocks counts at the first.
    """
    keys = stored(windows.select("w1", "w2", "m", "span", "fp", F.explode(_blocks(F.col("fp"))).alias("key")).select("*", "key.block", "key.value").drop("key"))
    filed = items.select("item", F.col("m").alias("im"), "item_fp", F.explode(_probes(F.col("item_fp"), radius)).alias("k")).select("item", "im", "item_fp", F.col("k.block").alias("ib"), F.col("k.value").alias("iv"))
    met = filed.join(bounded(keys, MAX_BROADCAST_WINDOWS), (F.col("m") == F.col("im")) & (F.col("block") == F.col("ib")) & (F.col("value") == F.col("iv")))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.lit(None).cast("int")
    for b, most in reversed(list(enumerate(_thresholds(radius)))):
        first = F.when(F.bit_count(_block(apart, b)) <= most, F.lit(b)).otherwise(first)
    return met.where((F.bit_count(apart) <= radius) & (first == F.col("block"))).select("w1", "w2", "m", "span", "item")


def _stride(least: int, similarity: float) -> int:
    """The widest stride whose positions can't all be foreign in a window that reaches the similarity."""
    foreign = (1 - similarity) / (1 + similarity)
    for s in range(STRIDE, 1, -1):
        low = max(1, int(similarity * least))
        if all(m // s > int(m * foreign + 1e-9) for m in range(low, low + 400)):
            return s
    return 1


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(t1, t2, item_id, similarity, start_word): each distinct text, by its 128-bit key, and each item found in it; item_id
    is null for items without an id."""
    words = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("item_id"), _words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    words = words.withColumn("item", F.md5(F.array_join("w", " ").cast("binary")))
    names = words.select("item", "item_id").distinct()
    words = words.withColumn("size", F.least(F.size("w"), F.lit(SHINGLE_WORDS)))
    sizes = words.groupBy("size").agg(F.min(F.size("w")).alias("least")).collect()  # five rows at most
    texts = docs.where(F.col(text).isNotNull()).select(*_text_key(F.col(text)), F.col(text).alias("text"))
    found = None
    for row in sorted(sizes):
        part = _of_size(texts, words.where(F.col("size") == row["size"]), row["size"], row["least"], similarity, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return texts.where("false").selectExpr("t1", "t2", "cast(null AS bigint) item_id", "cast(null AS double) similarity", "cast(null AS bigint) start_word")
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("before")))
    out = found.join(names, "item").groupBy("t1", "t2", "item_id").agg(best.alias("b"))
    return out.select("t1", "t2", "item_id", "b.similarity", (-F.col("b.before")).alias("start_word"))


def _of_size(texts: DataFrame, words: DataFrame, size: int, least: int, similarity: float, radius: int) -> DataFrame:
    items = stored(words.select("item", _shingles(F.col("w"), size).alias("shingles")).withColumn("m", F.size("shingles")).dropDuplicates(["item"]))
    # Which shingles items of each size have: at most one row for each size, however many items share a shingle.
    vocabulary = stored(items.select("m", F.explode("shingles").alias("h")).distinct())
    step = _stride(max(1, least - size + 1), similarity)
    # Texts that hold an item's shingle at a multiple of the stride, then all their shingles.
    seeds = texts.select("t1", "t2", F.explode(_shingles(_words(F.col("text")), size, step)).alias("h"))
    near = stored(seeds.join(bounded(vocabulary.select("h").distinct(), MAX_BROADCAST_SHINGLES), "h", "left_semi").select("t1", "t2").distinct())
    held = texts.join(bounded(near, MAX_BROADCAST_TEXTS), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    held = stored(held.select("t1", "t2", _shingles(_words(F.col("text")), size).alias("all")))
    places = held.select("t1", "t2", F.size("all").alias("n"), F.posexplode("all").alias("pos", "h")).join(bounded(vocabulary, MAX_BROADCAST_SHINGLES), "h")
    lists = places.groupBy("t1", "t2", "n", "m").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    # Windows of an item's size (or the whole text) that hold enough places of shingles of items of that size.
    span = F.least("m", "n")
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("m") + span) - F.lit(1e-9)).cast("int")
    lists = lists.select("*", span.alias("span"), need.alias("need")).where(F.size("p") >= F.col("need"))
    inner = F.transform(F.sequence(F.lit(1), F.size("p") - F.col("need") + 1), lambda i: F.struct(F.element_at("p", i).alias("start"), F.element_at("p", i + F.col("need") - 1).alias("end")))
    starts = F.transform(F.filter(inner, lambda x: (x["start"] <= F.col("n") - F.col("span")) & (x["end"] < x["start"] + F.col("span"))), lambda x: x["start"])
    tail = F.when(F.element_at("p", F.size("p") - F.col("need") + 1) >= F.col("n") - F.col("span"), F.array(F.col("n") - F.col("span"))).otherwise(F.array().cast("array<int>"))
    windows = lists.select("t1", "t2", "m", "span", F.explode(F.array_distinct(F.concat(starts, tail))).alias("start")).join(held, ["t1", "t2"])
    windows = windows.select("t1", "t2", "m", "span", "start", F.expr("slice(all, start + 1, span)").alias("window"))
    windows = stored(windows.select("*", F.xxhash64("window").alias("w1"), F.xxhash64(F.lit(1), "window").alias("w2")))
    distinct = stored(windows.select("w1", "w2", "m", "span", "window").dropDuplicates(["w1", "w2", "m"]))
    prints = _simhash(distinct, ["w1", "w2", "m", "span"], "window")
    item_prints = _simhash(items, ["item", "m"], "shingles").withColumnRenamed("fp", "item_fp")
    pairs = stored(_within(prints, item_prints, radius))
    weights = items.select("item", F.explode("shingles").alias("h")).groupBy("item", "h").agg(F.count("*").alias("weight"))
    counted = pairs.join(distinct.drop("span"), ["w1", "w2", "m"]).select("w1", "w2", "item", "m", "span", F.explode("window").alias("h")).groupBy("w1", "w2", "item", "m", "span", "h").agg(F.count("*").alias("c"))
    shared = counted.join(weights, ["item", "h"]).groupBy("w1", "w2", "item", "m", "span").agg(F.sum(F.least("c", "weight")).alias("o"))
    alike = shared.select("w1", "w2", "item", "m", (F.col("o") / (F.col("m") + F.col("span") - F.col("o"))).alias("similarity")).where(F.col("similarity") >= similarity - 1e-12)
    hits = windows.select("w1", "w2", "m", "t1", "t2", "start").join(alike, ["w1", "w2", "m"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before")))
    out = hits.groupBy("t1", "t2", "item").agg(best.alias("b"))
    return out.select("t1", "t2", "item", F.round("b.similarity", 6).alias("similarity"), (-F.col("b.before")).cast("long").alias("start_word"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, item_id, similarity, start_word) of each document and each benchmark item found in it."""
    found = bounded(stored(matches(docs, items, text, **options).where("item_id IS NOT NULL")), MAX_BROADCAST_TEXTS)
    rows = docs.select(F.col(key).alias("key"), *_text_key(F.col(text)))
    return rows.join(found, ["t1", "t2"]).select(F.col("key").alias(key), "item_id", "similarity", "start_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents in which no item is found, with their columns as they are, whatever their names."""
    found = stored(matches(docs, items, text, **options).select("t1", "t2").distinct())
    found = bounded(found.select(F.struct("t1", "t2").alias("found")), MAX_BROADCAST_TEXTS)
    return docs.join(found, F.struct(*_text_key(docs[text])) == found["found"], "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents
), iw AS (SELECT item_id, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark
), ds AS (
  SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS s, greatest(len(w) - 4, 1) AS n
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS pos FROM dw WHERE len(w) > 0)
), si AS (
  SELECT item_id, s, count(*) AS weight, any_value(m) AS m FROM (
    SELECT item_id, array_to_string(w[pos + 1 : pos + 5], ' ') AS s, greatest(len(w) - 4, 1) AS m
    FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS pos FROM iw WHERE len(w) > 0))
  GROUP BY item_id, s
), starts AS (
  SELECT DISTINCT doc_id, item_id, m, least(m, n) AS span, least(pos, n - least(m, n)) AS start FROM ds JOIN si USING (s)
), c AS (
  SELECT t.doc_id, t.item_id, t.m, t.span, t.start, ds.s, count(*) AS c
  FROM starts t JOIN ds ON ds.doc_id = t.doc_id AND ds.pos >= t.start AND ds.pos < t.start + t.span GROUP BY ALL
), o AS (
  SELECT doc_id, item_id, c.m, span, start, sum(least(c, weight)) AS o FROM c JOIN si USING (item_id, s) GROUP BY ALL
), sim AS (SELECT doc_id, item_id, start, o / (m + span - o) AS similarity FROM o)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity,
       CAST(arg_max(start, (similarity, -start)) AS BIGINT) AS start_word
FROM sim WHERE similarity >= 0.8 - 1e-12 GROUP BY doc_id, item_id
"""
