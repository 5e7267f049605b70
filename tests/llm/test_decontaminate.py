import random
import re
from collections import Counter

from quernstone.llm import decontaminate as D


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def slow(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            w, v = words(text), words(item)
            if not w or not v:
                continue
            k = min(5, len(v))
            gram = lambda x, k=k: [tuple(x[a : a + k]) for a in range(max(1, len(x) - k + 1))]
            gd, gi = gram(w), Counter(gram(v))
            m = sum(gi.values())
            span = min(m, len(gd))
            for s in range(len(gd) - span + 1):
                o = sum((Counter(gd[s : s + span]) & gi).values())
                sim = o / (m + span - o)
                if sim >= 0.8 - 1e-12 and (d, i) not in out or (d, i) in out and sim > out[d, i]:
                    out[d, i] = sim
    return {k: round(v, 6) for k, v in out.items()}


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(n)) for i, n in enumerate([1, 3, 4, 5, 6, 9, 15, 30, 45, 60])] + [(20, None), (21, " .. "), (22, "a a a a a a a a b a a a a")]
    docs = []
    for d in range(60):
        body, item = text(rng.randint(0, 80)).split(), words(rng.choice(items[:10])[1])
        if d % 2 and len(item) > 8:
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], ["new"], [item[at], "new"]])
        at = rng.randint(0, len(body))
        docs.append((d, ", ".join([*body[:at], *item, *body[at:]]).upper()))
    docs += [(100, None), (101, ""), (102, "a " * 12), (103, items[8][1]), (103, items[8][1]), (None, items[8][1]), (104, text(20000) + " " + items[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, h int")
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, t1 int")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(df, table).collect()}
    assert got == slow(docs, items)
    clean = [r.doc_id for r in D.drop_contaminated(df, table).collect()]
    assert sorted(clean, key=str) == sorted((d for d, _ in docs if d not in {k for k, _ in got}), key=str)
    assert D.contaminated(df.limit(0), table).count() == 0 and D.contaminated(df, table.limit(0)).count() == 0


def test_stride_is_safe():
    for least in range(1, 60):
        s = D._stride(least, 0.8)
        for m in range(max(1, int(0.8 * least)), 300):
            foreign = m - -(-2 * 8 * m // 18)
            assert m // s > foreign or s == 1


def test_repeated_and_null_item_ids(spark):
    text = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    one, two, three, nameless = text("a", 20), text("b", 30), text("c", 3), text("d", 25)
    near = two.replace("b29", "new")  # less similar to two than two itself
    items = spark.createDataFrame([(1, one), (1, two), (1, near), (1, three), (1, one), (2, one), (None, nameless), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"x {one} y"), (11, f"x y {two}"), (12, three), (13, f"{nameless} x"), (14, text("z", 40)), (15, f"{one} {two}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.similarity, r.start_word) for r in D.contaminated(docs, items).collect())
    assert got == [(10, 1, 1.0, 1), (10, 2, 1.0, 1), (11, 1, 1.0, 2), (12, 1, 1.0, 0), (15, 1, 1.0, 0), (15, 2, 1.0, 0)]
    assert [r.doc_id for r in D.drop_contaminated(docs, items).collect()] == [14]


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(f"i{k}", 7 + k % 2, rng.getrandbits(64)) for k in range(12)]
    windows = []
    for k in range(400):
        item = rng.choice(items)
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 26)))
        windows.append((k, k, item[1], item[1], item[2] ^ flips))
    left = spark.createDataFrame([(*w[:4], signed(w[4])) for w in windows], "w1 long, w2 long, m int, span int, fp long")
    right = spark.createDataFrame([(i, m, signed(f)) for i, m, f in items], "item string, m int, item_fp long")
    for radius in (3, 20):
        got = [(r.w1, r.item) for r in D._within(left, right, radius).collect()]
        want = {(w[0], i) for w in windows for i, m, f in items if m == w[2] and (w[4] ^ f).bit_count() <= radius}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_clashing_column_names(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item, 2, 3, 4), (2, "clean words", 2, 3, 4)], "doc_id long, text string, f1 int, found int, t1 int")
    items = spark.createDataFrame([(5, item, 1)], "item_id long, text string, h int")
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    assert [(r.t1, r.item_id) for r in D.contaminated(docs.drop("doc_id"), items, "t1").collect()] == [(4, 5)]
