import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from quernstone.llm import packing as P


def check(rows, docs):
    """Each id in one piece, pieces right, sequences gapless; returns the share of padding."""
    tok = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    want = Counter((d, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for (d, ids), times in want.items():
        mine = [r for r in by_doc[d] if r.doc_tokens == len(ids)]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            crc = zlib.crc32(np.array(part, "<u4").tobytes())
            assert sum((r.start, r.length, r.ids_crc32) == (s, len(part), crc) for r in mine) >= times
    assert sum(r.length for r in rows) == sum(len(i) * n for (_, i), n in want.items())
    for parts in by_sequence.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 2048
    return 1 - sum(r.length for r in rows) / (2048 * len(by_sequence)) if rows else 0


def test_query_is_whole_and_dense(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    padding = check(P.op6_packing(spark, sf).collect(), list(zip(docs["doc_id"], docs["text"], strict=True)))
    assert padding < 0.08


def test_edge_cases(spark):
    docs = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "word " * 20000), (3, "other <|endoftext|> x"), (4, "x " * 2047), (5, "x " * 1023)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int")
    check(P.pack_documents(df).collect(), docs)
    assert P.pack_documents(df.limit(0)).count() == 0


def test_plan_uses_up_the_histogram():
    rng = random.Random(1)
    for histogram in ({}, {256: 5}, {1: 3}, {200: 1000}, {200: 1000, 56: 10, 28: 400}, {k: rng.randint(0, 5000) for k in range(1, 257)}, {129: 10**9, 127: 10**9 - 7}):
        made = P.plan(histogram, 256)
        used = Counter()
        for combo, n in made:
            assert n > 0 and sum(combo) <= 256
            for k in combo:
                used[k] += n
        assert used == Counter({k: v for k, v in histogram.items() if v})
        if len(histogram) == 256:
            # No packing has fewer sequences than the tokens fill, or than lengths over half a window; uneven counts miss that bound.
            least = max(sum(k * v for k, v in used.items()) / 256, sum(v for k, v in used.items() if k > 128))
            assert sum(n for _, n in made) < 1.05 * least


def test_an_even_histogram_is_packed_without_padding():
    histogram = {k: 900 * (4 if k < 60 else 1) for k in range(1, 257)}
    made = P.plan(histogram, 256)
    assert sum(k * v for k, v in histogram.items()) > 0.999 * 256 * sum(n for _, n in made)


def test_nnls_against_its_conditions():
    rng = np.random.default_rng(0)
    columns, b = rng.integers(0, 21, (12, 3)), rng.random(20)
    a = np.zeros((21, 12))
    np.add.at(a, (columns.ravel(), np.repeat(np.arange(12), 3)), 1)
    x = P.solve(columns, b, 5000)
    grad = a[:20].T @ (a[:20] @ x - b)
    assert (x >= 0).all() and (grad > -1e-3).all() and np.abs(grad[x > 1e-6]).max() < 1e-3
