import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from quernstone.llm import bpe
from quernstone.llm import token_counts as C

ODD = [
    "", "  a", "a  b", "it's we'll 'tis x's't '' 's  's\n's \t'd", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>",
    "aaaaaaa" * 100, "!" * 900, "日本語 テスト 😀😀", "don'T I'M", "'", "''ll", "'re", "a'", "\x1c\x1d x", "1234 ½ ²x", "   ", "\n\n a", "'v e", "l'llx 're's",
]


def library():
    return Tokenizer.from_file(public_tokenizers.path(C.TOKENIZER))


def test_ids_and_counts_are_the_librarys(sf):
    texts = ODD + pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    encoder = bpe.Encoder(public_tokenizers.path(C.TOKENIZER), cached=500)
    assert encoder.count(texts).tolist() == [len(w) for w in want]
    ids, ends = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


def test_every_letter_and_space_in_context():
    texts = [f"a{chr(c)}a1{chr(c)}1.{chr(c)}. {chr(c)} a" for c in [*range(0x3000), *range(0xA000, 0xA200), *range(0x1F600, 0x1F640)]]
    want = [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    assert bpe.Encoder(public_tokenizers.path(C.TOKENIZER)).count(texts).tolist() == want


def test_query_and_edge_cases(spark, sf):
    tok = library()
    docs = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in C.op10_token_counts(spark, sf).collect()}
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert got[d] == (len(t.encode()), n, n > 512)
    long = "word " * 600_000
    rows = [(1, None, 5), (1, None, 5), (None, "a b", 6), (2, long, 7)]
    out = C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in out) == [(0, 0, False), (0, 0, False), (3, 2, False), (3_000_000, len(tok.encode(long).ids), True)]
    assert C.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
