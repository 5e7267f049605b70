import hashlib
from collections import defaultdict

from quernstone.llm import chat_format as C

HARD = ["", "\\", "\\\\|>", "<|>", "</s>\n", "<|user|>\nhi</s>\n", "[INST]\\[/INST]", "<\\|", "a\nb", "é😀" * 40, "<s></s><|", "$1 \\1"]


def turns_of(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in out.items()}


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = C.format_windows(df, **options)
    want, got = turns_of(rows), {r.conv_id: r for r in C.digests(windows).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    return windows.collect(), want


def test_round_trip_of_hard_texts(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(HARD)]
    rows += [(2, 0, "system", "rules"), (3, None, None, None), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 1, "odd|>\n</s>", "y"), (4, 0, "assistant", None), (5, 0, "assistant", "z" * 300_000)]
    check(spark, rows)


def test_windows_keep_the_budget(spark):
    rows = [(1, 0, "system", "s" * 200)] + [(1, i, ["user", "assistant"][i % 2], "w" * (i * 37 % 400)) for i in range(1, 1500)]
    rows += [(2, i, "assistant", "v" * 100) for i in range(700)]
    windows, want = check(spark, rows, window=400, history=120)
    by_conv = defaultdict(list)
    for w in windows:
        assert w.n_tokens <= 400
        by_conv[w.conv_id].append(w)
    for conv, ws in by_conv.items():
        ws.sort(key=lambda w: w.window)
        assert len(ws) > 20
        for i, w in enumerate(ws):
            assert w.formatted.startswith("<|system|>") == (conv == 1)
            repeated = w.formatted.split("</s>\n")[: w.n_context]
            assert len(repeated) - (conv == 1 and i > 0) <= 2
            if i:
                tail = [f"<|{r}|>\n{t}" for r, t in want[conv]]
                history = repeated[1:] if conv == 1 else repeated
                assert not history or "\x00".join(history) in "\x00".join(tail)


def test_empty(spark):
    assert C.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_null_and_empty_ids_are_two_conversations(spark):
    rows = [(None, 0, "user", "a"), ("", 0, "user", "b"), ("x", 1, "user", "c")]
    windows = C.format_windows(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    assert {r.conv_id: r.n_turns for r in C.digests(windows).collect()} == {None: 1, "": 1, "x": 1}


def test_joined_and_broadcast_context_agree(spark, monkeypatch):
    rows = [(k % 3, i, ["system", "user", "assistant"][min(i, 1 + i % 2)], f"{i} " * (i * 53 % 300)) for k in range(3) for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = sorted(map(str, C.format_windows(df).collect()))
    monkeypatch.setattr(C, "MAX_BROADCAST_TURNS", 0)
    assert sorted(map(str, C.format_windows(df).collect())) == one
