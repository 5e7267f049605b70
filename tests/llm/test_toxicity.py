import pickle
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quernstone.llm import bigru, toxicity


def small_net():
    net = bigru.BiGru(3)
    rng = np.random.default_rng(5)
    net.dense["b_in"] = rng.normal(size=net.dense["b_in"].shape).astype(np.float32)
    return net


def slow_scores(net, texts):
    """The network window by window and word by word."""
    d, h = net.dense, bigru.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def gru(xs, u):
        state, out = np.zeros(h), []
        for x in xs:
            hu = state @ u
            z, r = sig(x[:h] + hu[:h]), sig(x[h : 2 * h] + hu[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * hu[2 * h :])
            out.append(state)
        return out

    best = []
    for t in texts:
        words = re.findall(r"[^\W_]+", t.lower())
        logits = []
        for a in range(0, max(1, len(words) - bigru.WINDOW + bigru.STRIDE), bigru.STRIDE):
            part = words[a : a + bigru.WINDOW]
            if not part:
                logits.append(float(d["b_o"]))
                continue
            x = np.array([net.inputs(bigru.Words([w]))[0] @ d["w_in"] + d["b_in"] for w in part])
            forward, backward = gru(x[:, : 3 * h], d["u_f"]), gru(x[::-1, 3 * h :], d["u_b"])[::-1]
            states = np.hstack([forward, backward])
            s = np.tanh(states @ d["w_a"] + d["b_a"]) @ d["v_a"]
            w = np.exp(s - s.max())
            logits.append(float((w / w.sum()) @ states @ d["w_o"] + d["b_o"]))
        best.append(sig(max(logits)))
    return best


def test_batches_score_as_single_windows():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 9)))
    texts = ["", " .. ", "one", *(" ".join(word() for _ in range(n)) for n in (2, 63, 64, 65, 96, 97, 300)), "A, b! A_b\nÉ"]
    net = small_net()
    assert np.allclose(net.scores(texts), slow_scores(net, texts), atol=1e-5)


def test_gradients_are_slopes():
    net, words = small_net(), bigru.Words(["some words of a text and some more", "b c d", ""])
    text, first, size = bigru.window_spans(np.diff(words.ends))
    target, weight = np.array([1.0, 0.0, 1.0], np.float32), np.array([1.0, 2.0, 1.0], np.float32)
    for k in net.dense:
        net.dense[k] = net.dense[k].astype(np.float64)
    net.word, net.gram = net.word.astype(np.float64), net.gram.astype(np.float64)

    def loss():
        logit = net.logits(words)[0].astype(float)
        return float((weight / weight.sum() * (np.log1p(np.exp(logit)) - target * logit)).sum())

    dense, (word_index, word_g), (gram_index, gram_g) = net.gradients(words, text, first, size, target, weight, 1.1, np.random.default_rng(0))
    rows = {"word": bigru._sum_rows(word_index, word_g), "gram": bigru._sum_rows(gram_index, gram_g)}
    checks = [(net.dense, k, i, dense[k]) for k in ("w_in", "u_f", "u_b", "w_a", "b_in") for i in ((0,) if net.dense[k].ndim == 1 else (1, 2),)]
    for holder, k, i, g in checks:
        old, step = holder[k][i], 2e-2
        holder[k][i] = old + step
        up = loss()
        holder[k][i] = old - step
        slope, holder[k][i] = (up - loss()) / (2 * step), old
        assert slope == pytest.approx(float(np.asarray(g)[i]), rel=0.05, abs=3e-5), (k, slope)
    for name, (index, g) in rows.items():
        table, r = getattr(net, name), index[0]
        old, step = table[r, 1], 2e-2
        table[r, 1] = old + step
        up = loss()
        table[r, 1] = old - step
        slope, table[r, 1] = (up - loss()) / (2 * step), old
        assert slope == pytest.approx(float(g[0, 1]), rel=0.05, abs=3e-5), (name, slope)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = pq.read_table(f"{sf}/labels.parquet").to_pydict()
    toxic = dict(zip(labels["doc_id"], labels["toxic"], strict=True))
    got = toxicity.op1_toxicity(spark, sf).collect()
    assert len(got) == pq.read_table(f"{sf}/documents.parquet").num_rows
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    judged = [(toxic[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in toxic]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
    found = [b for a, b in judged if a]
    assert sum(found) >= 0.7 * len(found)


def test_edge_cases(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (2, "x " * 100_000 + "bad", 7), (4, "fine words", 8), (6, "fine", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 0, 1), (4, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, labels)
    assert isinstance(model, toxicity.Constant) and model.score == 0
    out = toxicity.score_documents(docs, small_net())
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == len(rows)
    by = {r.doc_id: r.score for r in out.collect()}
    assert by[1] == by[None] and all(0 <= s <= 1 for s in by.values())
    assert toxicity.score_documents(docs.limit(0), small_net()).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert toxicity.fit(docs.limit(0), labels.limit(0)).score == 0


def test_network_survives_the_way_from_its_task():
    texts = ["some words", "", "x y z " * 50]
    net = small_net()
    net.word[::3] = 0
    net.gram[5:900] = 0
    again = pickle.loads(pickle.dumps(net))
    assert np.array_equal(again.word, net.word) and np.array_equal(again.gram, net.gram)
    assert np.array_equal(again.scores(texts), net.scores(texts))


def test_query_scores_as_the_trained_network_does(spark, sf):
    """The query against the network of the same sample, trained here, window by window and word by word."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.sample(docs, labels).collect()
    net = toxicity.train([r.t for r in rows], [r.y for r in rows])
    got = {r.doc_id: r.score for r in toxicity.op1_toxicity(spark, sf).collect()}
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: len(x[1]))[:60]
    assert np.allclose([got[i] for i, _ in texts], slow_scores(net, [t for _, t in texts]), atol=1e-4)


def test_long_texts_leave_room_for_others(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_TOXIC", 2)
    docs = spark.createDataFrame([(i, "bad " * (9_000 if i < 20 else 5)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    assert [r.y for r in toxicity.sample(docs, labels).collect()] == [1, 1]
