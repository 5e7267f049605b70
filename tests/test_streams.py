import json

from pyspark.sql import functions as F

from quernstone.sources import readers as R
from quernstone.streaming import operators as S


def feed(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_messages_and_duplicates_across_runs(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    message = lambda c, m, t: {"chat_id": c, "message_id": m, "text": t, "ts": f"2024-01-01T00:00:{m:02d}Z"}
    feed(inbox, "1.json", [message(1, 1, "a"), message(1, 1, "a again"), message(1, 2, None), message(2, 1, "b")])
    stream = lambda: S.first_of_keys(R.read_messages(spark, str(inbox)), ["chat_id", "message_id"], "ts")
    assert S.append_once(stream(), out).count() == 2
    feed(inbox, "2.json", [message(1, 1, "late copy"), message(1, 3, "c")])
    assert sorted((r.chat_id, r.message_id) for r in S.append_once(stream(), out).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_bounded_memory_of_keys(spark, tmp_path):
    feed(tmp_path / "in", "1.json", [{"chat_id": 1, "message_id": i, "text": str(k)} for k, i in enumerate([1, 2, 3, 1, 4, 1, 4])])
    rows = R.read_messages(spark, str(tmp_path / "in")).select("chat_id", "message_id", F.col("text").cast("int").alias("n"))
    got = S.append_once(S.first_of_last_keys(rows, "chat_id", "message_id", "n", most=3)).orderBy("n").collect()
    assert [(r.message_id, r.n) for r in got] == [(1, 0), (2, 1), (3, 2), (4, 4), (1, 5)]


def test_expiry_counts_from_the_refresh(spark, tmp_path):
    assert S.refreshed([0, 10, 29, 30, 31, 59, 60, 100], 30) == [0, 0, 0, 30, 30, 30, 60, 100]
    price = lambda s, v: {"coin": "a", "v": v, "ts": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"}
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    stream = lambda: S.with_cache_expiry(spark.readStream.schema("coin string, v double, ts timestamp").json(str(inbox)), "coin", "ts", "v", 30.0)
    feed(inbox, "1.json", [price(s, float(s)) for s in (20, 0, 29)])
    S.append_once(stream(), out)
    feed(inbox, "2.json", [price(s, float(s)) for s in (25, 40, 69, 71)])
    got = {r.v: r.served_value for r in S.append_once(stream(), out).collect()}
    assert got == {0.0: 0.0, 20.0: 0.0, 29.0: 0.0, 25.0: 0.0, 40.0: 40.0, 69.0: 40.0, 71.0: 71.0}


def test_windows_sessions_and_requests(spark, tmp_path):
    rows = [{"request_id": str(i), "query": q, "ts": f"2024-01-01T00:00:{s:02d}Z"} for i, (q, s) in enumerate([(" что? ", 0), ("", 1), ("ЧТО?", 4), ("иное", 50)])]
    feed(tmp_path / "in", "1.json", rows)
    stream = R.read_requests(spark, str(tmp_path / "in"))
    cache = spark.createDataFrame([("что?", "да")], "key string, answer string")
    assert {r.query: r.answer for r in S.append_once(S.with_cached_answers(stream, cache)).collect()} == {"что?": "да", "ЧТО?": "да", "иное": None}
    assert sorted(r.n for r in S.complete_once(S.windowed_counts(stream, "ts", "10 seconds", "5 seconds")).collect()) == [1, 1, 2, 2]
    assert sorted(r.n for r in S.complete_once(S.session_counts(stream.withColumn("k", F.lit(1)), "ts", "10 seconds", ["k"])).collect()) == [1, 2]
    last = S.complete_once(S.last_in_window(stream, "ts", "5 seconds", [], ["ts"], "query")).collect()
    assert sorted(r.query for r in last) == ["ЧТО?", "иное"]


def test_cache_keeps_first_good_answers(spark, tmp_path):
    inbox, path = tmp_path / "in", str(tmp_path / "cache")
    schema = "key string, answer string, bad boolean"

    def run():
        S.keep_cache(spark.readStream.schema(schema).json(str(inbox)), path, is_error=F.col("bad")).trigger(availableNow=True).start().awaitTermination()

    feed(inbox, "1.json", [{"key": "a", "answer": "oops", "bad": True}, {"key": "b", "answer": "1", "bad": False}])
    run()
    feed(inbox, "2.json", [{"key": "a", "answer": "fine", "bad": False}, {"key": "b", "answer": "2", "bad": False}])
    run()
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "fine"), ("b", "1")]
