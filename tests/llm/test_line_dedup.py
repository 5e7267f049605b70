import pytest

from quernstone.llm import line_dedup as L


@pytest.mark.parametrize("max_broadcast", [0, 100])
def test_drops_lines_beyond_the_ratio(spark, max_broadcast):
    rows = [(i, f"menu \nbody {i}\n\n{'rare' if i < 3 else 'x'}\tz\n menu", "a", i) for i in range(10)]
    rows += [(20 + i, f"menu\nbody {i}", "b", 0) for i in range(4)]
    rows += [(30, None, "a", 0), (31, "", "a", 0), (None, "menu", None, 0), (32, "menu", "a", 0), (32, "menu", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, line int")
    out = L.drop_boilerplate(df, ratio=0.5, min_pages=5, counts=True, max_broadcast=max_broadcast)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    got = {}
    for r in out.collect():
        got.setdefault((r.doc_id, r.source), []).append((r.text, r.n_lines, r.n_dropped))
    assert got[(0, "a")] == [("body 0\n\nrare\tz", 5, 2)] and got[(9, "a")] == [("body 9\n\nx\tz", 5, 2)]
    assert got[(20, "b")] == [("menu\nbody 0", 2, 0)]  # too few pages to tell
    assert got[(30, "a")] == [(None, 0, 0)] and got[(31, "a")] == [("", 1, 0)]
    assert got[(None, None)] == [("menu", 1, 0)] and got[(32, "a")] == [("", 1, 1)] * 2
    assert sum(map(len, got.values())) == len(rows)
    assert L.drop_boilerplate(df.limit(0)).count() == 0


def test_long_text_and_ties(spark):
    long = "\n".join(f"line {i}" for i in range(50_000)) + "\nboiler"
    rows = [(i, long if i == 0 else f"boiler\n{i}", "s") for i in range(10)]
    out = {r.doc_id: r.text for r in L.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), ratio=1.0).collect()}
    assert out[0] == long  # exactly at the ratio stays
    out = {r.doc_id: r.text for r in L.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), ratio=0.99).collect()}
    assert out[0] == long.removesuffix("\nboiler") and out[5] == "5"
