import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import dedupe
from quernstone.sources import readers as R
from quernstone.sources import sinks as K


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    a = write(tmp_path / "a.jsonl", '{"id": "1", "text": "т"}\n\n{bad\n{"text": "no id"}\n')
    rows = {r.id: (r.text, r.title) for r in R.read_jsonl(spark, [a, str(tmp_path / "absent.jsonl")], defaults={"title": "Источник"}).collect()}
    assert rows.pop("1") == ("т", "Источник") and [v for k, v in rows.items() if k.startswith("a_")] == [("no id", "Источник")]
    assert R.read_jsonl(spark, a, keep_bad=True).where("_corrupt IS NOT NULL").count() == 1
    assert R.read_jsonl(spark, [str(tmp_path / "absent")]).count() == 0


def test_texts_and_lines(spark, tmp_path):
    write(tmp_path / "x.md", "one\ntwo\r\nthree")
    write(tmp_path / "y.txt", "other")
    assert [r.text for r in R.read_texts(spark, str(tmp_path), "*.md").collect()] == ["one\ntwo\r\nthree"]
    assert [(r.pos, r.line) for r in R.read_lines(spark, str(tmp_path / "x.md")).collect()] == [(0, "one"), (1, "two"), (2, "three")]


def test_json_documents_and_index(spark, tmp_path):
    path = write(tmp_path / "d.json", json.dumps({"entities": [{"name": "A"}, {"name": "B"}]}, indent=1))
    assert R.read_json_documents(spark, path).select(F.explode("entities.name")).count() == 2
    index = str(tmp_path / "index")
    assert R.read_index(spark, index, lambda: spark.range(3)).count() == 3 and R.read_index(spark, index).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        R.read_index(spark, index + "-absent")


def test_payloads(spark):
    kind = "point_id string, payload struct<id:string,_node_content:string,text:string,title:string,source_url:string,local_img:string,graph_structure:string>"
    rows = [("p1", ("a", '{"text": "inner"}', "outer", "T", "u", None, None)), ("p2", (None, "plain", None, "", None, None, None)), ("p3", (None, "{broken", None, None, None, None, None)), ("p4", (None, None, "outer", None, None, None, None))]
    got = {r.id: (r.text, r.title) for r in R.node_payload(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"a": ("inner", "T"), "p2": ("plain", "Источник"), "p3": ("{broken", "Источник"), "p4": ("outer", "Источник")}


def test_projections(spark):
    graph = "g struct<entities:array<struct<name:string,description:string>>>"
    df = spark.createDataFrame([(([("A", "d" * 60), ("B", None)],),), ((None,),)], graph)
    assert [r.x for r in df.select(R.graph_text(F.col("g")).alias("x")).collect()] == [f"A ({'d' * 50}); B", ""]
    row = spark.range(1).select(R.rendered_node(F.lit("T"), F.lit("u"), F.lit("x")).alias("a"), R.indexed_text(F.lit("T"), F.lit("x"), F.lit(True)).alias("b"), R.document_text(F.lit("T"), F.lit("x")).alias("c")).first()
    assert tuple(row) == ("title: T\nsource_url: u\n\nx", "T\nx", "НАЗВАНИЕ: T\nСОДЕРЖАНИЕ: x")


def test_dictionary(spark, tmp_path):
    path = write(tmp_path / "people.txt", "Иванов Пётр.jpg\n\n Ли.png \n")
    assert [(r.ord, r.variants) for r in R.read_dictionary(spark, path).orderBy("ord").collect()] == [(0, ["иванов пётр", "иванов", "иванов пётр"]), (2, [])]
    assert R.read_dictionary(spark, str(tmp_path / "absent"), ["Петров.jpg"]).first().variants == ["петров", "петров"]


def test_converters(spark, tmp_path):
    write(tmp_path / "a.html", "<p>x &amp; y</p>")
    assert R.read_converted(spark, str(tmp_path)).first().text.split() == ["x", "&", "y"]

    def fails(_):
        raise ValueError("no")

    assert R.read_converted(spark, str(tmp_path), fails, skip_failures=True).first().text is None
    with pytest.raises(Exception, match="no"):
        R.read_converted(spark, str(tmp_path), fails).collect()


def test_lookup(spark):
    def fetch(key):
        if key == "down":
            raise OSError
        return {"a": (200, {"usd": 1.5}), "busy": (429, None)}.get(key, (404, None))

    df = spark.createDataFrame([("a",), ("a",), ("busy",), ("x",), ("down",)], "key string")
    assert sorted((r.key, r.usd) for r in R.lookup(df, fetch, "usd double").where("usd IS NOT NULL").collect()) == [("a", 1.5), ("a", 1.5)]
    assert R.lookup(df, fetch, "usd double").count() == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "é")], "id string, text string")
    for _ in range(2):
        K.write_jsonl(df, str(tmp_path / "out"))
    assert R.read_jsonl(spark, str(tmp_path / "out")).first().text == "é"
    entities = spark.createDataFrame([("ent_0001", "A", "", 1, 5), ("ent_0002", "B", "", 3, 7)], "id string, name string, description string, freq long, first long")
    relations = spark.createDataFrame([(1, "A", "B", "r", 2)], "first long, source string, target string, relation string, weight long")
    K.write_document(K.graph_document(entities, relations, "stub"), str(tmp_path / "doc"))
    doc = json.loads(spark.read.text(str(tmp_path / "doc")).first().value)
    assert [e["name"] for e in doc["entities"]] == ["B", "A"] and doc["stats"] == {"total_entities": 2, "total_relationships": 1, "model": "stub"}


def test_gexf(spark, tmp_path):
    import xml.etree.ElementTree as ET

    nodes = spark.createDataFrame([('a"<', "law", "d" * 600), ("b", "concept", None)], "node string, type string, description string")
    edges = spark.createDataFrame([('a"<', "b", 2, "x, y")], "source string, target string, weight long, label string")
    K.write_gexf(nodes, edges, str(tmp_path / "g"))
    root = ET.fromstring("\n".join(r.value for r in spark.read.text(str(tmp_path / "g")).orderBy(F.input_file_name()).collect()))
    ns = {"g": "http://www.gexf.net/1.2draft"}
    assert {n.get("id") for n in root.findall(".//g:node", ns)} == {'a"<', "b"} and root.find(".//g:edge", ns).get("label") == "x, y"


def test_gexf_edges_go_to_several_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "law", "d")], "node string, type string, description string")
    edges = spark.range(4_000).select(F.concat(F.lit("a"), "id").alias("source"), F.lit("b").alias("target"), F.lit(1).alias("weight"), F.lit("x").alias("label"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        K.write_gexf(nodes, edges, str(tmp_path / "g"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = spark.read.text(str(tmp_path / "g")).where("value LIKE '<edge %'").groupBy(F.input_file_name()).count()
    sizes = [r["count"] for r in lines.collect()]
    assert sum(sizes) == 4_000 and max(sizes) < 2_000


def test_upsert_and_sets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    K.upsert(rows((1, "a"), (2, "b")), path, "id", F.col("v"))
    K.upsert(rows((2, "c"), (3, "d")), path, "id", F.col("v"))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    K.replace_table(rows((9, "z")), path)
    assert spark.read.parquet(path).count() == 1
    todo = rows((1, "x"), (2, "y"), (None, "n"))
    assert sorted(r.v for r in dedupe.unprocessed(todo, rows((1, "")), "id").collect()) == ["n", "y"]
    assert sorted(r.v for r in dedupe.resume(todo, rows((1, "done")), "id", lambda d: d).collect()) == ["done", "n", "y"]
    assert dedupe.keep_first_text(rows((2, "t"), (1, "t"), (3, None), (4, None)), "v", ["id"]).count() == 2
    assert dedupe.union_all(rows((1, "a")), spark.createDataFrame([(1, 2)], "id long, w long")).columns == ["id", "v", "w"]
