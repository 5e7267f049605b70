"""Queries of sources and sinks: whole tables are written to the shared folder in an interchange form and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import dedupe, graph, lexical, serving
from quernstone.plans import graph_queries as G
from quernstone.plans.registry import query
from quernstone.plans.retrieval_queries import RANKED, _asked, _docs, _shown, sql_lexical
from quernstone.session import table, worker_path
from quernstone.sources import readers as R
from quernstone.sources import sinks as K
from quernstone.storage import new_path
from quernstone.streaming import operators as S


@query("SELECT 'doc_' || doc_id AS id, coalesce(source, 'Источник') AS title, coalesce(text, '') AS text FROM documents")
def source_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines and back, beside a file that isn't there."""
    path = new_path(spark, "jsonl")
    docs = table(spark, sf_dir, "documents")
    K.write_jsonl(docs.select(F.concat(F.lit("doc_"), "doc_id").alias("id"), F.col("source").alias("title"), "text"), path)
    rows = R.read_jsonl(spark, [path, f"{path}-absent"], defaults={"title": "Источник", "text": ""})
    return rows.select("id", "title", "text")


def _nation_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a text file for each region, of its nations in order."""
    path = new_path(spark, "texts")
    rows = table(spark, sf_dir, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey")
    rows.select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(path)
    return path


def _region() -> Column:
    return F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int")


@query("SELECT CAST(n_regionkey AS INTEGER) AS region, string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole text files of a folder and its subfolders."""
    return R.read_texts(spark, _nation_files(spark, sf_dir), "*.txt", recursive=True).select(_region().alias("region"), "text")


@query("SELECT CAST(n_regionkey AS INTEGER) AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, n_name AS line FROM nation")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.read_lines(spark, f"{_nation_files(spark, sf_dir)}/*")
    return rows.where("line <> ''").select(_region().alias("region"), "pos", "line")


@query(
    f"""WITH {G.SQL_MENTIONS}, e AS (SELECT norm, arg_min(name, seq) AS name, count(*) AS freq, min(seq) AS first FROM m GROUP BY norm
), n AS (SELECT *, row_number() OVER (ORDER BY first) AS n FROM e)
SELECT CAST(row_number() OVER (ORDER BY freq DESC, first) - 1 AS INTEGER) AS pos, 'ent_' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS id, name, CAST(freq AS BIGINT) AS freq FROM n"""
)
def source_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity graph as one JSON document, entities by falling frequency, and its entities read back."""
    path = new_path(spark, "json")
    entities = graph.with_entity_ids(graph.entity_rollup(G._mentions(spark, sf_dir)))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.expr(G.SEQ).cast("long").alias("seq"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("target"), F.lit("связан с").alias("relation"))
    K.write_document(K.graph_document(entities, graph.edge_rollup(lines), "none"), path)
    found = R.read_json_documents(spark, path, f"{R.GRAPH.replace('name: STRING, description: STRING', 'id: STRING, name: STRING, description: STRING, freq: BIGINT')}")
    return found.select(F.posexplode("entities").alias("pos", "e")).select("pos", "e.id", "e.name", "e.freq")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def index_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned index table that isn't there yet, so it is built, written over an older one and loaded."""
    path = new_path(spark, "index")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    K.replace_table(R.read_index(spark, f"{path}-first", lambda: orders), path, ["o_orderstatus"])
    K.replace_table(orders, path, ["o_orderstatus"])
    return R.read_index(spark, path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey - 1, 'new' FROM orders WHERE o_totalprice > 100000")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an index, over which changed and new rows are put."""
    path = new_path(spark, "index")
    orders = table(spark, sf_dir, "orders")
    K.replace_table(orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), path)
    large = orders.where("o_totalprice > 100000")
    fresh = large.select("o_orderkey", F.lit("large").alias("status")).unionByName(large.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("new").alias("status")))
    K.upsert(fresh, path, "o_orderkey", F.col("status"))
    return R.read_index(spark, path)


@query(
    """SELECT CASE WHEN lang = 'en' THEN 'doc_' || doc_id ELSE 'p' || doc_id END AS id, CASE lang WHEN 'de' THEN '{' || text ELSE text END AS text,
CASE WHEN coalesce(source, '') = '' THEN 'Источник' ELSE source END AS title FROM documents"""
)
def payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index points whose text is inside JSON, plain, behind a broken brace, or in the payload itself."""
    inner = F.when(F.col("lang") == "en", F.to_json(F.struct("text"))).when(F.col("lang") == "fr", F.col("text")).when(F.col("lang") == "de", F.concat(F.lit("{"), "text"))
    none = F.lit(None).cast("string")
    payload = F.struct(F.when(F.col("lang") == "en", F.concat(F.lit("doc_"), "doc_id")).alias("id"), inner.alias("_node_content"), F.col("text").alias("text"), F.col("source").alias("title"), none.alias("source_url"), none.alias("local_img"), none.alias("graph_structure"))
    points = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), "doc_id").alias("point_id"), payload.alias("payload"))
    return R.node_payload(points).select("id", "text", "title")


@query(
    r"""WITH n AS (SELECT DISTINCT trim(p_name) || '.jpg' AS f, lower(p_name) AS name FROM part), s AS (SELECT f, name, string_split_regex(trim(name), '\s+') AS p FROM n)
SELECT f AS file_name, array_to_string([v FOR v IN [name, p[1], CASE WHEN len(p) >= 2 THEN p[1] || ' ' || p[2] END] IF length(v) > 5], '|') AS variants FROM s"""
)
def person_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary file, one name in a line, with what each name is called."""
    path = new_path(spark, "dictionary")
    table(spark, sf_dir, "part").select(F.concat(F.btrim("p_name"), F.lit(".jpg")).alias("value")).distinct().write.text(path)
    return R.read_dictionary(spark, path).select("file_name", F.array_join("variants", "|").alias("variants"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN user_id * 1.5 END AS usd FROM events")
def http_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's price from a service that answers a third of the keys, is busy for a third and fails for a third."""

    def fetch(key: int) -> tuple[int, dict | None]:
        if key % 3 == 2:
            raise TimeoutError
        return (200, {"usd": key * 1.5}) if key % 3 == 0 else (429, None)

    worker_path(spark)
    return R.lookup(table(spark, sf_dir, "events").select("event_id", "user_id"), fetch, "usd DOUBLE", "user_id").select("event_id", "usd")


def _message_files(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "messages")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("message_id"), F.concat(F.col("conv_id"), F.lit("_"), F.col("turn")).alias("request_id"), F.when(F.col("role") != "system", F.col("text")).alias("text"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("query"))
    rows.write.json(path)
    return path


@query("SELECT conv_id AS chat_id, turn AS message_id, text FROM conversations WHERE role <> 'system' AND text IS NOT NULL")
def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages as a stream of JSON; those without a text go."""
    return S.append_once(R.read_messages(spark, _message_files(spark, sf_dir)).select("chat_id", "message_id", "text"))


@query("SELECT conv_id || '_' || turn AS request_id, trim(text) AS query FROM conversations WHERE trim(text) <> ''")
def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.append_once(R.read_requests(spark, _message_files(spark, sf_dir)).select("request_id", "query"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id")
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream that is audited on its way, and their sums."""
    rows = S.audited(S.table_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "value"), "events", "value")
    return S.append_once(rows).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH {sql_lexical()} SELECT {RANKED} FROM ltop WHERE rank <= 10")
def bm25_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark question, from an index of each document's postings that is built once, written and loaded."""
    path = new_path(spark, "bm25")
    index = R.read_index(spark, path, lambda: lexical.index_of(_docs(spark, sf_dir)))
    return _shown(lexical.indexed_top(lexical.loaded(index), _asked(spark, sf_dir), 10))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq, type, content FROM (SELECT doc_id, 0 AS pos, 'metadata' AS type, CASE WHEN n > 0 THEN 'true' ELSE 'false' END AS content FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL) UNION ALL SELECT doc_id, generate_subscripts(w, 1), 'text', unnest(w) FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL) UNION ALL SELECT doc_id, 1000000000, 'end', '' FROM documents WHERE text IS NOT NULL)")
def event_stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer events as lines of JSON, read back by a consumer that skips what isn't JSON."""
    path = new_path(spark, "events")
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ").alias("tokens"))
    events = serving.events_of(rows, "doc_id").select(F.to_json(F.struct("doc_id", "seq", "type", "content")).alias("value"))
    events.unionByName(spark.createDataFrame([("",), ("{broken",)], "value string")).write.text(path)
    found = R.read_jsonl(spark, path, "doc_id BIGINT, seq BIGINT, type STRING, content STRING", id_column=None)
    return found.select("doc_id", (F.col("seq") + 1).alias("seq"), "type", "content")


@query("SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL")
def debug_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question was asked, appended as JSON lines while the flag is on, and nothing while it is off."""
    path = new_path(spark, "debug")
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    K.debug_dump(rows, path, False)
    K.debug_dump(rows.where("role = 'user'"), path, True)
    K.debug_dump(rows.where("role <> 'user'"), path, True)
    return spark.read.schema("conv_id BIGINT, turn BIGINT, text STRING").json(path)


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 2 END AS round FROM documents")
def checkpoint_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work done in two rounds: each appends what it did, and the second takes up only what the first left."""
    path = new_path(spark, "done")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    labelled.withColumn("round", F.lit(1)).write.mode("append").parquet(path)
    left = dedupe.unprocessed(docs, spark.read.parquet(path), "doc_id")
    left.withColumn("round", F.lit(2)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(
    f"""WITH {G.SQL_EDGES} SELECT '<node id="' || node || '" label="' || node || '"><attvalues><attvalue for="0" value="concept"/><attvalue for="1" value="' || CAST(degree AS VARCHAR) || '"/></attvalues></node>' AS line FROM d
UNION ALL SELECT '<edge source="' || source || '" target="' || target || '" weight="' || weight || '" label="' || label || '"/>' FROM g"""
)
def gexf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part and supplier graph as a GEXF file; its lines of nodes and edges."""
    path = new_path(spark, "gexf")
    edges = G._merged(spark, sf_dir)
    nodes = graph.degrees(edges).select("node", F.lit("concept").alias("type"), F.col("degree").cast("string").alias("description"))
    K.write_gexf(nodes, edges, path)
    return spark.read.text(path).where("value LIKE '<node %' OR value LIKE '<edge %'").select(F.col("value").alias("line"))


@query(
    """WITH p AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, coalesce(text, '')) AS p FROM conversations GROUP BY conv_id
), w AS (SELECT conv_id, p, length(array_to_string(p, chr(10) || chr(10))) > 300 AS long FROM p
), g AS (SELECT conv_id, CASE WHEN long THEN [array_to_string(p[i : i + 2], chr(10) || chr(10)) FOR i IN range(1, len(p) + 1, 3)] ELSE [array_to_string(p, chr(10) || chr(10))] END AS m FROM w)
SELECT conv_id, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS idx, unnest(m) AS message FROM g"""
)
def split_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one message, or as messages of three turns each where it has over 300 characters."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.coalesce("text", F.lit("")).alias("t")).alias("s"))
    parts = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["t"]).alias("parts"))
    return parts.select("conv_id", F.posexplode(serving.split_messages(F.col("parts"), 300)).alias("idx", "message"))


@query("SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id")
def health_and_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user work handed to tasks and gathered again, behind a probe that Spark and the shared folder answer."""
    if not serving.healthy(spark):
        raise RuntimeError("the shared folder can't be written")
    return serving.fanned_out(table(spark, sf_dir, "events").select("user_id"), "user_id", lambda key, rows: {"n_events": len(rows)}, "n_events BIGINT", timeout=60.0)


