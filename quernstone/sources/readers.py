"""Readers: JSON lines, texts, directories, JSON documents, index payloads, dictionaries, and providers for other forms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from html import unescape

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.storage import recovered

#: Interchange records.
CHUNK = "id STRING, title STRING, text STRING, local_img STRING, url STRING, law STRING, article STRING, chunk_index INT, tokens INT, page STRING"
GRAPH = "entities ARRAY<STRUCT<name: STRING, description: STRING>>, relationships ARRAY<STRUCT<source: STRING, target: STRING, relation: STRING>>"
REQUEST = "request_id STRING, query STRING, ts TIMESTAMP"
MESSAGE = "chat_id BIGINT, message_id BIGINT, user_name STRING, text STRING, reply_text STRING, ts TIMESTAMP"


def existing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The paths that are there, in any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str = CHUNK, defaults: dict | None = None, id_column: str | None = "id", keep_bad: bool = False) -> DataFrame:
    """Rows of JSON lines files: blank lines skipped, bad ones dropped (or kept in _corrupt), absent files ignored.

    Missing fields get their default; a missing id is made of the file's name and the row's place in its partition.
    """
    found = existing(spark, [paths] if isinstance(paths, str) else paths)
    full = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not found:
        return spark.createDataFrame([], full)
    with_bad = T.StructType([*full.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(found).where(F.btrim("value") != "").select(parsed.alias("_r")).select("_r.*")
    if id_column:
        made = F.concat_ws("_", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), F.lit(r"\.\w+$"), F.lit("")), F.monotonically_increasing_id().cast("string"))
        rows = rows.withColumn(id_column, F.coalesce(id_column, made))
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(value)))
    return rows if keep_bad else rows.where("_corrupt IS NULL").drop("_corrupt")


def read_texts(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, text): whole files; glob as for *.md."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line): lines in order."""
    return read_texts(spark, path).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))


def read_json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole files of nested JSON."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_index(spark: SparkSession, path: str, rebuild: Callable[[], DataFrame] | None = None) -> DataFrame:
    """A persisted index table; where it is absent or no table it is rebuilt and written. Other errors, which may pass, are
    raised and leave what is there."""
    recovered(spark, path)
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if rebuild is None or not re.search("PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA", str(e)):
            raise
        rebuild().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def node_payload(points: DataFrame, payload: str = "payload", point_id: str = "point_id") -> DataFrame:
    """(id, text, title, source_url, local_img, graph_structure) of index points.

    The text is that of the JSON in _node_content; a string that isn't JSON is the text itself, and the payload's own
    text comes last.
    """
    p = lambda name: F.col(f"{payload}.{name}")
    raw = p("_node_content")
    inner = F.when(F.startswith(F.btrim(raw), F.lit("{")), F.coalesce(F.get_json_object(raw, "$.text"), F.when(F.try_parse_json(raw).isNull(), raw))).otherwise(raw)
    filled = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return points.select(
        F.coalesce(F.nullif(p("id"), F.lit("")), F.col(point_id)).alias("id"), F.coalesce(F.nullif(inner, F.lit("")), p("text"), F.lit("")).alias("text"),
        filled(p("title"), "Источник").alias("title"), filled(p("source_url"), "").alias("source_url"), filled(p("local_img"), "").alias("local_img"), filled(p("graph_structure"), "").alias("graph_structure"),
    )


def rendered_node(title: Column, source: Column, text: Column) -> Column:
    """What BM25 indexes: metadata lines, a blank line, the text."""
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("")), F.lit("\nsource_url: "), F.coalesce(source, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit("")))


def indexed_text(title: Column, text: Column, is_person: Column) -> Column:
    """The text to embed: a person's with the title before it."""
    return F.when(is_person, F.concat_ws("\n", title, text)).otherwise(text)


def document_text(title: Column, text: Column) -> Column:
    return F.concat(F.lit("НАЗВАНИЕ: "), F.coalesce(title, F.lit("")), F.lit("\nСОДЕРЖАНИЕ: "), F.coalesce(text, F.lit("")))


def graph_text(graph: Column, most: int = 7, description_chars: int = 50) -> Column:
    """Entities as "name (description)", joined by semicolons; names alone where there is no description."""
    one = lambda e: F.when(F.coalesce(e["description"], F.lit("")) != "", F.concat(e["name"], F.lit(" ("), F.substring(e["description"], 1, description_chars), F.lit(")"))).otherwise(e["name"])
    return F.coalesce(F.array_join(F.transform(F.slice(graph["entities"], 1, most), one), "; "), F.lit(""))


def read_dictionary(spark: SparkSession, path: str, default: Sequence[str] = ()) -> DataFrame:
    """(ord, file_name, variants): a file of names, one in a line, or the default where there is none."""
    from quernstone.operators.serving import name_variants

    if existing(spark, [path]):
        rows = read_lines(spark, path).select("pos", F.btrim("line").alias("file_name")).where("file_name <> ''")
    else:
        rows = spark.createDataFrame(list(enumerate(default)), "pos int, file_name string")
    return rows.select(F.col("pos").alias("ord"), "file_name", name_variants(F.col("file_name")).alias("variants"))


Convert = Callable[[bytes], str]


def strip_html(content: bytes) -> str:
    """The offline stand-in of a layout-aware converter: tags off, references decoded."""
    return unescape(re.sub(r"<[^>]+>", " ", content.decode("utf-8", "replace")))


def read_converted(spark: SparkSession, path: str, convert: Convert = strip_html, glob: str = "*.html", skip_failures: bool = False) -> DataFrame:
    """(path, text) of binary documents through a converter; a failure ends the job unless failures are skipped (null)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        def one(c: bytes) -> str | None:
            try:
                return convert(bytes(c))
            except Exception:
                if skip_failures:
                    return None
                raise

        return content.map(one)

    return files.select("path", run("content").alias("text"))


def lookup(keys: DataFrame, fetch: Callable[[str], tuple[int, dict | None]], fields: str, key: str = "key", retry_status: int = 429, wait: Callable[[float], None] | None = None) -> DataFrame:
    """keys with what a service gives for each, through fetch (status, values): one wait and then null when it is busy,
    null for any other failure. Each distinct key is asked for once."""
    schema = T._parse_datatype_string(fields)
    names = schema.fieldNames()

    def run(frames):
        for frame in frames:
            rows = []
            for k in frame[key]:
                try:
                    status, values = fetch(k)
                    if status == retry_status and wait:
                        wait(1.0)
                    ok = status == 200 and values is not None
                except Exception:
                    ok, values = False, None
                rows.append((k, *((values or {}).get(n) if ok else None for n in names)))
            yield pd.DataFrame(rows, columns=[key, *names]).astype(object)

    found = keys.select(key).distinct().mapInPandas(run, T.StructType([keys.schema[key], *schema.fields]))
    return keys.join(found, key, "left")


def read_messages(spark: SparkSession, path: str, schema: str = MESSAGE) -> DataFrame:
    """A stream of JSON messages from a folder; those without a text are dropped."""
    return spark.readStream.schema(schema).json(path).where("text IS NOT NULL")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A stream of requests; longer blanks trimmed, empty ones dropped."""
    return spark.readStream.schema(REQUEST).json(path).withColumn("query", F.btrim("query")).where("query <> ''")
