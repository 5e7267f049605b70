"""Writers: JSON lines, one JSON document, graph files, replaced index tables and upserts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.dedupe import keep_first
from quernstone.storage import exists, recovered, swap_in


def write_jsonl(df: DataFrame, path: str) -> None:
    """UTF-8 JSON lines; an older output is replaced."""
    df.write.mode("overwrite").json(path)


def graph_document(entities: DataFrame, relations: DataFrame, model: str) -> DataFrame:
    """One row of JSON: entities by falling frequency, relations, counts. For graphs that fit one document; larger ones
    stay tables."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("o"), F.col("first").alias("f"), F.struct("id", "name", "description", "freq").alias("e"))))
    one = entities.agg(F.transform(order, lambda x: x["e"]).alias("entities"), F.count("*").alias("n_e"))
    two = relations.agg(F.sort_array(F.collect_list(F.struct("first", "source", "target", "relation", "weight"))).alias("relationships"), F.count("*").alias("n_r"))
    stats = F.struct(F.col("n_e").alias("total_entities"), F.col("n_r").alias("total_relationships"), F.lit(model).alias("model"))
    return one.crossJoin(two).select(F.to_json(F.struct("entities", "relationships", stats.alias("stats"))).alias("value"))  # one row by one row


def write_document(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)


def _attribute(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
        out = F.replace(out, F.lit(raw), F.lit(ref))
    return F.concat(F.lit('"'), out, F.lit('"'))


def gexf_lines(nodes: DataFrame, edges: DataFrame, description_chars: int = 500) -> DataFrame:
    """(part, line): the lines of a GEXF file, part 0 to 4 in order; nodes: (node, type, description), edges: (source,
    target, weight, label). Lines of a part may come in any order, so they are written in parallel."""
    spark = nodes.sparkSession
    c = F.concat
    lit = F.lit
    fixed = spark.createDataFrame(
        [(0, f'<gexf xmlns={quoteattr("http://www.gexf.net/1.2draft")} version="1.2"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="type" type="string"/><attribute id="1" title="description" type="string"/></attributes><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")],
        "part int, line string",
    )
    name = _attribute(F.col("node"))
    node = c(lit("<node id="), name, lit(" label="), name, lit('><attvalues><attvalue for="0" value='), _attribute(F.col("type")), lit('/><attvalue for="1" value='), _attribute(F.substring("description", 1, description_chars)), lit("/></attvalues></node>"))
    edge = c(lit("<edge source="), _attribute(F.col("source")), lit(" target="), _attribute(F.col("target")), lit(" weight="), _attribute(F.col("weight")), lit(" label="), _attribute(F.col("label")), lit("/>"))
    return fixed.unionByName(nodes.select(lit(1).alias("part"), node.alias("line"))).unionByName(edges.select(lit(3).alias("part"), edge.alias("line")))


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GEXF file as one or more part files whose names sort in order.

    Inside a part lines go by a hash: ranges of the part alone would send all edges to one task.
    """
    gexf_lines(nodes, edges).orderBy("part", F.xxhash64("line")).select("line").write.mode("overwrite").text(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """An index table written anew."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def upsert(df: DataFrame, path: str, key: str, newest: Column) -> None:
    """Rows of df over those of an index table with the same key. The new table is written whole beside the old one and
    then renamed, so that a crash leaves one of them."""
    spark = df.sparkSession
    recovered(spark, path)
    new = f"{path}-{uuid.uuid4().hex}"
    if exists(spark, path):
        both = spark.read.parquet(path).withColumn("_old", F.lit(1)).unionByName(df.withColumn("_old", F.lit(0)), allowMissingColumns=True)
        keep_first(both, [key], ["_old", newest]).drop("_old").write.parquet(new)
    else:
        keep_first(df, [key], [newest]).write.parquet(new)
    swap_in(spark, new, path)


def debug_dump(batch: DataFrame, path: str, enabled: bool) -> None:
    """What each query read and was asked, as JSON lines appended under the path; nothing unless enabled."""
    if enabled:
        batch.write.mode("append").json(path)
