"""Operator 4: chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns are cut into windows of at most WINDOW tokens. Prefix sums of the turns' tokens choose the
spans: a turn belongs to the stretch of the budget in which it starts, and one that runs over a stretch's end is a
window of its own, so a span never depends on the spans before it. Every window begins with the system turn, then
repeats up to HISTORY_TURNS turns (HISTORY tokens) of what came before, then holds its own turns. The loss mask is on
the assistant texts of a window's own turns: repeated targets are masked. A turn longer than the budget stays whole,
in a window that is then over it.

Prefix sums are taken in blocks of BLOCK turn numbers and then over the blocks, so that a conversation that holds a
third of all rows is many tasks; windows are grouped by (conversation, window). Texts are shuffled twice, to be numbered
and to meet their window: blocks are summed up, and turns that repeat are picked, by numbers. Turns of one number, and
those without one, share a block.

The system turn is part of every window whatever its length: one of S tokens leaves a window at least LEAST tokens for
other turns, so from S = WINDOW - HISTORY - LEAST on windows are over the budget and the output grows by S a window.

Template: "<|role|>\\n" text "</s>\\n". A backslash in a role or text is doubled and control strings get one after their
first character, which reading back undoes. Null texts and roles count as empty, null ids are a conversation
(which an empty id is not part of), null turns come first; turns with equal numbers are ordered by role and text. An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import bounded, read, stored

WINDOW, HISTORY, HISTORY_TURNS, LEAST = 1024, 256, 2, 64
BLOCK = 256
#: Repeated turns, at some 60 bytes each, up to which their numbers are broadcast; beyond that they are joined.
MAX_BROADCAST_TURNS = 500_000
CONTROLS = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"]
END = "</s>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    """Tokens that a turn is budgeted with: its marks and a token for each four characters."""
    return (F.lit(4) + F.ceil(F.length(text) / 4)).cast("long")


def _numbered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with their place, the tokens before them, and the system turn's tokens (0 without one)."""
    rows = df.select(
        F.when(F.col(conv).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv).cast("string"))).alias("c"), F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    rows = rows.withColumn("tokens", turn_tokens(F.col("text"))).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(2**62))))
    # The first turn of a block, in the order of the window below; only one text a block goes through this.
    first = F.min(F.struct(F.struct(F.col("turn").isNotNull(), "turn", "role", "text"), "role", "tokens"))
    per_block = rows.groupBy("c", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), first.alias("f"))
    per_block = per_block.select("c", "block", "n", "sum", F.when(F.col("f.role") == "system", F.col("f.tokens")).alias("head"))
    order = Window.partitionBy("c", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("p", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = Window.partitionBy("c").orderBy("block")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    bases = per_block.select("c", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("i0"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("p0"), F.coalesce(F.first("head").over(blocks), F.lit(0)).alias("system"))
    out = rows.join(bases, ["c", "block"])
    return out.select("c", "conv_id", "role", "text", "tokens", (F.col("i") + F.col("i0")).alias("idx"), (F.col("p") + F.col("p0")).alias("before"), "system")


def format_windows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", window: int = WINDOW, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """(conv_id, window, formatted, n_context, loss, n_tokens): loss holds start and length of the spans that are targets.

    The first n_context turns of a window are repeated (the system turn and history).
    """
    turns = _numbered(df, conv, turn, role, text)
    head = (F.col("system") > 0) & (F.col("idx") == 0)
    budget = F.greatest(F.lit(LEAST), F.lit(window - history) - F.col("system"))
    start = F.col("before") - F.col("system")
    stretch = F.floor(start / budget).cast("long")
    own = F.when(head, F.lit(0)).otherwise(2 * stretch + F.when(start + F.col("tokens") > (stretch + 1) * budget, 1).otherwise(0))
    turns = stored(turns.withColumn("window", own.cast("long")).withColumn("is_system", head))
    windows = turns.groupBy("c", "window").agg(F.min("idx").alias("first"), F.min("before").alias("begin"), F.max("system").alias("system")).where("first > 0")
    repeats = F.array(*([F.col("first") - d for d in range(1, history_turns + 1)]))
    asked = F.filter(F.when(F.col("system") > 0, F.concat(F.array(F.lit(0).cast("long")), F.filter(repeats, lambda x: x > 0))).otherwise(repeats), lambda x: x >= 0)
    # Most conversations are one window and repeat nothing: what is asked for is picked by numbers before texts move.
    wanted = bounded(stored(windows.select("c", "window", "begin", F.explode(asked).alias("idx"))), MAX_BROADCAST_TURNS)
    context = turns.drop("window", "system").join(wanted, ["c", "idx"])
    context = context.where(F.col("is_system") | (F.col("begin") - F.col("before") <= history))
    columns = ["c", "conv_id", "window", "idx", "role", "text", "tokens"]
    both = turns.select(*columns, F.lit(True).alias("own")).unionByName(context.select(*columns, F.lit(False).alias("own")))
    lead, body = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")), escape(F.col("text"))
    part = F.struct("idx", lead.alias("lead"), body.alias("body"), "own", (F.col("own") & (F.col("role") == "assistant")).alias("target"), "tokens")
    grouped = both.groupBy("c", "window").agg(F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(part)).alias("parts"))
    empty = F.expr("named_struct('at', 0L, 'loss', cast(array() AS array<struct<start:bigint,length:bigint>>))")

    def walk(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["lead"])
        span = F.struct(begin.cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length"))
        loss = F.when(x["target"], F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"])
        return F.struct((begin + F.length(x["body"]) + len(END)).cast("long").alias("at"), loss.alias("loss"))

    return grouped.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda x: F.concat(x["lead"], x["body"], F.lit(END))), "").alias("formatted"),
        F.size(F.filter("parts", lambda x: ~x["own"])).alias("n_context"),
        F.aggregate("parts", empty, walk, lambda acc: acc["loss"]).alias("loss"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, loss_text, formatted_chars): own turns and targets as the formatted text has them."""
    pieces = F.split(F.col("formatted"), "</s>\n", -1)
    own = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))
    turns = F.transform(own, lambda x: F.struct(unescape(x.substr(F.lit(3), F.instr(x, F.lit("|>\n")) - 3)).alias("role"), unescape(x.substr(F.instr(x, F.lit("|>\n")) + 3, F.length(x))).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation, from what its windows read back as; a digest needs all of a conversation's text."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(windows).select("conv_id", "formatted_chars", F.struct("window", said.alias("said"), "loss_text").alias("x"), F.size("turns").cast("long").alias("n"))
    one = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list("x")).alias("x"))
    loss = F.array_join(F.transform("x", lambda w: w["loss_text"]), "")
    return one.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("x", lambda w: w["said"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_windows(table.unionByName(extra)))


def _sql_escape(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in CONTROLS:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


ORACLE_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, row_number() OVER w - 1 AS idx, 4 + CAST(ceil(length(text) / 4) AS BIGINT) AS tokens,
         10 + length({_sql_escape('role')}) + length({_sql_escape('text')}) AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         coalesce(max(CASE WHEN idx = 0 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS system
  FROM t
), b AS (SELECT *, greatest(64, 768 - system) AS budget, before - system AS start FROM p
), k AS (
  SELECT *, CASE WHEN system > 0 AND idx = 0 THEN 0
    ELSE 2 * (start // budget) + CASE WHEN start + tokens > (start // budget + 1) * budget THEN 1 ELSE 0 END END AS win
  FROM b
), wins AS (SELECT conv_id, win, min(idx) AS first, min(before) AS begin, max(system) AS system FROM k GROUP BY conv_id, win HAVING min(idx) > 0
), context AS (
  SELECT w.conv_id, k.chars FROM wins w JOIN k ON k.conv_id = w.conv_id AND
    ((w.system > 0 AND k.idx = 0) OR (k.idx BETWEEN w.first - 2 AND w.first - 1 AND NOT (w.system > 0 AND k.idx = 0) AND w.begin - k.before <= 256))
), shown AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, chars FROM k UNION ALL SELECT * FROM context) GROUP BY conv_id)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(any_value(shown.chars) AS BIGINT) AS formatted_chars
FROM k JOIN shown USING (conv_id) GROUP BY conv_id
"""
