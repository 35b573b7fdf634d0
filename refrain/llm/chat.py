"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text trainable. A
conversation that ends otherwise (or has no assistant turn) yields one more example without a trainable part, so that no turn
is lost.

A turn reads `<s>[INST] role [/INST] text </s>`. Where a control string, or one behind backslashes, is in a role or text, one
more backslash goes before it; a control string that no backslash precedes is thus always the template's own, as the template puts
a blank between a text and the control string behind it.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.common import read

#: Control strings; fixed values of the template.
CONTROL = r"(?:<s>|</s>|\[INST\]|\[/INST\])"
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", " </s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*+{CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+{CONTROL})", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0 in a conversation), n_turns, last, formatted, loss_start and loss_chars.

    loss_start and loss_chars say which code points of formatted are trainable; without a trainable part both are 0. `last` marks
    the example that holds all turns. Turns are ordered by turn, then role, then text, nulls first; repeated turns all count. Null
    roles and texts are empty. Rows with a null conv_id are one conversation. Other columns are not looked at. Texts are taken whole; a
    conversation is a row of one task, and its examples are as long as all its prefixes. A table without rows gives none.
    """
    blank = F.lit("")
    own = conversations.select("conv_id", F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")).alias("t"))
    told = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    told = told.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("target"), escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    told = told.select("conv_id", "turns", F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))).alias("parts"))
    told = told.withColumn("n", F.size("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.get("turns", i - 1)["target"] | (i == F.col("n")))
    each = told.select("conv_id", "turns", "parts", "n", F.posexplode(ends).alias("example", "n_turns"))
    final = F.get("turns", F.col("n_turns") - 1)
    each = each.select("conv_id", "example", "n_turns", (F.col("n_turns") == F.col("n")).alias("last"), F.array_join(F.slice("parts", F.lit(1), F.col("n_turns")), "").alias("formatted"), final.alias("final"))
    loss = F.when(F.col("final.target"), F.length("final.text")).otherwise(0)
    return each.select("conv_id", "example", "n_turns", "last", "formatted", F.when(F.col("final.target"), F.length("formatted") - len(CLOSE) - loss).otherwise(0).alias("loss_start"), loss.alias("loss_chars"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    parts = F.split(formatted, CLOSE, -1)

    def turn(part: Column) -> Column:
        at = F.call_function("instr", part, F.lit(MIDDLE))
        return F.struct(unescape(F.substring(part, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))).alias("role"), unescape(F.substring(part, at + len(MIDDLE), F.length(part))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_of(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of a formatted example."""
    return unescape(F.substring(formatted, start + 1, chars))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation and of -1, read back from its examples.

    Null roles and texts are empty; equal turns are ordered by role, then text, and repeated ones all count; rows with a
    null conv_id are one conversation; a table without rows gives conversation -1 alone; other columns are not looked at.
    """
    added = spark.sql(r"SELECT -1L AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    made = examples(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))
    found = made.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("last"), turns_of(F.col("formatted"))).alias("turns"),
        loss_of(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    found = found.select("conv_id", "example", "chars", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), "loss")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    result = found.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), joined.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return result.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


OP5_SQL = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + length(role) + 24
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
    count(*) OVER (PARTITION BY conv_id) AS turns
  FROM every
), prefixed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS prefix FROM sized
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR n = turns THEN prefix ELSE 0 END)::BIGINT AS formatted_chars
FROM prefixed GROUP BY conv_id
"""
