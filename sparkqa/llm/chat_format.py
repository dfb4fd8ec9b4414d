"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own: all turns before it as context and it alone trainable, marked by the
span (target_start, target_chars) in code points. What follows a conversation's last assistant turn (or all of it, where
there is none) becomes one more example without a target, so that no turn is lost.

Template, for each turn: ``<|turn|>role<|text|>text<|end|>``. In roles and texts ``&``, ``<`` and ``[`` are written
``&amp;``, ``&lt;`` and ``&#91;``, so neither the template's marks nor control strings of other templates (``</s>``,
``[INST]``, ``<|im_start|>``) can come from a text; reading back undoes it exactly.

An example holds its whole context, so a conversation of n turns gives rows of that length and output that grows with
n squared, as the method says; rows are made one after the other and no two are held at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template's marks and the escapes.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]


def escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def expand(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (0-based), text, target_start and target_chars (null without a target).

    Turns go by ``turn`` (nulls first), ties by role and then text. Null roles and texts count as empty; rows with a null
    conversation id form one conversation. Repeated rows are repeated turns. An empty table gives no examples. Other
    columns are left out.
    """
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    parts = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT), escaped(t["text"]), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: F.when(t["role"] == target_role, F.length(escaped(t["text"])))).alias("chars"),
        F.size("turns").alias("n"),
    )
    goals = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("chars", i).isNotNull() | (i == F.col("n")))
    each = parts.select("conv_id", "parts", "chars", F.posexplode(goals).alias("example", "upto"))
    made = each.select("conv_id", "example", F.array_join(F.slice("parts", F.lit(1), F.col("upto")), "").alias("text"), F.element_at("chars", F.col("upto")).alias("target_chars"))
    start = F.length("text") - F.col("target_chars") - len(END)
    return made.select("conv_id", "example", "text", start.alias("target_start"), "target_chars")


def read_turns(text: Column) -> Column:
    """The (role, text) turns of an example, read back from its text."""
    pieces = F.filter(F.split(text, r"<\|turn\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(p, TEXT, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
    ))


def read_target(text: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, read back through its span; null without a target."""
    return unescaped(F.substring(text, start + 1, chars))


def digest(examples: DataFrame) -> DataFrame:
    """What can be read back of each conversation: turns of its last example, trainable text of all in order."""
    target = F.struct("example", read_target(F.col("text"), F.col("target_start"), F.col("target_chars")).alias("text"))
    read = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("target_chars").isNotNull(), target))), lambda x: x["text"]), "").alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"),
    ).withColumn("turns", read_turns(F.col("last")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


#: Fixed value: the text of the conversation that the query adds.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    return digest(expand(given.unionByName(more)))


SQL = f"""
WITH given AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}')
), sized AS (
  SELECT *, {len(TURN) + len(TEXT) + len(END)} + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
            + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS chars
  FROM given
), running AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id
"""
