"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is ``<s>role[INST]text[/INST]``, and ``</s>`` follows a trainable reply.
Inside roles and texts a backslash is doubled, and one is put behind the first
character of every control string, so none is left; taking the character after
each backslash restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import table

ASSISTANT = "assistant"


def escape(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), "([\\[<])(/?(?:INST\\]|s>))", "$1\\\\$2")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, "(?s)\\\\(.)", "$1")


def render(turns: Column) -> Column:
    """The text of an array of turns (struct role, text)."""
    one = lambda t: F.concat(F.lit("<s>"), escape(t["role"]), F.lit("[INST]"), escape(t["text"]), F.lit("[/INST]"), F.when(t["role"] == ASSISTANT, F.lit("</s>")).otherwise(F.lit("")))
    return F.array_join(F.transform(turns, one), "")


def read_back(formatted: Column) -> Column:
    """The turns of a rendered text, as an array of struct role, text."""
    cut = lambda t: F.split(t, "\\[INST\\]|\\[/INST\\]", -1)
    return F.transform(
        F.slice(F.split(formatted, "<s>", -1), 2, 1 << 30),
        lambda t: F.struct(unescape(F.get(cut(t), 0)).alias("role"), unescape(F.get(cut(t), 1)).alias("text")),
    )


def expand_conversations(turns: DataFrame) -> DataFrame:
    """One example per assistant turn: everything up to it, only it trainable.

    Takes conv_id, turn, role, text.  Returns conv_id, example (the number of
    turns in it), formatted, loss_start and loss_length (code points, from 0).
    A conversation whose last turn is not the assistant's has one example more,
    of all its turns and nothing trainable (loss_start null), so no turn is
    lost.  Turns are ordered by turn, role, text (nulls first); repeated rows
    are turns of their own; null roles and texts are empty; a null conv_id is a
    conversation; other columns are ignored; an empty table gives no example.
    One conversation is one row here, as its longest example is.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.get("turns", i - 1)["role"] == ASSISTANT) | (i == F.size("turns")))
    examples = convs.select("conv_id", "turns", F.explode(ends).alias("example"))
    last = F.element_at("turns", F.col("example"))
    examples = examples.select("conv_id", "example", render(F.slice("turns", 1, F.col("example"))).alias("formatted"), last.alias("last"))
    tail = F.length(escape(F.col("last.text")))
    reply = F.col("last.role") == ASSISTANT
    return examples.select(
        "conv_id",
        "example",
        "formatted",
        F.when(reply, F.length("formatted") - tail - len("[/INST]</s>")).alias("loss_start"),
        F.when(reply, tail).alias("loss_length"),
    )


def digest_examples(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, read back from them."""
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    by = examples.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted")).alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("loss"))))).alias("losses"),
    )
    turns = read_back(F.col("longest.formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return by.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("longest.formatted").cast("long").alias("formatted_chars"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest_examples(expand_conversations(turns))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([\[<])(/?(?:INST\]|s>))', '\1_\2', 'g'))
          + length(regexp_replace(replace(role, '\', '\\'), '([\[<])(/?(?:INST\]|s>))', '\1_\2', 'g')) + 16
          + CASE WHEN role = 'assistant' THEN 4 ELSE 0 END AS chars FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
