"""Chat formatting: every assistant turn becomes an example with all turns before it, and only it is trained on.

A turn is written as `<turn role>`, a line feed, the text, `</turn>` and a line feed. The role is URL-encoded. In a text a
backslash is doubled, and `<turn` and `</turn` get a backslash after the `<`; so neither string occurs in a written text,
and taking away the backslash before each character restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_END = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"<(?=/?turn)", r"<\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def written(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<turn "), F.url_encode(role), F.lit(">\n"), escaped(text), F.lit(_END))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text)."""
    parts = F.split(formatted, _END, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            F.url_decode(F.substring_index(F.substring(p, 7, 1 << 30), ">\n", 1)).alias("role"),
            unescaped(F.substr(p, F.instr(p, ">\n") + 2)).alias("text"),
        ),
    )


def prefix_targets(conversations: DataFrame, keep_tail: bool = True) -> DataFrame:
    """Examples of conversations (conv_id, turn, role, text): conv_id, example (from 0), n_turns, is_last, formatted (text),
    loss_start and loss_chars (code points of the trainable span: the text of the last turn; null and 0 for a tail).

    Rows go by turn, nulls first; equal turns by role, then text; repeated rows stay. A null text or role is empty; null
    conv_ids are one conversation. With keep_tail, a conversation whose last turn isn't an assistant's gets one more example
    with all turns and no trainable span, so that the output holds every turn. Extra columns are left out. A conversation is
    gathered in one row, and its examples together are as long as the square of its turns: that is what the format asks for.
    An empty table gives no example."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    whole = whole.select(
        "conv_id",
        F.transform("t", lambda t: t["role"] == "assistant").alias("ours"),
        F.transform("t", lambda t: written(t["role"], t["text"])).alias("w"),
        F.size("t").alias("n"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: F.col("ours")[k - 1] | (F.lit(keep_tail) & (k == F.col("n"))))
    each = whole.select("conv_id", "ours", "w", "n", F.posexplode(ends).alias("example", "k"))
    prefix, last = F.array_join(F.slice("w", F.lit(1), F.col("k") - 1), ""), F.col("w")[F.col("k") - 1]
    each = each.select("conv_id", "example", F.col("k").alias("n_turns"), (F.col("k") == F.col("n")).alias("is_last"), F.col("ours")[F.col("k") - 1].alias("trained"), prefix.alias("prefix"), last.alias("last"))
    head = F.instr(F.col("last"), ">\n") + 1
    return each.select(
        "conv_id", "example", "n_turns", "is_last", F.concat("prefix", "last").alias("formatted"),
        F.when(F.col("trained"), F.char_length("prefix") + head).alias("loss_start"),
        F.when(F.col("trained"), F.char_length("last") - head - len(_END)).otherwise(0).alias("loss_chars"),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped; empty where there is none."""
    return F.coalesce(unescaped(F.substr(formatted, start + 1, chars)), F.lit(""))


def digests(examples: DataFrame) -> DataFrame:
    """A row per conversation, read back from the formatted examples."""
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    each = examples.select(
        "conv_id", "example",
        F.when(F.col("is_last"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(F.array_join(turns, ""), 256).alias("d"))).alias("all"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    found = each.groupBy("conv_id").agg(F.max("all").alias("all"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return found.select("conv_id", F.col("all.n").alias("n_turns"), F.col("all.d").alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one made of control strings, read back from its formatted examples."""
    said = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(prefix_targets(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)))


ORACLE = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), w AS (
  SELECT *, 14 + length(role) + length(replace(replace(replace(text, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn')) + 2 AS chars,
    row_number() OVER p AS k, count(*) OVER (PARTITION BY conv_id) AS n, sum(chars) OVER (p ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW p AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
