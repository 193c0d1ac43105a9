"""Chat formatting by prefix-target expansion (operator 9); DataFrame functions only.

A turn is written ``[role]text</s>``. In texts and roles ``%``, ``<``, ``[`` and ``]`` are written as percent
codes, so no text can hold a control string and every turn can be read back. Each assistant turn becomes an
example: all turns before it as context, its own text alone under the loss mask (``mask_start``,
``mask_chars``: code points of the formatted text). A conversation that does not end with an assistant turn
also gives one example of all its turns with an empty mask, so that no turn is lost.

Turns stand in the order of (turn, role, text), nulls first; a null text or role is empty; rows of a null
conversation id are one conversation; repeated rows are repeated turns. An empty table gives no examples.
One conversation is one row of a task; its examples together are as long as the definition makes them, the
square of the number of its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</s>"
# Control signs and what is written for them; the percent sign is first when writing, last when reading.
CODES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("]", "%5D"))


def escape(text: Column) -> Column:
    for sign, code in CODES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, mask_start, mask_chars) for rows (conv_id, turn, role, text)."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("plain"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = turns.withColumn(
        "turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["plain"]).alias("text")))
    )
    written = turns.select(
        "conv_id",
        "turns",
        F.transform("turns", lambda t: F.concat(F.lit("["), escape(t["role"]), F.lit("]"), t["text"], F.lit(END))).alias("lines"),
    )
    n = F.size("turns")
    targets = F.filter(
        F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == n)
    )
    opened = written.select("conv_id", "turns", "lines", F.explode(targets).alias("example"))
    target = F.element_at("turns", F.col("example"))
    formatted = F.array_join(F.slice("lines", F.lit(1), F.col("example")), "")
    masked = F.when(target["role"] == "assistant", F.length(target["text"])).otherwise(0).cast("long")
    out = opened.select("conv_id", "example", formatted.alias("formatted"), masked.alias("mask_chars"))
    return out.select(
        "conv_id",
        "example",
        "formatted",
        (F.length("formatted") - len(END) - F.col("mask_chars")).cast("long").alias("mask_start"),
        "mask_chars",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations from their examples alone; the turns are read from the longest one only."""
    parts = F.split("longest", END, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def line(part: Column) -> Column:
        role = F.substring_index(part, "]", 1)
        return F.concat(
            unescape(F.substring(role, 2, 1 << 30)),
            F.lit("\n"),
            unescape(part.substr(F.length(role) + 2, F.length(part))),
            F.lit("\n"),
        )

    loss = unescape(F.col("formatted").substr(F.col("mask_start") + 1, F.col("mask_chars")))
    rows = formatted.select(
        "conv_id",
        "example",
        "formatted",
        loss.alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    found = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return found.select(
        "conv_id",
        F.size(parts).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(parts, line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """Conversation -1, whose texts look like control strings, added."""
    rows = [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    probe = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
), s AS (
  SELECT *, length(role) + length(text) + 6
      + 2 * length(regexp_replace(role || text, '[^%<\\[\\]]', '', 'g')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM s
)
SELECT conv_id, max(n)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = n THEN upto END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
