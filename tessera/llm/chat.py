r"""Chat formatting by prefix-target expansion (operator 6); DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns as
context, then that reply, whose text alone is trainable.  Turns after the last
reply (or a conversation without one) give one more example, without a trainable
part, so that the output holds every turn.

A turn is ``OPEN text CLOSE`` with the markers of its role; other roles carry
their name in hexadecimal before the text.  A marker inside a text gets one
backslash in front, and backslashes directly before it are doubled, so that
``unescape`` gives the text back; a marker of the template never follows a
backslash.

Defined cases: a null text is empty, a null role is the empty role; turns are
ordered by turn (nulls first), then role, then text, and repeated rows stay;
rows without a conv_id form one conversation; an empty table gives no example.
A conversation is one training unit and one digest, so its turns meet in one
row; conversations are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: role -> the markers around its texts
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("<s>", "</s>")}
#: around the texts of any other role
OTHER = ("[ROLE]", "[/ROLE]")
CONTROL = r"\[/?(?:INST|SYS|ROLE)\]|</?s>"
TURN = r"(?s)(?<!\\)(\[INST\]|\[SYS\]|<s>|\[ROLE\]) (.*?) (?<!\\)(?:\[/INST\]|\[/SYS\]|</s>|\[/ROLE\])"
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"$1$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*)\1\\({CONTROL})", "$1$2")


def render(role: Column, text: Column) -> Column:
    """One turn as it stands in the formatted string."""
    body = escape(text)
    out = F.concat(F.lit(OTHER[0] + " "), F.hex(role), F.lit(" "), body, F.lit(" " + OTHER[1]))
    for name, (left, right) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(left + " "), body, F.lit(" " + right))).otherwise(out)
    return out


def prefix_target(turns: DataFrame) -> DataFrame:
    """Examples of conversations (conv_id, turn, role, text).

    conv_id, target (its turn's index from 0), trainable boolean, formatted,
    loss_start and loss_end (code points of formatted; null without a trainable
    part), whole (the example holds all turns of its conversation).
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    conversations = turns.select(F.col("conv_id").cast("long"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    rendered = conversations.select(
        "conv_id",
        F.transform("ts", lambda t: t["role"]).alias("roles"),
        F.transform("ts", lambda t: render(t["role"], t["text"])).alias("parts"),
        F.transform("ts", lambda t: F.length(escape(t["text"]))).alias("sizes"),
    )
    n = F.size("roles")
    targets = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.element_at("roles", i + 1) == TARGET) | (i == n - 1))
    each = rendered.select("conv_id", "roles", "parts", "sizes", F.explode(targets).alias("target"))
    trainable = F.element_at("roles", F.col("target") + 1) == TARGET
    formatted = F.array_join(F.slice("parts", 1, F.col("target") + 1), "")
    end = F.length("formatted") - len(MARKS[TARGET][1]) - 1
    return (
        each.select("conv_id", "target", trainable.alias("trainable"), formatted.alias("formatted"), F.element_at("sizes", F.col("target") + 1).alias("size"), (F.col("target") == F.size("roles") - 1).alias("whole"))
        .withColumn("loss_end", F.when(F.col("trainable"), end))
        .withColumn("loss_start", F.when(F.col("trainable"), F.col("loss_end") - F.col("size")))
        .select("conv_id", "target", "trainable", "formatted", "loss_start", "loss_end", "whole")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array of struct(role, text)."""
    opens = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))

    def turn(mark: Column, body: Column) -> Column:
        role = F.decode(F.unhex(F.substring_index(body, " ", 1)), "UTF-8")
        text = unescape(F.when(mark == OTHER[0], F.substring(body, F.instr(body, " ") + 1, F.length(body))).otherwise(body))
        for name, (left, _) in MARKS.items():
            role = F.when(mark == left, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.zip_with(opens, bodies, turn)


def read_loss(examples: DataFrame) -> Column:
    """The unescaped text under an example's loss mask (null without one)."""
    return unescape(F.substring(examples["formatted"], examples["loss_start"] + 1, examples["loss_end"] - examples["loss_start"]))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold, read back from the formatted strings."""
    turns = read_turns(F.col("formatted"))
    line = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = examples.select(
        "conv_id",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("whole"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(line, 256).alias("sha"))).alias("all"),
        F.when(F.col("trainable"), F.struct("target", read_loss(examples).alias("text"))).alias("reply"),
    )
    replies = F.array_join(F.transform(F.sort_array("replies"), lambda r: r["text"]), "")
    return (
        each.groupBy("conv_id")
        .agg(F.max("all").alias("all"), F.collect_list("reply").alias("replies"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id",
            F.col("all.n").alias("n_turns"),
            F.col("all.sha").alias("turns_sha256"),
            F.length(replies).cast("long").alias("loss_chars"),
            F.sha2(replies, 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


#: Both turns of conversation -1 say this.
PROBE = "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "conv_id long, turn long, role string, text string"
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], names)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(prefix_target(turns.unionByName(probe)))


QUERIES = {"op6_chat_formatting": op6_chat_formatting}
SQL = {
    "op6_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n,
    length(regexp_replace(text, '(\\*)(\[/?(?:INST|SYS|ROLE)\]|</?s>)', '\1\1\\\2', 'g'))
      + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 9
        ELSE 16 + length(hex(role)) END AS chars
  FROM turns),
running AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM sized)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id
"""
}
