"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Template: every turn is ``<s>role\\n`` + text + ``</s>``. Inside roles and
texts the control strings ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` lose
their first character to an escape, and ``~`` is the escape character itself:
``~`` -> ``~0``, ``<`` -> ``~1``, ``[`` -> ``~2``; in roles a line feed
becomes ``~3``. Undoing the numbered escapes before ``~0`` restores any text.

Every assistant turn becomes one example: all turns before it as context, and
the mask (``loss_start``, ``loss_chars``: code points) over its reply alone.
A conversation that does not end with an assistant turn also gives one
example of all its turns without a mask, so that no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

OPEN, CLOSE = "<s>", "</s>"
_CONTROL = r"(?=/?s>)"
_INST = r"(?=/?INST\])"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    return F.regexp_replace(F.regexp_replace(out, "<" + _CONTROL, "~1"), r"\[" + _INST, "~2")


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("~3"), F.lit("\n")), F.lit("~2"), F.lit("["))
    return F.replace(F.replace(out, F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit("~3")), F.lit("\n"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (0, 1, ...), formatted, loss_start, loss_chars (null mask: nothing to train on).

    ``turns`` has conv_id, turn, role, text. Null roles and texts are empty;
    turns go by (turn, role, text), null turns first, and repeated rows stay.
    A null conv_id is a conversation of its own.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    shown = talks.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(_header(t.role), escaped(t.text), F.lit(CLOSE))).alias("shown"),
        F.transform("ts", lambda t: F.when(t.role == "assistant", F.length(escaped(t.text)))).alias("mask"),
    )
    last = F.size("shown")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | F.element_at("mask", i).isNotNull())
    split = shown.select("conv_id", "shown", "mask", F.posexplode(ends).alias("example", "upto"))
    formatted = F.array_join(F.slice("shown", 1, F.col("upto")), "")
    size = F.element_at("mask", F.col("upto")).cast("long")
    return split.select("conv_id", F.col("example").cast("long").alias("example"), formatted.alias("formatted"), size.alias("loss_chars")).select(
        "conv_id", "example", "formatted", (F.length("formatted") - F.col("loss_chars") - len(CLOSE)).alias("loss_start"), "loss_chars"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from ``examples`` alone: its turns, and the text under the mask."""
    read = formatted.select(
        "conv_id",
        F.length("formatted").cast("long").alias("chars"),
        F.struct("example", "formatted").alias("longest"),
        F.when(F.col("loss_start").isNotNull(), F.struct("example", unescaped(F.substr("formatted", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))).alias("reply"))).alias("reply"),
    )
    per = read.groupBy("conv_id").agg(
        F.max("longest").formatted.alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list("reply")), lambda r: r.reply), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    parts = F.transform(F.filter(F.split("whole", CLOSE), lambda p: p != ""), lambda p: F.substring(p, len(OPEN) + 1, 1 << 30))
    body = lambda p: F.substr(p, F.instr(p, "\n") + 1)
    turns = F.transform(parts, lambda p: F.concat(unescaped(F.substring_index(p, "\n", 1)), F.lit("\n"), unescaped(body(p)), F.lit("\n")))
    return per.select(
        "conv_id",
        F.size(parts).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_control_case(turns: DataFrame) -> DataFrame:
    """The conversations plus number -1, whose texts are control strings."""
    spark = turns.sparkSession
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(examples(with_control_case(read_table(spark, sf_dir, "conversations"))))


#: The same digests computed straight from the turns. DuckDB sorts lists of structs field by field.
OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(3 + length(replace(esc_role, chr(10), '~3')) + 1 + length(esc) + 4) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT *,
      regexp_replace(regexp_replace(replace(text, '~', '~0'), '<(/?s>)', '~1\1', 'g'), '\[(/?INST\])', '~2\1', 'g') AS esc,
      regexp_replace(regexp_replace(replace(role, '~', '~0'), '<(/?s>)', '~1\1', 'g'), '\[(/?INST\])', '~2\1', 'g') AS esc_role
    FROM t)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
