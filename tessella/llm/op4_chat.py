"""Chat formatting with prefix-target expansion.

A conversation's rows are ordered by turn and rendered as

    <|turn|>role<|text|>text<|end|>

Every assistant turn becomes an example of its own: all turns before it, then
its reply, of which only the text carries loss (``loss_start``, ``loss_chars``
in code points of ``formatted``). What follows the last assistant turn, or a
conversation without one, is kept as one more example without loss
(``target`` null), so the output holds every turn.

Control strings inside roles and texts are escaped reversibly: a backslash is
doubled, and a backslash goes after the first character of anything that could
begin a control string: one of this template or of those with bars (<|...),
or <s>, </s>, [INST], [/INST], <<SYS>> and <</SYS>>. Escaped text never contains
one of these, so the output splits on them exactly.

Defined results: null role or text is empty; a null conversation id is a
conversation; equal turn numbers are ordered by role, then text, nulls first;
repeated rows are turns of their own; an empty table gives no examples; other
columns are ignored. A conversation is one value of the output by definition,
so it must fit in a row; examples of a long one are built one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Places after which an escaping backslash goes.
_OPENING = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\"), _OPENING, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, target, formatted, loss_start, loss_chars, last): one row per assistant turn, and one for what follows the last of them.

    ``target`` is the position of the reply among the turns. ``last`` marks the
    row whose text holds all turns.
    """
    rows = conversations.select("conv_id", F.struct("turn", "role", "text").alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shown = whole.select(
        "conv_id",
        F.transform("turns", lambda t: render(t["role"], t["text"])).alias("shown"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"),
        F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull()).alias("replies"),
    )
    n = F.size("shown")
    final = F.coalesce(F.get("replies", F.size("replies") - 1), F.lit(0))
    targets = F.transform("replies", lambda i: F.struct(i.alias("upto"), i.alias("target")))
    rest = F.when(final < n, F.array(F.struct(n.alias("upto"), F.lit(None).cast("int").alias("target")))).otherwise(F.array().cast("array<struct<upto:int,target:int>>"))
    each = shown.select("conv_id", "shown", "sizes", F.posexplode(F.concat(targets, rest)).alias("example", "e"))
    text = F.array_join(F.slice("shown", 1, F.col("e.upto")), "")
    made = each.select("conv_id", "example", F.col("e.target").alias("target"), text.alias("formatted"), F.get("sizes", F.col("e.target") - 1).alias("size"), (F.col("e.upto") == n).alias("last"))
    size = F.coalesce("size", F.lit(0))
    start = F.when(F.col("target").isNotNull(), F.length("formatted") - len(END) - size)
    return made.select("conv_id", "example", "target", "formatted", start.alias("loss_start"), size.alias("loss_chars"), "last")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from formatted text, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    bare = F.transform(parts, lambda x: F.split(F.substring(x, len(TURN) + 1, 2**31 - 1), r"<\|text\|>"))
    return F.transform(bare, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text alone."""
    loss = F.when(F.col("target").isNotNull(), unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))))
    turns = read_turns(F.col("formatted"))
    written = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id",
        F.when(F.col("target").isNotNull(), F.struct("target", loss.alias("text"))).alias("loss"),
        F.when(F.col("last"), F.size(turns)).alias("n"),
        F.when(F.col("last"), F.sha2(written, 256)).alias("sha"),
        F.length("formatted").cast("long").alias("chars"),
    )
    sums = read.groupBy("conv_id").agg(F.max("n").alias("n"), F.max("sha").alias("sha"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("chars"))
    said = sums.withColumn("said", F.array_join(F.transform("loss", lambda x: x["text"]), ""))
    return said.select(
        "conv_id",
        F.col("n").cast("long").alias("n_turns"),
        F.col("sha").alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(prefix_target_examples(conversations.select("conv_id", "turn", "role", "text").unionByName(more)))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, {frame} + length({role}) + length({text}) AS shown, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
running AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv_id) AS final FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR pos = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id
"""
for _name in ("role", "text"):
    # Every escape adds one character, so an escaped length is that of the text with marks of two characters.
    _marked = f"regexp_replace(regexp_replace({_name}, '\\\\', '##', 'g'), '<([|]|/?s>|</?SYS>>)|\\[(/?INST\\])', '##\\1\\2', 'g')"
    SQL = SQL.replace("{" + _name + "}", _marked)
SQL = SQL.replace("{frame}", str(len(TURN + TEXT + END)))
