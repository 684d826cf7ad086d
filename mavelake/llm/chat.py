"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are the context and only that reply is trainable.
A conversation that doesn't end in an assistant turn gives one more example without a trainable part, so that no turn is
lost. A turn is written as `### Role: text </turn>` and a line break. Inside roles and texts a backslash escapes itself
and the characters of the control strings, so no text can look like a mark, and `read_back` restores all of them.

The examples of a conversation grow with the square of its turns: that is the feature. A conversation is one unit of
output; different conversations share no task state, and repeated contents don't meet in any group.

Defined cases: null roles and texts count as empty; null conversation ids form one conversation; turns are ordered by
turn number (nulls first), then role, then text, so ties and repeated rows are all kept in a defined order; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"


def escape(c: Column) -> Column:
    """Backslash, number sign, less-than sign and colon as two characters each."""
    for plain, letter in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")):
        c = F.replace(c, F.lit(plain), F.lit(letter))
    return c


def unescape(c: Column) -> Column:
    """The inverse: what stands between escaped backslashes is decoded by itself."""

    def part(x: Column) -> Column:
        for plain, letter in (("#", "\\h"), ("<", "\\l"), (":", "\\c")):
            x = F.replace(x, F.lit(letter), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", assistant: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (number of its last turn), formatted, loss_start and loss_chars (code points)."""
    row = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    conv = turns.select(F.col(conv_col).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    conv = conv.select("conv_id", F.transform("ts", lambda t: F.struct(t.role.alias("role"), F.concat(F.lit(OPEN), escape(t.role), F.lit(MIDDLE)).alias("head"), escape(t.text).alias("body"))).alias("ts"))
    ends = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (F.element_at("ts", i).role == assistant) | (i == F.size("ts")))
    one = conv.select("conv_id", "ts", F.explode(ends).alias("example"))
    last = F.element_at("ts", F.col("example"))
    context = F.concat(F.array_join(F.transform(F.slice("ts", 1, F.col("example") - 1), lambda t: F.concat(t.head, t.body, F.lit(CLOSE))), ""), last["head"])
    one = one.select("conv_id", "example", context.alias("context"), last.alias("last"))
    trained = F.col("last.role") == assistant
    return one.select("conv_id", "example", F.concat("context", "last.body", F.lit(CLOSE)).alias("formatted"), F.char_length("context").alias("loss_start"), F.when(trained, F.char_length("last.body")).otherwise(0).alias("loss_chars"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns (role and text), trained texts in order, formatted length."""
    reply = F.when(F.col("loss_chars") > 0, unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)"))).otherwise("")
    conv = examples.select("conv_id", "example", "formatted", reply.alias("reply")).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda x: x.reply).alias("replies"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    pieces = F.split(F.col("whole"), CLOSE, -1)
    parsed = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(unescape(F.regexp_extract(p, r"(?s)^### (.*?): ", 1)).alias("role"), unescape(F.regexp_extract(p, r"(?s)^### .*?: (.*)$", 1)).alias("text")))
    return conv.select("conv_id", parsed.alias("turns"), F.array_join("replies", "").alias("trained"), "formatted_chars")


def digests(turns: DataFrame) -> DataFrame:
    back = read_back(expand(turns))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"), F.char_length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose two texts look like marks."""
    text = r"\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(text).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(4 + 2 + 9 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
