"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is
trainable. The template marks turns with three control strings; these, and the marks other chat formats use,
are broken inside texts by a backslash, and a backslash is doubled, so that the step can be undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: First character, then the rest, of what must not appear in a text: our marks and those of common templates.
CONTROL = r"(<)(\|(?:turn|text|end)\|>|/?s>|</?SYS>>)|(\[)(/?INST\])"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def piece(turn: Column) -> Column:
    return F.concat(F.lit(TURN), escape(turn["role"]), F.lit(TEXT), escape(turn["text"]), F.lit(END))


def expand(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example (from 0), formatted, loss_start, loss_end.

    Turns are ordered by turn, role, text, null turns last; a null role or text is empty; repeated rows are
    turns of their own. loss_start and loss_end are code points of `formatted`, the end exclusive, around the
    escaped reply. Turns after the last reply, or a conversation without one, give a last example with nothing
    to train (both offsets null), so that no turn is lost. No other column is read. A conversation is held in
    one row, as its longest example must be.
    """
    clean = conversations.select(
        "conv_id", F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row")
    )
    whole = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    last = F.size("turns") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("turns", i)["role"] == TRAINED_ROLE) | (i == last))
    numbered = whole.select("conv_id", "turns", F.transform("turns", piece).alias("pieces"), F.posexplode(ends).alias("example", "at"))
    reply = F.get("turns", F.col("at"))
    context = F.array_join(F.slice("pieces", F.lit(1), F.col("at")), "")
    head = F.char_length(F.concat(F.lit(TURN), escape(reply["role"]), F.lit(TEXT)))
    trained = reply["role"] == TRAINED_ROLE
    placed = numbered.select(
        "conv_id", F.col("example").cast("long").alias("example"), context.alias("context"), F.get("pieces", F.col("at")).alias("target"),
        F.when(trained, head).alias("head"), F.when(trained, F.char_length(escape(reply["text"]))).alias("width"),
    )
    begin = F.char_length("context") + F.col("head")
    return placed.select("conv_id", "example", F.concat("context", "target").alias("formatted"), begin.cast("long").alias("loss_start"), (begin + F.col("width")).cast("long").alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Parse examples: per conversation its turns and the text under the loss mask, as counts and digests.

    The last example holds every turn; each example holds one trained reply.
    """
    under_mask = F.when(
        F.col("loss_start").isNotNull(),
        unescape(F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))),
    )
    whole = examples.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted"))["formatted"].alias("formatted"),
        F.array_sort(F.collect_list(F.struct("example", under_mask.alias("reply")))).alias("replies"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    # The text before the first turn mark is empty; each part is role, text mark, text, end mark.
    parts = let(F.split("formatted", r"<\|turn\|>", -1), lambda s: F.slice(s, F.lit(2), F.size(s) - 1))

    def plain(part: Column) -> Column:
        fields = F.split(F.substring(part, F.lit(1), F.char_length(part) - len(END)), r"<\|text\|>", -1)
        return let(fields, lambda f: F.concat(unescape(f[0]), F.lit("\n"), unescape(f[1]), F.lit("\n")))

    loss = F.array_join(F.transform("replies", lambda r: F.coalesce(r["reply"], F.lit(""))), "")
    return whole.select(
        "conv_id", F.size(parts).cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform(parts, plain), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expand all conversations and one that imitates control strings, then read everything back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    imitation = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return read_back(expand(given.unionByName(imitation)))


ESCAPED_SQL = r"regexp_replace(replace({0}, '\', '\\'), '(<)(\|(?:turn|text|end)\|>|/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"
SQL = {
    "op7_chat_formatting": f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS of,
    length('<|turn|>' || {ESCAPED_SQL.format("role")} || '<|text|>' || {ESCAPED_SQL.format("text")} || '<|end|>') AS width
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
), running AS (
  SELECT *, sum(width) OVER (PARTITION BY conv_id ORDER BY n) AS so_far FROM numbered
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(so_far) FILTER (role = 'assistant' OR n = of))::BIGINT AS formatted_chars
FROM running GROUP BY conv_id
""",
}
QUERIES = {"op7_chat_formatting": op7_chat_formatting}
