"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A turn is written ``### role: text</turn>`` and a line feed. Inside roles and texts a backslash is put
before every backslash, ``#`` and the slash of ``</turn>`` (in roles also before colons), so no control
string can appear there, and taking the escapes away gives the text back.

Each assistant turn becomes an example: its context is everything formatted before the reply, and the
reply, the escaped text without marks, is all that is trained on. Contexts are prefixes of one formatted
string, cut out at offsets (code points); for a conversation of n turns that makes n squared characters,
a row at a time.

Rows are ordered by turn, null first, ties by role and text; repeated rows are turns of their own. Null
roles and texts count as empty. Null conversation ids form one conversation. An empty table gives an
empty result; extra columns are ignored. A formatted conversation is one string value (at most 2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    c = F.regexp_replace(c, r"[\\#:]" if role else r"[\\#]", r"\\$0")
    return F.replace(c, F.lit("</turn>"), F.lit(r"<\/turn>"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, i, role, piece, reply, reply_start, reply_end: each turn formatted, with its place in the whole."""
    c = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    c = c.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(COLON))
    c = c.withColumns({"head": head, "reply": escape(F.col("text"))}).withColumn("n", F.length("head") + F.length("reply") + len(CLOSE))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    c = c.withColumns({"i": F.row_number().over(by), "end": F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    stop = F.col("end") - len(CLOSE)
    return c.select("conv_id", "i", "role", F.concat("head", "reply", F.lit(CLOSE)).alias("piece"), "reply", (stop - F.length("reply")).alias("reply_start"), stop.alias("reply_end"))


def format_conversations(conversations: DataFrame, trained: str = "assistant", **columns: str) -> DataFrame:
    """conv_id, formatted and examples (array of i, reply_start, reply_end, reply) of each conversation."""
    whole = F.array_sort(F.collect_list(F.struct("i", "piece")))
    mine = F.when(F.col("role") == trained, F.struct("i", "reply_start", "reply_end", "reply"))
    g = turns(conversations, **columns).groupBy("conv_id").agg(whole.alias("w"), F.array_sort(F.collect_list(mine)).alias("examples"))
    return g.select("conv_id", F.array_join(F.col("w.piece"), "").alias("formatted"), "examples")


def examples(formatted: DataFrame) -> DataFrame:
    """A row for each trained turn, its prefix and target: conv_id, i, context, target, reply_start, reply_end.

    context is all that is formatted before the reply, target the reply (escaped, as formatted). The offsets
    are the loss mask over context and target put together; both are cut from the formatted string.
    """
    e = formatted.select("conv_id", "formatted", F.explode("examples").alias("e"))
    start, end = F.col("e.reply_start").cast("int"), F.col("e.reply_end").cast("int")
    context, target = F.substring("formatted", F.lit(1), start), F.substring("formatted", start + 1, end - start)
    return e.select("conv_id", "e.i", context.alias("context"), target.alias("target"), "e.reply_start", "e.reply_end")


def with_context(formatted: DataFrame) -> DataFrame:
    """examples() under its earlier name."""
    return examples(formatted)


def trained_text(example: DataFrame) -> DataFrame:
    """conv_id, i, text: what lies under the loss mask of each example's context and target, unescaped."""
    start = F.col("reply_start").cast("int")
    under = F.substring(F.concat("context", "target"), start + 1, F.col("reply_end").cast("int") - start)
    return example.select("conv_id", "i", unescape(under).alias("text"))


def parse(formatted: Column) -> Column:
    """array of (role, text) read from a formatted conversation."""
    pieces = F.filter(F.split(formatted, F.lit(CLOSE)), lambda p: p != "")
    head = r"(?s)^### ((?:[^:\\]|\\.)*): (.*)$"
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")))
