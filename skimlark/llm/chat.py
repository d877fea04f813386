"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is an array of parts ``(kind, text, ref, units)``. A visitor (``placeholder``) turns each part into
text: a text part is its escaped text, any other part is a placeholder ``<image 0/>`` numbered in order within the message,
and an attachment record with the reference and the number of tokens that it will expand to. A turn is
``<turn>role newline content</turn> newline``. Inside roles and texts each control string gets a backslash after its ``<``, one more
if there are some already, so that no control string is left and the escape can be undone.

Null role, text, reference: empty. Null or negative units count as 0. Unknown kinds are attachments of no tokens. Turns are
ordered by (turn, role, content), nulls first; repeated rows are turns of their own. A null conv_id is a conversation.
Other columns are dropped, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"
OPEN, CLOSE = "<turn>", "</turn>\n"
#: Tokens for each unit of an attachment: image tiles, seconds of audio, document pages.
EXPANSION = {"image": 256.0, "audio": 25.0, "document": 512.0}
_CONTROL = r"<(\\*)(/?(?:turn|image|audio|document|attachment))"
_ESCAPED = r"<\\(\\*/?(?:turn|image|audio|document|attachment))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1")


def placeholder(part: Column, order: Column) -> Column:
    """The visitor: what a part becomes in the formatted text."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    named = F.when(kind.isin(*EXPANSION), kind).otherwise("attachment")
    return F.when(kind == "text", escaped(part["text"])).otherwise(F.concat(F.lit("<"), named, F.lit(" "), order.cast("string"), F.lit("/>")))


def expansion(part: Column) -> Column:
    """Tokens that an attachment expands to."""
    each = F.lit(0.0)
    for kind, tokens in EXPANSION.items():
        each = F.when(part["kind"] == kind, tokens).otherwise(each)
    return F.ceil(each * F.greatest(F.coalesce(part["units"], F.lit(0.0)), F.lit(0.0))).cast("long")


def visited(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, content, attachments)``: parts flattened in order."""
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(PARTS)).alias("parts"))
    content = F.array_join(F.transform("parts", placeholder), "")
    kinds = F.transform("parts", lambda p, i: F.struct(
        i.alias("part"), F.coalesce(p["kind"], F.lit("text")).alias("kind"), F.coalesce(p["ref"], F.lit("")).alias("ref"), expansion(p).alias("tokens")))
    return m.select("conv_id", "turn", "role", content.alias("content"), F.filter(kinds, lambda a: a["kind"] != "text").alias("attachments"))


def formatted(messages: DataFrame, learned: str = "assistant", turns_per_chunk: int = 256) -> DataFrame:
    """One row per conversation: ``segments`` (text, loss), ``attachments``, ``expanded_tokens``.

    The segments joined are the formatted conversation; those with loss are the answers to learn. Turns are first put
    together in chunks of neighbouring turn numbers, so a conversation with very many turns is shuffled as a few rows.
    """
    v = visited(messages)
    head = F.struct(F.concat(F.lit(OPEN), F.regexp_replace(escaped(F.regexp_replace("role", r"\\", r"\\\\")), "\n", r"\\n"), F.lit("\n")).alias("text"), F.lit(False).alias("loss"))
    body = F.struct(F.col("content").alias("text"), (F.col("role") == learned).alias("loss"))
    foot = F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss"))
    ordered = v.select("conv_id", F.floor(F.col("turn") / turns_per_chunk).alias("chunk"), F.struct(
        "turn", "role", "content", F.array(head, body, foot).alias("segments"), "attachments").alias("t"))
    # long texts are moved once: order by turn and role, then content
    chunks = ordered.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct(
        F.col("t.turn").alias("turn"), F.col("t.role").alias("role"), F.col("t.segments").alias("segments"), F.col("t.attachments").alias("attachments")))).alias("turns"))
    packed = chunks.select("conv_id", F.struct("chunk", F.flatten(F.col("turns.segments")).alias("segments"), F.flatten(F.transform(
        "turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["turn"].alias("turn"), a.alias("attachment"))))).alias("attachments")).alias("c"))
    whole = packed.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    out = whole.select("conv_id", F.flatten(F.col("cs.segments")).alias("segments"), F.flatten(F.col("cs.attachments")).alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["attachment"]["tokens"]))


def text_of(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(chats: DataFrame) -> DataFrame:
    """Turns ``(role, text)`` parsed from the formatted text, and the texts under the loss mask, all unescaped."""
    turns = F.filter(F.split(text_of(F.col("segments")), F.lit(CLOSE), -1), lambda t: t.startswith(OPEN))
    role = lambda t: F.substring_index(F.substring(t, len(OPEN) + 1, 2**31 - 1), "\n", 1)
    plain = lambda r: F.regexp_replace(F.regexp_replace(F.regexp_replace(unescaped(r), r"\\\\", "\x00"), r"\\n", "\n"), "\x00", r"\\")
    parsed = F.transform(turns, lambda t: F.struct(
        plain(role(t)).alias("role"), unescaped(F.substring(t, F.length(F.lit(OPEN)) + F.length(role(t)) + 2, F.lit(2**31 - 1))).alias("text")))
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return chats.select("*", text_of(F.col("segments")).alias("formatted"), parsed.alias("turns"), learned.alias("learned"))


def single_parts(conversations: DataFrame) -> DataFrame:
    """Plain conversations as messages of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))
