"""Operator 4, chat formatting (native): typed content parts become one marked-up text per conversation.

Messages hold content parts of type text, image, audio or document. The visitor writes text parts escaped and the
others as numbered placeholders, and records each attachment with its place and the tokens it will expand to. Turns
are marked with control strings; any control string inside a text or a role is broken by a backslash, backslashes
themselves being doubled, so that formatting can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, HEAD_END, END = "<|start|>", "<|message|>", "<|end|>"
#: Strings that may not stand unbroken in a text, as a pattern: group 1 is what the backslash follows.
CONTROL = r"(<)(?=\||/?s>)|(\[)(?=/?(?:INST|SYS)\])"
#: Expanded tokens for each unit (tile, second, page) of an attachment, and for the attachment itself.
TOKENS_PER_UNIT = {"image": (85, 170), "audio": (2, 25), "document": (4, 500)}
PART = "struct<type:string,text:string,ref:string,units:double>"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def placeholder(kind: Column, number: Column) -> Column:
    return F.concat(F.lit("<|"), kind, F.lit(":"), number.cast("string"), F.lit("|>"))


def visit(parts: Column) -> Column:
    """struct<body, attachments>: parts in order; unknown types and nulls count as text. Numbers are kept per message."""
    per = F.create_map(*[x for kind, (base, unit) in TOKENS_PER_UNIT.items() for x in (F.lit(kind), F.struct(F.lit(base).alias("base"), F.lit(unit).alias("unit")))])
    attached = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("at"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["units"], F.lit(0.0)).alias("units"))), lambda p: p["type"].isin(*TOKENS_PER_UNIT))
    attachments = F.transform(
        attached,
        lambda p, i: F.struct(
            (i + 1).alias("number"),
            p["at"].alias("part"),
            p["type"].alias("type"),
            p["ref"].alias("ref"),
            (F.try_element_at(per, p["type"])["base"] + F.ceil(p["units"]) * F.try_element_at(per, p["type"])["unit"]).cast("long").alias("tokens"),
        ),
    )
    number = lambda i: F.size(F.filter(attached, lambda a: a["at"] <= i))
    body = F.array_join(F.transform(parts, lambda p, i: F.when(p["type"].isin(*TOKENS_PER_UNIT), placeholder(p["type"], number(i))).otherwise(escape(p["text"]))), "")
    return F.struct(F.coalesce(body, F.lit("")).alias("body"), F.coalesce(attachments, F.lit([]).cast("array<struct<number:int,part:int,type:string,ref:string,tokens:bigint>>")).alias("attachments"))


def format_chats(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments of each conversation.

    messages has conv_id, turn, role and parts (an array of PART). Each message is written before the shuffle; a
    conversation's row holds what the conversation holds. Turns go by number (null first), then role and body. A null
    role counts as empty. Repeated rows are turns of their own. Loss spans (start, length, in code points, of escaped text)
    are the assistant's bodies.
    """
    seen = visit(F.col("parts"))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), seen.alias("v"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(HEAD_END))
    turns = rows.select("conv_id", F.struct("turn", "role", F.col("v.body").alias("body"), head.alias("head"), F.col("v.attachments").alias("attachments")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _in_order).alias("t"))
    whole = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END)
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,length:int>>").alias("out")),
        lambda a, t: F.struct(
            (a["at"] + size(t)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(a["out"], F.array(F.struct((a["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    attachments = F.flatten(F.transform("t", lambda t, i: F.transform(t["attachments"], lambda x: F.struct(i.alias("turn_index"), x["number"].alias("number"), x["part"].alias("part"), x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))))
    return grouped.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"))


def _in_order(a: Column, b: Column) -> Column:
    def step(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(rest)

    low = F.lit(-(2**63))
    return step(F.coalesce(a["turn"], low), F.coalesce(b["turn"], low), step(a["role"], b["role"], step(a["body"], b["body"], F.lit(0))))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, unescaped), loss_text, formatted_chars, from formatted and loss_spans alone."""
    marked = F.filter(F.split("formatted", r"<\|start\|>", -1), lambda x: x != "")
    turns = F.transform(
        marked,
        lambda x: F.struct(
            unescape(F.substring_index(x, HEAD_END, 1)).alias("role"),
            unescape(F.substring(x, F.locate(HEAD_END, x) + len(HEAD_END), F.length(x) - F.locate(HEAD_END, x) - len(HEAD_END) + 1 - len(END))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def as_messages(conversations: DataFrame) -> DataFrame:
    """Plain rows as messages of one text part (null text: empty)."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.array(part).alias("parts"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(planted)
    return digests(read_back(format_chats(as_messages(rows))))


#: The same digests from the rows themselves; loss_sha256 and turns_sha256 don't depend on the markup, formatted_chars does.
OP4_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(regexp_replace(replace(role, '\', '\\'), '(<\||</?s>|\[/?(?:INST|SYS)\])', '\1#', 'g')) + length(regexp_replace(replace(text, '\', '\\'), '(<\||</?s>|\[/?(?:INST|SYS)\])', '\1#', 'g'))
    + length('<|start|><|message|><|end|>') AS chars FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
