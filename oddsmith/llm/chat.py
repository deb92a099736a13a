"""Prefix-target chat examples: each assistant turn is an example whose context is every turn before it.

A conversation is rendered once as a transcript; example number i is the transcript up to the end of its reply, and only
the reply's span is trained on.  Kept that way the output grows with the input, not with the square of a conversation's
length; :func:`expand` writes the examples' texts out where a trainer wants them.

Marks: ``[INST] role\\n text [/INST]`` for turns that are context, ``<s> text </s>`` for assistant turns.  A mark inside a
text gets a backslash after its first character, and one that already has backslashes there gets one more, so reading
back only takes one away.  In a role, ``%`` and line feeds are percent-encoded.

All of it is DataFrame functions.  Edge cases: null texts and roles count as empty; turns are ordered by (turn, role,
text), nulls first, so ties and repeated rows have one order and all are kept; rows of a null ``conv_id`` form one
conversation; a conversation without assistant turns has a transcript and no spans; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLY = "assistant"
TURNS_PER_BLOCK = 64
_ESCAPE = r"([<\[])(\\*)(?=/?s>|/?INST\])"
_UNESCAPE = r"([<\[])\\(\\*)(?=/?s>|/?INST\])"
_TURN = r"(?s)\[INST\] ([^\n]*)\n(.*?) \[/INST\]|<s>(.*?)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2"))


def _role_in(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, text and spans (start and length, in code points, of each reply in the text).

    Turns are gathered in blocks of turn numbers first, so a very long conversation is rendered by many tasks; only its
    rendered blocks meet.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    blocks = turns.groupBy("conv_id", F.floor(F.col("turn") / TURNS_PER_BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    is_reply = lambda t: t["role"] == REPLY
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.when(is_reply(t), F.lit("<s>")).otherwise(F.concat(F.lit("[INST] "), _role_in(t["role"]), F.lit("\n"))).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(is_reply(t), F.lit("</s>")).otherwise(F.lit(" [/INST]")).alias("tail"),
            is_reply(t).alias("reply"),
        ),
    )
    rendered = blocks.select("conv_id", "block", parts.alias("parts")).select(
        "conv_id",
        "block",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("text"),
        F.expr(
            "aggregate(parts, named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>)), "
            "(a, p) -> named_struct('at', a.at + length(p.head) + length(p.body) + length(p.tail), 'spans', if(p.reply, "
            "array_append(a.spans, named_struct('start', a.at + length(p.head), 'length', cast(length(p.body) as bigint))), a.spans)), "
            "a -> a.spans)"
        ).alias("spans"),
    )
    whole = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "text", "spans"))).alias("blocks"))
    return whole.select(
        "conv_id",
        F.array_join(F.col("blocks.text"), "").alias("text"),
        F.expr(
            "aggregate(blocks, named_struct('at', 0L, 'spans', cast(array() as array<array<struct<start: bigint, length: bigint>>>)), "
            "(a, b) -> named_struct('at', a.at + length(b.text), 'spans', array_append(a.spans, "
            "transform(b.spans, s -> named_struct('start', s.start + a.at, 'length', s.length)))), a -> flatten(a.spans))"
        ).alias("spans"),
    )


def examples(rendered: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, context_chars, reply_chars and chars of the whole example."""
    return rendered.select("conv_id", F.posexplode("spans").alias("example", "span")).select(
        "conv_id",
        "example",
        F.col("span.start").alias("context_chars"),
        F.col("span.length").alias("reply_chars"),
        (F.col("span.start") + F.col("span.length") + len("</s>")).alias("chars"),
    )


def expand(rendered: DataFrame) -> DataFrame:
    """The examples with their texts: conv_id, example, text, and the start and length of the part to train on."""
    return rendered.select("conv_id", "text", F.posexplode("spans").alias("example", "span")).select(
        "conv_id",
        "example",
        F.expr("substring(text, 1, cast(span.start + span.length as int) + 4)").alias("text"),
        F.col("span.start").alias("loss_start"),
        F.col("span.length").alias("loss_length"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a transcript, as array of (role, text)."""
    found = F.regexp_extract_all(text, F.lit(_TURN), F.lit(0))
    part = lambda x, g: F.regexp_extract(x, _TURN, g)
    return F.transform(
        found,
        lambda x: F.struct(
            F.when(F.startswith(x, F.lit("<s>")), F.lit(REPLY)).otherwise(_role_out(part(x, 1))).alias("role"),
            unescape(F.when(F.startswith(x, F.lit("<s>")), part(x, 3)).otherwise(part(x, 2))).alias("text"),
        ),
    )


def written(rendered: DataFrame) -> DataFrame:
    """Every example with its text, and the rest that no reply follows: conv_id, example, text, loss_start, loss_length, last.

    A conversation that does not end with a reply has one more row, its whole transcript, with nothing to train on.
    """
    ends = F.endswith(F.col("text"), F.lit("</s>"))
    whole = F.struct(F.length("text").cast("long").alias("start"), F.lit(0).cast("long").alias("length"))
    parts = F.when(ends, F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), F.lit("</s>").alias("tail")))).otherwise(
        F.concat(
            F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), F.lit("</s>").alias("tail"))),
            F.array(F.struct(whole["start"].alias("start"), whole["length"].alias("length"), F.lit("").alias("tail"))),
        )
    )
    rows = rendered.withColumn("_parts", parts)
    rows = rows.select("conv_id", "text", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("example", "_part"))
    return rows.select(
        "conv_id",
        "example",
        F.expr("substring(text, 1, cast(_part.start + _part.length as int) + length(_part.tail))").alias("text"),
        F.col("_part.start").alias("loss_start"),
        F.col("_part.length").alias("loss_length"),
        (F.col("example") == F.col("_n") - 1).alias("last"),
    )


def digests(rendered: DataFrame) -> DataFrame:
    """What a reader of the examples finds: turns, trained text and the size of all examples, per conversation.

    Each example's text is written out and read; the turns are those of a conversation's last row, which holds them all.
    """
    turns = read_turns(F.col("text"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescape(F.expr("substring(text, cast(loss_start as int) + 1, cast(loss_length as int))"))
    read = written(rendered).select(
        "conv_id",
        "example",
        F.length("text").cast("long").alias("chars"),
        loss.alias("loss"),
        F.when(F.col("last"), F.size(turns).cast("long")).alias("n_turns"),
        F.when(F.col("last"), F.sha2(told, 256)).alias("turns_sha256"),
    )
    met = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.sort_array(F.collect_list(F.struct("example", "loss")))["loss"], "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return met.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
