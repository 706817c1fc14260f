"""Chat formatting with typed content parts (operator 1), native expressions only.

A turn's content is an array of parts (``PART``).  A visitor turns each part
into text: text parts are escaped, image, audio and document parts become
placeholders in their order.  Attachment references are recorded in the order
of their placeholders with the tokens each placeholder expands to.

Template: ``<|turn|>role\\ntext<|end|>`` per turn.  Inside texts ``~`` becomes
``~0``, the ``<`` of a control string ``~1`` and the ``[`` of one ``~2`` (and
a line feed in a role ``~3``), so no control string survives inside a text and
the mapping can be undone.

A conversation is one row of the result, so its turns meet in one task; their
number is bounded by the conversation, not by the table.

Defined cases: null text, role or part list is empty; turns are ordered by
turn (null first), ties by role and text; repeated rows are turns of their
own; a null conversation id is a conversation; an unknown part type is treated
as a document; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
TURN, END = "<|turn|>", "<|end|>"
#: control strings whose first character is escaped: template marks, sentence and instruction marks
CONTROL = ((r"<(\||/?s>)", "~1", "<"), (r"\[(/?INST\])", "~2", "["))

IMAGE_PATCH = 28             # pixels a side of a patch, one token each
AUDIO_TOKENS_A_SECOND = 12.5
DOCUMENT_TOKENS_A_PAGE = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    for pattern, code, _ in CONTROL:
        out = F.regexp_replace(out, pattern, code + "$1")
    return out


def unescape(text: Column) -> Column:
    for _, code, char in reversed(CONTROL):
        text = F.replace(text, F.lit(code), F.lit(char))
    return F.replace(text, F.lit("~0"), F.lit("~"))


def visit(part: Column) -> Column:
    """The text of one part in the formatted chat."""
    kind = F.coalesce(part["type"], F.lit("text"))
    return (F.when(kind == "text", escape(F.coalesce(part["text"], F.lit(""))))
            .when(kind == "image", F.lit("<|image|>"))
            .when(kind == "audio", F.lit("<|audio|>"))
            .otherwise(F.lit("<|document|>")))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder expands to (1 without a size)."""
    side = lambda c: F.greatest(F.ceil(F.coalesce(part[c], F.lit(1)) / IMAGE_PATCH), F.lit(1))
    return (F.when(part["type"] == "image", side("width") * side("height"))
            .when(part["type"] == "audio", F.greatest(F.lit(1), F.ceil(
                F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_A_SECOND)))
            .otherwise(F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(1)) * DOCUMENT_TOKENS_A_PAGE))
            ).cast("long")


def text_part(text: str) -> Column:
    """A text column as a part list of one text."""
    return F.array(F.struct(
        F.lit("text").alias("type"), F.col(text).cast("string").alias("text"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"),
                                                    ("seconds", "double"), ("pages", "int"))]))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 parts: str = "parts") -> DataFrame:
    """One row per conversation: ``conv, formatted, loss_spans, attachments``.

    ``loss_spans`` are ``(start, chars)`` of the assistant texts in code points
    of ``formatted``; ``attachments`` are ``(turn, kind, uri, tokens)`` in the
    order of the placeholders."""
    list_ = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    attached = F.filter(list_, lambda p: F.coalesce(p["type"], F.lit("text")) != "text")
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.array_join(F.transform(list_, visit), "").alias("body"),
        F.transform(attached, lambda p: F.struct(
            F.col(turn).alias("turn"), p["type"].alias("kind"), p["uri"].alias("uri"),
            expanded_tokens(p).alias("tokens"))).alias("attached"))
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("~3")), F.lit("\n"))
    rows = rows.select("conv", "turn", "role", "body", "attached", head.alias("head"),
                       F.concat(head, "body", F.lit(END)).alias("message"))
    before = Window.partitionBy("conv").orderBy("turn", "role", "body", "message").rowsBetween(
        Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("message")).over(before), F.lit(0)) + F.length("head")
    rows = rows.withColumn("span", F.when(F.col("role") == "assistant", F.struct(
        at.cast("long").alias("start"), F.length("body").cast("long").alias("chars"))))
    chat = rows.groupBy("conv").agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", "body", "message", "span", "attached"))).alias("t"))
    return chat.select(
        "conv", F.array_join(F.transform("t", lambda x: x["message"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["attached"])).alias("attachments"))


def parse(formatted: Column) -> Column:
    """The ``(role, text)`` turns of a formatted chat, unescaped (placeholders
    of attachments stay)."""
    pieces = F.split(formatted, r"<\|turn\|>", -1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        start = F.length(role) + 2
        body = F.substr(piece, start, F.length(piece) - start + 1 - len(END))
        return F.struct(unescape(F.replace(role, F.lit("~3"), F.lit("\n"))).alias("role"),
                        unescape(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from the formatted chats."""
    read = chats.select("conv", "formatted", parse(F.col("formatted")).alias("turns"))
    all_ = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"),
                                    lambda t: t["text"]), "")
    read = read.select("conv", "formatted", F.size("turns").cast("long").alias("n_turns"),
                       all_.alias("all"), loss.alias("loss"))
    return read.select(F.col("conv").alias("conv_id"), "n_turns", F.sha2("all", 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
