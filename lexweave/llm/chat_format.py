"""Chat formatting of typed content parts, in DataFrame expressions only.

A visitor turns each part into text: text parts are escaped, image, audio and document parts become
ordered placeholders. It records the attachments' references and what they expand to in tokens, and the
spans of the formatted string that a loss mask covers. ``parse`` reads turns back from the string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|says|>", "<|done|>"
#: Control strings of this and other common templates; none survives in an escaped text.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
ESCAPES = {"<": "&lt;", "[": "&#91;"}
#: Tokens that an attachment without a count of its own expands to.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type:string,text:string,ref:string,tokens:long>"


def escape(text: Column) -> Column:
    """Makes a text free of control strings, reversibly: ampersands and the first sign of each control string."""
    out = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(ESCAPES[control[0]] + control[1:]))
    return out


def unescape(text: Column) -> Column:
    for sign, written in ESCAPES.items():
        text = F.replace(text, F.lit(written), F.lit(sign))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A text as the one content part of a message."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), null.cast("string").alias("ref"), null.cast("long").alias("tokens")))


def _attached(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) != "text"


def _visit(part: Column, number: Column) -> Column:
    """What a part becomes; ``number`` counts the attachments of the conversation from 1."""
    mark = F.concat(F.lit("<|"), escape(part["type"]), F.lit(":"), number.cast("string"), F.lit("|>"))
    return F.when(_attached(part), mark).otherwise(escape(part["text"]))


def _expansion(part: Column) -> Column:
    usual = F.coalesce(*(F.when(part["type"] == k, F.lit(n)) for k, n in EXPANDED.items()), F.lit(0)).cast("long")
    return F.coalesce(part["tokens"], usual)


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, attachment_tokens) of each conversation.

    ``parts_col`` is an array of PART. Rows go by turn; equal turns by role and then by parts, null turns
    first; repeated rows stay. Null roles and texts are empty, null parts are no parts, types other than
    text are attachments. loss_spans holds (start from 0, length) in code points of each assistant
    message's content. attachments holds (number, type, ref, tokens) in order.

    A conversation is one record and is put together in one row: its turns are the only rows gathered.
    """
    role = escape(F.coalesce(F.col(role_col), F.lit("")))
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>").alias("parts"),
        F.concat(F.lit(TURN), role, F.lit(BODY)).alias("head"),
    )
    gathered = df.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    kept = F.filter(F.flatten(F.col("turns.parts")), _attached)
    attachments = F.transform(
        kept, lambda p, i: F.struct((i + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _expansion(p).alias("tokens"))
    )
    attached = lambda parts: F.size(F.filter(parts, _attached))
    zero = F.struct(F.array().cast("array<int>").alias("before"), F.lit(0).alias("n"))
    before = F.aggregate(
        F.col("turns.parts"),
        zero,
        lambda acc, parts: F.struct(F.concat(acc["before"], F.array(acc["n"])).alias("before"), (acc["n"] + attached(parts)).alias("n")),
        lambda acc: acc["before"],
    )
    # only where there are attachments are they numbered; a plain text needs no count
    body = F.zip_with(
        "turns",
        F.when(F.size(kept) > 0, before).otherwise(F.array_repeat(F.lit(0), F.size("turns"))),
        lambda t, n: F.array_join(
            F.transform(t["parts"], lambda p, i: _visit(p, n + attached(F.slice(t["parts"], 1, i + 1)))), ""
        ),
    )
    laid = gathered.select("conv_id", "turns", attachments.alias("attachments"), body.alias("bodies"))
    said = F.zip_with("turns", "bodies", lambda t, b: F.concat(t["head"], b, F.lit(END)))
    sizes = F.zip_with(
        "turns",
        "bodies",
        lambda t, b: F.struct(F.length(t["head"]).alias("head"), F.length(b).alias("body"), (t["role"] == "assistant").alias("loss")),
    )
    laid = laid.select("conv_id", "attachments", F.array_join(said, "").alias("formatted"), sizes.alias("sizes"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "sizes",
        start,
        lambda acc, s: F.struct(
            (acc["at"] + s["head"] + s["body"] + len(END)).alias("at"),
            F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + s["head"]).alias("start"), s["body"].alias("length")))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    tokens = F.aggregate(F.col("attachments.tokens"), F.lit(0).cast("long"), lambda a, b: a + b)
    return laid.select("conv_id", "formatted", spans.alias("loss_spans"), "attachments", tokens.alias("attachment_tokens"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted string, unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, F.lit(r"<\|done\|>"))
    # the string ends with the mark of its last turn, so the last piece is empty
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        both = F.split(F.substr(piece, F.lit(len(TURN) + 1)), F.lit(r"<\|says\|>"), 2)
        return F.struct(unescape(both[0]).alias("role"), unescape(both[1]).alias("text"))

    return F.transform(turns, turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped and joined with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digest(df: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the output."""
    read = df.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
