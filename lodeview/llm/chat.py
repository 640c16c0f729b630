"""Chat formatting as a relational plan of Spark expressions.

A conversation's turns are collected as structs, sorted, cut into blocks of
adjacent turns with one role, and joined to one text::

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT...]<|im_end|>\\n...

Inside a text every ``<``, any number of ``\\``, ``|`` gets one more ``\\`` and so
never reads as a mark; taking one away gives the text back. A role is
URL-encoded. The loss mask is carried as segments: pieces of the output in
order, flagged where the model is to learn them (each assistant's text, without
marks). ``parse`` reads turns back from the output alone.

A conversation is one output row, so its turns do meet in one task; that is the
feature. All expressions are linear in its length.

Defined cases: a null text is empty; a null role is written as an empty role;
turns with the same number are ordered by role, then text; repeated rows are
repeated turns; conversations with a null id are one conversation; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def format_chats(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant"
) -> DataFrame:
    """(conv id, formatted, segments) with segments array<struct<text, loss>>."""
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    sorted_ = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    role = lambda i: F.element_at("t", i)["role"]
    places = F.sequence(F.lit(1), F.size("t"))
    starts = F.filter(places, lambda i: (i == 1) | F.when(i > 1, role(i) != role(i - 1)))
    cut = sorted_.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, k: F.slice("t", s, F.when(k + 1 < F.size("starts"), F.element_at("starts", (k + 2).cast("int")) - s).otherwise(F.size("t") - s + 1)),
    )
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    off = F.lit(False)
    one = lambda b: F.concat(
        F.array(piece(F.concat(F.lit(START), F.url_encode(b[0]["role"]), F.lit("\n")), off)),
        F.flatten(
            F.transform(
                b,
                lambda t, i: F.when(i == 0, F.array(piece(escape(t["text"]), t["role"] == learn))).otherwise(
                    F.array(piece(F.lit(SEP), off), piece(escape(t["text"]), t["role"] == learn))
                ),
            )
        ),
        F.array(piece(F.lit(END), off)),
    )
    segments = F.flatten(F.transform(blocks, one))
    return cut.select("conv", segments.alias("segments")).select(F.col("conv").alias(conv_col), F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns, from the formatted text."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b.startswith(START))
    head = lambda b: F.substring_index(b, "\n", 1)
    role = lambda b: F.url_decode(F.substring(head(b), F.lit(len(START) + 1), F.length(head(b))))
    body = lambda b: F.substring(b, F.length(head(b)) + 2, F.length(b))
    return F.flatten(
        F.transform(blocks, lambda b: F.transform(F.split(body(b), r"<\|im_sep\|>", -1), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text"))))
    )


def report(turns: DataFrame, *, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """Digests of what the output holds: turns read back from the text, and all text under the loss mask."""
    made = format_chats(turns, conv_col=conv_col, **columns)
    read = made.withColumn("turns", parse(F.col("formatted")))
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
