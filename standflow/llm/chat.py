"""Chat formatting: every assistant turn becomes an example of its own.

An example holds all turns up to one assistant turn, and only that reply is trainable. Turns after
the last reply, or a conversation without one, give one example without a trainable part, so that
the output holds every turn.

A turn is written `<s>role\\ntext\\n</s>`. A control string inside a text gets a backslash in front,
and the backslashes before it are doubled; the template never puts one after a backslash, so both
can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the strings a chat template reserves
CONTROL = r"(</?s>|\[/?INST\]|<</?SYS>>)"
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*){CONTROL}", r"$1$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)\1\\{CONTROL}", "$1$2")


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Examples: conv_id, example (the number of its last turn, from 0), last (whether it is the
    conversation's last), formatted, loss_start and loss_end (code points of the trainable part in
    `formatted`, end exclusive; null without one).

    Turns are in the order of `turn`, ties by role and text, nulls first; null role and text are
    empty; rows of a null conversation are one conversation. Other columns are not read. An example
    is one row and holds its whole context, so a conversation must fit into a row."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(role_col, F.lit("")).alias("role"),
            F.coalesce(text_col, F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    written = chats.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == TRAINABLE).alias("train"),
                F.concat(F.lit("<s>"), F.url_encode(t["role"]), F.lit("\n")).alias("head"),
                F.concat(escape(t["text"]), F.lit("\n</s>")).alias("body"),
            ),
        ).alias("turns"),
    )
    last = F.size("turns") - 1
    targets = F.filter(
        F.sequence(F.lit(0), last), lambda i: F.get("turns", i)["train"] | (i == last)
    )
    examples = written.select("conv_id", "turns", last.alias("n"), F.explode(targets).alias("example"))
    body = F.get("turns", F.col("example"))
    formatted = F.array_join(
        F.transform(
            F.slice("turns", F.lit(1), F.col("example") + 1),
            lambda t: F.concat(t["head"], t["body"]),
        ),
        "",
    )
    return examples.select(
        "conv_id",
        "example",
        (F.col("example") == F.col("n")).alias("last"),
        formatted.alias("formatted"),
        F.when(body["train"], F.length(body["body"])).alias("tail"),
    ).select(
        "conv_id",
        "example",
        "last",
        "formatted",
        (F.length("formatted") - F.col("tail")).alias("loss_start"),
        (F.length("formatted") - F.when(F.col("tail").isNotNull(), 5)).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"(?<!\\)</s>", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        text = F.substr(p, F.length(head) + 2, F.length(p) - F.length(head) - 2)
        return F.struct(
            F.url_decode(F.substr(head, F.lit(4))).alias("role"), unescape(text).alias("text")
        )

    return F.transform(pieces, turn)


def chat_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256 (role, newline, text,
    newline per turn), loss_chars, loss_sha256 (the trainable texts in order), formatted_chars."""
    trained = F.when(
        F.col("loss_start").isNotNull(),
        unescape(
            F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
        ),
    )
    turns = F.transform(
        read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    each = examples.select(
        "conv_id",
        F.when(F.col("last"), turns).alias("turns"),
        F.struct("example", trained.alias("text")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        "loss",
        "chars",
    )
    grouped = each.groupBy("conv_id").agg(
        F.max(F.when(F.col("turns_sha256").isNotNull(), F.col("n"))).alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.array_sort(F.collect_list("loss"))["text"], "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return grouped.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
