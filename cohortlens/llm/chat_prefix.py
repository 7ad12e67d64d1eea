"""Chat formatting with prefix-target expansion, in DataFrame functions alone.

A turn is written ``[INST]role[/INST]text</s>``, a conversation is its turns
in order. Control strings inside roles and texts are broken up by a backslash
after their first character and backslashes are doubled, so the marks are
unambiguous and ``unescape`` restores every text exactly.

``layout`` has a row for each turn with its place in the formatted conversation; it
grows with the input. ``examples`` explodes every assistant turn into an
example of its own: all preceding turns as context and that reply, of which
only the reply's text [loss_start, loss_end) is trainable. Turns after the last
reply end in one example without a target, so nothing is lost. Example texts
repeat their context; that is what the expansion asks for. They are cut one after another
from the conversation's turns, so a task holds a conversation and one text, while the time
grows with the square of the turns. ``text=False`` leaves the texts out (the layout then
serves as the text, and ``read_back`` reads it).

Nulls and edges: a null text or role is empty; turns are ordered by turn (null
first), then role, then text, and repeated rows are turns like any other; a
null conv_id is one conversation; a conversation without assistant turns is
one example without a target; an empty table gives no rows; other columns are
ignored. The prefix sums of a conversation run in one task, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Break up <s>, </s>, [INST], [/INST], <<SYS>> and <</SYS>>; double backslashes."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"<(?=/?s>|</?SYS>>)|\[(?=/?INST\])", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def layout(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, formatted, start, loss_start, loss_end, end: code points of the formatted conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    rows = (turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .withColumn("position", F.row_number().over(order)))
    rows = rows.withColumn("head", head).withColumn("formatted", F.concat("head", escape(F.col("text")), F.lit(END)))
    size = F.char_length("formatted").cast("long")
    end = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - size)
    return rows.select("conv_id", "position", "role", "formatted", "start", (F.col("start") + F.char_length("head")).alias("loss_start"),
                       (F.col("end") - len(END)).alias("loss_end"), "end")


def examples(turns: DataFrame, text: bool = True, target_role: str = TARGET_ROLE) -> DataFrame:
    """conv_id, target (the reply's position, null: none), last (position of the last turn), text, loss_start, loss_end, chars, final (whether it ends the conversation)."""
    return examples_of(layout(turns), text, target_role)


def examples_of(laid: DataFrame, text: bool = True, target_role: str = TARGET_ROLE) -> DataFrame:
    """``examples`` from a layout."""
    trainable = F.col("role") == target_role
    if text:
        whole = laid.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "role", "formatted", "loss_start", "loss_end", "end"))).alias("_turns"))
        ends = F.filter("_turns", lambda t: (t["role"] == target_role) | (t["position"] == F.size("_turns")))
        rows = whole.select("conv_id", "_turns", F.explode(ends).alias("_end")).select(
            "conv_id", "_end.*", (F.col("_end.position") == F.size("_turns")).alias("final"),
            F.array_join(F.transform(F.slice("_turns", F.lit(1), F.col("_end.position")), lambda t: t["formatted"]), "").alias("text"))
    else:
        rows = laid.withColumn("final", F.lead("position").over(Window.partitionBy("conv_id").orderBy("position")).isNull()).filter(trainable | F.col("final"))
    if_target = lambda c: F.when(trainable, F.col(c))
    return rows.select(
        "conv_id", if_target("position").alias("target"), F.col("position").alias("last"), *(["text"] if text else []),
        if_target("loss_start").alias("loss_start"), if_target("loss_end").alias("loss_end"), F.col("end").alias("chars"), "final")


def parse(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    turns = F.slice(F.split(text, END, -1), F.lit(1), F.size(F.split(text, END, -1)) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), CLOSE, 1)).alias("role"),
        unescape(F.substr(t, F.locate(CLOSE, t) + len(CLOSE))).alias("text")))


def digest(made: DataFrame) -> DataFrame:
    """What a reader of the examples finds in each conversation: its turns, and the text under the loss masks."""
    loss = unescape(F.substr("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    rows = made.select("conv_id", "target", "last", "chars", F.when(F.col("final"), F.col("text")).alias("text"), F.when(F.col("target").isNotNull(), loss).alias("_loss"))
    found = rows.groupBy("conv_id").agg(
        F.max("text").alias("text"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "_loss")))).alias("losses"))
    turns = parse(F.col("text"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss_text = F.array_join(F.transform("losses", lambda x: x["_loss"]), "")
    return found.withColumn("turns", turns).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"), "formatted_chars")


def read_back(made: DataFrame, laid: DataFrame) -> DataFrame:
    """``digest`` of examples without texts, from the layout that they point into, in time linear in a conversation's length.

    Every turn is parsed, and every reply cut out by its loss mask, from its own row; an example meets its last turn by conversation and position.
    """
    spans = made.select(F.col("conv_id").alias("_conv"), "last", "target", F.col("loss_start").alias("_from"), F.col("loss_end").alias("_to"), "chars")
    both = laid.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("position") == F.col("last")), "left")
    turn = parse(F.col("formatted"))[0]
    loss = unescape(F.substr("formatted", (F.col("_from") - F.col("start") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")))
    rows = both.select("conv_id", "position", "chars", turn.alias("turn"), F.when(F.col("target").isNotNull(), loss).alias("loss"))
    line = F.concat("turn.role", F.lit("\n"), "turn.text", F.lit("\n"))
    found = rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"),
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("position", "loss")))).alias("losses"))
    lines = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    loss_text = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return found.select("conv_id", "n_turns", F.sha2(lines, 256).alias("turns_sha256"), F.char_length(loss_text).cast("long").alias("loss_chars"),
                        F.sha2(loss_text, 256).alias("loss_sha256"), "formatted_chars")


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: control strings as ordinary text."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
