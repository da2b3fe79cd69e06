"""Chat formatting by prefix-target expansion, with built-in functions only.

A turn is `[INST] role\\ntext [/INST]`, or, of an assistant, `text</s>`. Control strings that a text or role holds get a
backslash after their bracket (one more, if they have some already), so that they are none, and none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT, OPEN, CLOSE, END = "assistant", "[INST] ", " [/INST]", "</s>"
#: A bracket, backslashes, and the rest of a control string.
CONTROL = r"([\[<])(\\*)(/?INST\]|/?s>)"
ESCAPED = r"([\[<])\\(\\*)(/?INST\]|/?s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """Roles end at a line end, so theirs are spelt out."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted_turn(role: Column, text: Column) -> Column:
    said = escape(text)
    return F.when(role == ASSISTANT, F.concat(said, F.lit(END))).otherwise(F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"), said, F.lit(CLOSE)))


def prefix_targets(turns: DataFrame) -> DataFrame:
    """Examples (conv_id, example, text, loss_start, loss_end, last) of turns(conv_id, turn, role, text).

    One example for each assistant turn: the text has all turns before it as context, and [loss_start, loss_end) (code
    points) holds the reply alone. Turns after the last reply are a last example without a target (loss_start =
    loss_end), so that every conversation and turn is in the output. Turns go by turn, then role and text; null texts
    and roles are empty, null turns come first, rows without conv_id are one conversation, repeated rows are turns of
    their own, an empty table has no examples; other columns aren't read. One conversation is one row's text, as it is
    one example; no two are gathered together.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), formatted_turn(role, text).alias("said"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    size = F.length("said").cast("long")
    rows = rows.select("conv_id", "said", (F.col("role") == ASSISTANT).alias("reply"), size.alias("size"), F.row_number().over(order).alias("n"), F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "reply", "size", "end", "said"))).alias("t"))
    last = F.element_at("t", -1)
    target = lambda t: F.struct(t["end"].alias("end"), t["size"].alias("size"), t["reply"].alias("reply"), (t["n"] == last["n"]).alias("last"))
    whole = whole.select("conv_id", F.array_join(F.transform("t", lambda t: t["said"]), "").alias("said"), F.transform(F.filter("t", lambda t: t["reply"] | (t["n"] == last["n"])), target).alias("targets"))
    each = whole.select("conv_id", "said", F.posexplode("targets").alias("example", "x"))
    text, end = F.substring("said", F.lit(1), F.col("x.end").cast("int")), F.col("x.end") - len(END)
    none = ~F.col("x.reply")
    return each.select(
        "conv_id", "example", text.alias("text"), F.when(none, F.col("x.end")).otherwise(F.col("x.end") - F.col("x.size")).alias("loss_start"),
        F.when(none, F.col("x.end")).otherwise(end).alias("loss_end"), F.col("x.last").alias("last"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation of `prefix_targets`: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are parsed from the last example's text. An example's text is dropped before conversations are put together.
    """
    said = F.filter(F.split("text", r"(?<=\[/INST\])|(?<=</s>)", -1), lambda t: t != "")

    def turn(t: Column) -> Column:
        line = F.locate("\n", t)
        other = F.concat(unescape_role(F.substring(t, F.lit(len(OPEN) + 1), line - len(OPEN) - 1)), F.lit("\n"), unescape(F.substring(t, line + 1, F.length(t) - line - len(CLOSE))), F.lit("\n"))
        return F.when(F.startswith(t, F.lit(OPEN)), other).otherwise(F.concat(F.lit(ASSISTANT + "\n"), unescape(F.substring(t, F.lit(1), F.length(t) - len(END))), F.lit("\n")))

    loss = unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    parsed = examples.select(
        "conv_id", "example", loss.alias("loss"), F.length("text").cast("long").alias("chars"),
        F.when(F.col("last"), F.size(said)).cast("long").alias("n_turns"), F.when(F.col("last"), F.sha2(F.array_join(F.transform(said, turn), ""), 256)).alias("sha"),
    )
    return parsed.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sum(F.length("loss")).alias("loss_chars"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), ""), 256).alias("loss_sha256"), F.sum("chars").alias("formatted_chars"),
    )
