"""Chat formatting from every participant's side, with DataFrame functions only.

For each speaker of a dialogue (every role but ``system``) the whole dialogue is rendered once, with that speaker's
turns as the assistant's, those of all others as users named by their role, and system turns as they are. The
loss mask covers the bodies and end marks of the assistant's turns, as character ranges ``start-end`` of the rendered text.

    <|system|>\\n...<|end|>\\n   <|user name=bob|>\\n...<|end|>\\n   <|assistant|>\\n...<|end|>\\n

``<|`` inside a text or role becomes ``< |``, so that no text can open a turn.

Defined cases: a null text is an empty turn, a null or empty role the speaker ``unknown``; null turns come first; turns of equal number
follow by role, then text; repeated rows are rendered as often; texts of any length are rendered whole; rows of a null conversation form one; a dialogue
of system turns alone has no participant and gives no row; an empty table gives an empty result; other columns do not matter.
A rendered dialogue is one value, so a dialogue's turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def chat_perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per dialogue and participant: conv_id, speaker, n_turns, rendered, loss_spans, n_loss_chars."""
    role = F.coalesce(F.nullif(_safe(F.col(role_col)), F.lit("")), F.lit("unknown"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), _safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = rows.withColumn("body", F.concat("text", F.lit("<|end|>")))
    mine = F.lit("<|assistant|>\n")
    head = F.when(F.col("role") == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>\n")))
    rows = rows.withColumn("head", head)
    # where each turn ends if all are others' turns; ends are distinct, as no turn is empty
    so_far = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.sum(F.length("head") + F.length("body") + 1).over(so_far))
    # for the speaker of a turn, all of their turns up to it have the assistant's head
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("at"))
    end = F.col("at") + nth * (F.length(mine) - F.length("head"))
    span = F.concat_ws("-", (end - 1 - F.length("body")).cast("string"), (end - 1).cast("string"))
    part = F.struct("at", "role", "head", "body", span.alias("span"))
    dialogues = rows.select("conv_id", part.alias("part")).groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("parts", lambda p: p["role"]), lambda r: r != "system")))
    sides = dialogues.select("conv_id", "parts", F.explode(speakers).alias("speaker"))
    said = F.filter("parts", lambda p: p["role"] == F.col("speaker"))
    whole = F.transform("parts", lambda p: F.concat(F.when(p["role"] == F.col("speaker"), mine).otherwise(p["head"]), p["body"], F.lit("\n")))
    return sides.select(
        "conv_id",
        "speaker",
        F.size("parts").cast("long").alias("n_turns"),
        F.array_join(whole, "").alias("rendered"),
        F.array_join(F.transform(said, lambda p: p["span"]), ",").alias("loss_spans"),
        F.aggregate(said, F.lit(0).cast("long"), lambda n, p: n + F.length(p["body"])).alias("n_loss_chars"),
    )
