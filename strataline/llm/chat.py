"""Multi-party perspective rotation.

Every participant of a dialogue in turn is the assistant, the others are named users, and only the assistant's words are trained on. The result is
one row a turn and perspective: the rendered segment, where it stands in the rendered dialogue and the span that carries loss. A dialogue of any
length is spread over rows; nothing gathers it in one. SQL functions only.

Participants are the distinct roles of a dialogue but `system`, whose turns open every perspective as system segments. Defined results: a null role is
the participant `unknown`, a null text is empty, a null conv_id is a dialogue of its own; roles and texts are rendered as they are, so a text may hold the segments'
own marks: offsets tell segments apart, not marks; turns of equal number are ordered by role and text,
and rows equal in those are repeated; null turns come first; a dialogue of system turns only has no perspective and no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.plans.ordering import running

BEGIN, END, SYSTEM, UNKNOWN = "<|im_start|>", "<|im_end|>\n", "system", "unknown"
TURNS_A_BUCKET = 64


def rotated(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, chat_role, name, segment, start_char, end_char, loss_from, loss_to (null where nothing is trained on)."""
    turns = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("words"))
    people = turns.where(F.col("speaker") != SYSTEM).groupBy(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).agg(F.lit(1).alias("_one")).drop("_one")
    rows = turns.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    chat_role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    rows = rows.withColumn("chat_role", chat_role).withColumn("name", F.when(F.col("chat_role") == "user", F.col("speaker")))
    head = F.concat(F.lit(BEGIN), F.col("chat_role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, F.col("words"), F.lit(END))).withColumn("size", F.length("segment").cast("long"))
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / TURNS_A_BUCKET).cast("long"), F.lit(-(1 << 62))))
    rows = running(rows, ["conv_id", "perspective"], "bucket", [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("words")], F.col("size"), before="start_char")
    trained = F.col("chat_role") == "assistant"
    return rows.select(
        "conv_id", "perspective", "turn", "chat_role", "name", "segment", "start_char", (F.col("start_char") + F.col("size")).alias("end_char"),
        F.when(trained, F.col("start_char") + F.col("head")).cast("long").alias("loss_from"), F.when(trained, F.col("start_char") + F.col("size") - 1).cast("long").alias("loss_to"),
    )


def assembled(rows: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, loss): whole renderings and their loss spans, for dialogues that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("start_char", "segment", "loss_from", "loss_to")))
    out = rows.groupBy("conv_id", "perspective").agg(parts.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["loss_from"].isNotNull()), lambda x: F.struct(x["loss_from"].alias("from"), x["loss_to"].alias("to")))
    return out.select("conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("text"), spans.alias("loss"))
