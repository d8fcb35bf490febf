"""Chat formatting by perspective: each participant in turn is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridge.runtime import written

SYSTEM = "system"
UNNAMED = "unknown"
#: Turns of a conversation from which on it is spread over this many salts; at most ``SHARES`` conversations have a ``SHARES``-th of all turns.
LARGE, SHARES, SALTS = 10_000, 1_000, 64


def _plain(said: Column) -> Column:
    """Text in which no marker of the format can begin or end."""
    return F.replace(F.replace(said, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, perspective, turn, speaker, as_role, rendered, mask, learn_from, learn_to, n_chars)``: every dialogue from every participant's side.

    Participants are the distinct speakers of a conversation but ``system``, whose turns stand in every perspective as they are. In a perspective its speaker's turns are ``<|assistant|>``, others' ``<|user|>`` with the speaker's name. ``mask`` is 1 for what the assistant says, and the code points from ``learn_from`` up to ``learn_to`` of ``rendered``, the text and its end mark without the header, are what to learn; elsewhere both are 0. ``rendered`` pieces in order of turn, then speaker and text where turns share a number, make the dialogue; ``n_chars`` is a piece's length in code points. In names and texts ``<|`` and ``|>`` get a backslash between, so that only the format's own markers stand.

    A piece is a row. A conversation of many turns is salted, so that one that holds a third of all turns spreads over tasks; only distinct speakers are grouped, map-side first. Null and empty speakers are ``unknown``, null texts empty, null conversations one conversation, null turns stay; repeated rows are rendered as often as they come. A conversation of system turns alone has no perspective, an empty table no rows. Other columns aren't read.
    """
    own = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.nullif(F.col(role).cast("string"), F.lit("")), F.lit(UNNAMED)).alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    speakers = written(own.groupBy("conv_id", "speaker").agg(F.count("*").alias("n")))
    total = speakers.agg(F.sum("n")).first()[0] or 0
    large = speakers.groupBy("conv_id").agg(F.sum("n").alias("n")).where(F.col("n") >= max(LARGE, -(-total // SHARES))).select(F.col("conv_id").alias("large_id"), F.lit(SALTS).alias("salts"))

    def spread(df: DataFrame, salt: Column) -> DataFrame:
        # at most SHARES rows
        known = df.join(F.broadcast(large), F.col("conv_id").eqNullSafe(F.col("large_id")) & F.col("salts").isNotNull(), "left")
        return known.withColumn("salt", salt).drop("large_id", "salts")

    salts = F.coalesce("salts", F.lit(1))
    o = spread(own, F.pmod(F.xxhash64("turn", "text"), salts).cast("int")).alias("o")
    s = spread(speakers.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")), F.explode(F.sequence(F.lit(0), salts - 1))).alias("s")
    joined = o.join(s, F.col("o.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("o.salt") == F.col("s.salt"))).select("o.*", "perspective")
    as_role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit("<|"), F.col("as_role"), F.when(F.col("as_role") == "user", F.concat(F.lit(" name="), _plain(F.col("speaker")))).otherwise(""), F.lit("|>\n"))
    shown = joined.withColumn("as_role", as_role).withColumn("head", head).withColumn("rendered", F.concat("head", _plain(F.col("text")), F.lit("<|end|>\n")))
    learns = F.col("as_role") == "assistant"
    where = lambda at: F.when(learns, at).otherwise(0).cast("long")
    n = F.char_length("rendered")
    return shown.select("conv_id", "perspective", "turn", "speaker", "as_role", "rendered", learns.cast("int").alias("mask"), where(F.char_length("head")).alias("learn_from"), where(n - 1).alias("learn_to"), n.cast("long").alias("n_chars"))
