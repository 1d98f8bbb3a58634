"""Questions as a stream: each meets the turns of its conversation in the time before it, and whole questions go down the ask path in batches.

A question (query_id, conv_id, question, asked_at) joins turns (conv_id, turn, role, text, said_at) said at most ``reach`` before
it: an interval join of two streams, whose state ends with the watermarks. Its turns are gathered into one row, sent on once the
watermark has passed the question, so late turns that are in time are with it; rows later than ``late`` are dropped, as streams do. A question
without turns is sent on as well. Repeated turns count once. Rows without a time, and turns without a conversation, tell nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUESTIONS = "query_id long, conv_id string, question string, asked_at timestamp"
TURNS = "conv_id string, turn long, role string, text string, said_at timestamp"


def with_turns(questions: DataFrame, turns: DataFrame, reach: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(query_id, question, asked_at, turns): one row a question; for streams and, with the same rows, for tables."""
    q = questions.filter("asked_at is not null").withColumn("conv_id", F.coalesce("conv_id", F.lit(""))).withWatermark("asked_at", late)
    t = turns.filter("said_at is not null and conv_id is not null").select(F.col("conv_id").alias("__conv"), "turn", "role", "text", "said_at").withWatermark("said_at", late)
    near = (F.col("conv_id") == F.col("__conv")) & (F.col("said_at") <= F.col("asked_at")) & (F.col("said_at") >= F.col("asked_at") - F.expr(f"interval {reach}"))
    met = q.join(t, near, "left")
    turn = F.when(F.col("turn").isNotNull(), F.struct("turn", "role", "text"))
    return met.groupBy("query_id", "question", "asked_at").agg(F.sort_array(F.collect_set(turn)).alias("turns")).select("query_id", "question", "asked_at", "turns")


def follow(questions: DataFrame, turns: DataFrame, answer: Callable[[DataFrame, DataFrame], None], checkpoint: str, reach: str = "1 hour", late: str = "10 minutes", once: bool = True):
    """Start the stream. ``answer`` gets a batch's (query_id, question) and its (query_id, turn, role, text), as ``plans.ask.ask`` takes them, and writes what it makes; a batch may come again after a failure."""

    def batch(df: DataFrame, i: int) -> None:
        df = df.persist()
        try:
            answer(df.select("query_id", "question"), df.select("query_id", F.inline("turns")))
        finally:
            df.unpersist()

    writer = with_turns(questions, turns, reach, late).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="5 seconds").start()
