"""Chat history and the context handed to an answerer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.operators.changes import last_per_key

CONTEXT_CHARACTERS = 10_000
SNIPPET = 300


def session_history(messages: DataFrame, session_id: object | None = None, limit: int | None = None) -> DataFrame:
    """Messages in the order they were written; with a limit the newest ones only. All sessions when none is named."""
    if session_id is not None:
        messages = messages.filter(F.col("session_id") == session_id)
        if limit is not None:
            messages = messages.orderBy(F.desc("turn")).limit(limit)
    elif limit is not None:
        messages = last_per_key(messages, "session_id", "turn", limit)
    return messages.orderBy("session_id", "turn")


def hybrid_results(visual: DataFrame, textual: DataFrame) -> DataFrame:
    """Visual hits then text hits as one list per question.

    ``visual``: question_id, rank, doc_id, filename, text, score. ``textual``: question_id, rank, doc_id, filename,
    snippet. Visual snippets are the first 300 characters; text hits score 1.
    """
    seen = visual.select(
        "question_id", F.lit(0).alias("source_order"), "rank", "doc_id", "filename",
        F.substring(F.coalesce("text", F.lit("")), 1, SNIPPET).alias("snippet"), "score", F.lit("visual").alias("type"))
    read = textual.select(
        "question_id", F.lit(1).alias("source_order"), "rank", "doc_id", "filename", "snippet",
        F.lit(1.0).alias("score"), F.lit("text").alias("type"))
    return seen.unionByName(read)


def pack_context(hits: DataFrame, limit: int = CONTEXT_CHARACTERS) -> DataFrame:
    """Per question the entries of its hits in rank order, up to the first that would pass the limit.

    ``hits``: question_id, rank (1, 2, …), doc_id, filename, snippet. Every entry has a frame of fixed length, so only
    the first ``limit / frame`` ranks can matter; the filter on them is exact and bounds what one question gathers.
    """
    frame = len("[ID:  Archivo: ]:\n\n\n")
    entry = F.concat(F.lit("[ID: "), F.col("doc_id"), F.lit(" Archivo: "), F.coalesce("filename", F.lit("None")),
                     F.lit("]:\n"), F.coalesce("snippet", F.lit("None")), F.lit("\n\n"))
    close = hits.filter(F.col("rank") <= limit // frame).withColumn("entry", entry)
    through = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fitting = close.withColumn("_size", F.sum(F.length("entry")).over(through)).filter(F.col("_size") <= limit)
    packed = fitting.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("parts"))
    return packed.select("question_id", F.size("parts").cast("bigint").alias("n_hits"),
                         F.array_join(F.transform("parts", lambda p: p["entry"]), "").alias("context"))
