"""Counts, rates and summaries. All grouping is algebraic, so every aggregate combines on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions.text import strip, title_case

VERIFY_CONFIDENCE = 0.8
HANDWRITING = 0.5
COLOUR_STEP = 32


def corpus_overview(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("*").alias("total"), F.count_if(F.col("workflow_state") == "pending").alias("pending")
    )


def status_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("status").agg(F.count("*").alias("n"))


def type_counts(docs: DataFrame, k: int = 10) -> DataFrame:
    """Documents per type, spelling variants merged, the k most frequent (names break ties).

    Raw spellings are counted first, so the title-casing runs once per spelling instead of once per document.
    """
    raw = docs.filter(F.col("type").isNotNull()).groupBy("type").agg(F.count("*").alias("n"))
    clean = F.when(F.col("type") == "", "Desconocido").otherwise(title_case(strip(F.col("type"))))
    merged = raw.groupBy(clean.alias("clean_type")).agg(F.sum("n").alias("n"))
    return merged.orderBy(F.desc("n"), "clean_type").limit(k)


def failure_reasons(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("status") == "FAILED").groupBy("error_message").agg(F.count("*").alias("n"))


def failed_samples(docs: DataFrame, k: int = 10) -> DataFrame:
    return docs.filter(F.col("status") == "FAILED").orderBy("doc_id").limit(k).select("doc_id", "filename", "path")


def _tally(records_ok: Column, records_failed: Column, seconds: Column) -> list[Column]:
    total = records_ok + records_failed
    return [
        records_ok.alias("ok_docs"), records_failed.alias("failed_docs"),
        F.when(total == 0, 0.0).otherwise(seconds / total).alias("avg_time"),
        F.when(total == 0, 0.0).otherwise(records_ok / total * 100.0).alias("reliability_pct"),
    ]


def batch_metrics(records: DataFrame, *keys: str, seconds: Column | None = None) -> DataFrame:
    """Per batch: ok, failed (duplicates are neither), seconds per document and reliability.

    ``seconds`` is the batch's elapsed time; by default the durations of its records are added up.
    """
    ok, failed = F.count_if(F.col("status") == "OK"), F.count_if(F.col("status") == "FAILED")
    spent = seconds if seconds is not None else F.sum("duration")
    return records.groupBy(*keys).agg(*_tally(ok, failed, spent))


def document_text_and_confidence(blocks: DataFrame, language: str = "es") -> DataFrame:
    """Per document: non-empty block texts in block order, one per line, and their mean confidence.

    Blocks are joined page by page before documents are, so a document of many pages reaches its final row as one
    string per page and not as one object per block.
    """
    used = blocks.filter(F.coalesce(F.length("text"), F.lit(0)) > 0)
    pages = used.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("block_id", "text"))).alias("parts"),
        F.sum("confidence").alias("confidence"), F.count("*").alias("n"),
    ).withColumn("page_text", F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).drop("parts")
    whole = pages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "page_text"))).alias("pages"),
        (F.sum("confidence") / F.sum("n")).alias("confidence"),
    )
    text = strip(F.array_join(F.transform("pages", lambda p: p["page_text"]), "\n"))
    return whole.select("doc_id", text.alias("text"), "confidence").withColumn(
        "language", F.when(F.length("text") > 0, language)
    )


def store_reconciliation(store_a: tuple[DataFrame, DataFrame], store_b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(documents, texts) counts of two stores side by side, and what the second lacks."""
    def counts(store: tuple[DataFrame, DataFrame], name: str) -> DataFrame:
        rows = [df.agg(F.count("*").alias(name)).withColumn("table", F.lit(t)) for t, df in
                zip(("documents", "texts"), store)]
        return rows[0].unionByName(rows[1])

    both = counts(store_a, "count_a").join(counts(store_b, "count_b"), "table")
    return both.withColumn("delta", F.col("count_a") - F.col("count_b"))


def dominant_colors(pixels: DataFrame, k: int = 5) -> DataFrame:
    """Per image the k most frequent colours after bucketing each channel by 32."""
    def bucket(channel: str) -> Column:
        return (F.floor(F.col(channel) / COLOUR_STEP) * COLOUR_STEP).cast("int")

    counts = pixels.groupBy("image_id", *[bucket(c).alias(c) for c in "rgb"]).agg(F.count("*").alias("n"))
    hexed = counts.withColumn("hex", F.format_string("#%02x%02x%02x", "r", "g", "b"))
    # at most 8³ colours per image remain here, so the list per image is small whatever its pixel count
    ranked = hexed.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "hex")))
                                           .alias("all"))
    top = ranked.select("image_id", F.posexplode(F.slice("all", 1, k)).alias("rank", "c"))
    return top.select("image_id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("c.hex").alias("hex"),
                      (-F.col("c.neg")).alias("n"))


def auto_verify(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents with confidence at least 0.8 become verified and OK; the others keep their state."""
    confidence = texts.select(F.col("id_doc").alias("doc_id"), "confidence")
    sure = F.coalesce(F.col("confidence") >= VERIFY_CONFIDENCE, F.lit(False))
    return docs.join(confidence, "doc_id", "left").withColumns({
        "verified": sure,
        "status": F.when(sure, "OK").otherwise(F.col("status")),
        "workflow_state": F.when(sure, "verified").otherwise(F.col("workflow_state")),
    })


def auto_verify_tally(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("skipped"))


def page_confidence(pages: DataFrame) -> DataFrame:
    """Per document the mean page confidence, and whether any page looks handwritten."""
    return pages.groupBy("doc_id").agg(
        F.avg("confidence").alias("confidence"),
        (F.max("handwriting") > HANDWRITING).alias("handwritten"),
    )
