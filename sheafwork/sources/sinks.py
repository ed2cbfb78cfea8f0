"""Tables and reports written out."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions.text import stem_of
from sheafwork.plans.prefix import row_numbers
from sheafwork.session import cut_lineage

# Columns of the document export and of the batch report, in order.
EXPORT_COLUMNS = ("id", "filename", "type", "status", "workflow_state", "confidence", "datetime", "path")
REPORT_COLUMNS = ("filename", "status", "duration", "type")


def with_new_ids(rows: DataFrame, order: str, highest: int = 0, name: str = "doc_id") -> DataFrame:
    """Rows numbered from ``highest`` + 1 in ``order``, a unique number per row; no global window is used."""
    numbered = row_numbers(rows, [], [order], bucket_by=order, name=name)
    return numbered.withColumn(name, (F.col(name) + highest).cast("bigint"))


def append_documents(spark: SparkSession, rows: DataFrame, folder: str, order: str) -> DataFrame:
    """Append documents and their texts to the store below ``folder``; returns the new ids with ``order``.

    ``rows`` holds the document columns and text, language and confidence. Documents are partitioned by status; one
    text row follows for every document whose text is not empty. There must be one writer at a time: two that read the
    same highest id would give it out twice.
    """
    store = f"{folder}/documents"
    try:
        highest = spark.read.parquet(store).agg(F.max("doc_id")).first()[0] or 0
    except Exception as error:  # noqa: BLE001 - only a store that does not exist yet starts at zero
        if "PATH_NOT_FOUND" not in str(error):
            raise
        highest = 0
    numbered = cut_lineage(with_new_ids(rows, order, highest))  # documents, texts and the answer see the same ids
    texts = numbered.filter(F.length("text") > 0).select(
        F.col("doc_id").alias("id_doc"), "text", "language", "confidence")
    numbered.drop("text", "language", "confidence").write.mode("append").partitionBy("status").parquet(store)
    texts.write.mode("append").parquet(f"{folder}/texts")
    return numbered.select("doc_id", order)


def export_frame(docs: DataFrame) -> DataFrame:
    """The eight export columns; what a frame lacks is empty, what it has besides is ignored."""
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in EXPORT_COLUMNS])


def export_documents_csv(docs: DataFrame, path: str) -> None:
    export_frame(docs).write.mode("overwrite").option("header", True).csv(path)


def report_frame(records: DataFrame) -> DataFrame:
    return records.select(*REPORT_COLUMNS)


def batch_summary_report(records: DataFrame, path: str) -> None:
    report_frame(records).write.mode("overwrite").option("header", True).csv(path)


def side_outputs(summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(JSON summaries, Markdown texts), each with the document's name in ``stem``; empty Markdown is left out.

    ``summaries``: path, the summary columns, and ``markdown``.
    """
    named = summaries.withColumn("stem", stem_of(F.col("path")))
    return named.drop("markdown"), named.filter(F.length("markdown") > 0).select("stem", "markdown")


def export_side_outputs(summaries: DataFrame, folder: str) -> None:
    """Write JSON summaries, one record per document, and a file ``<stem>.md`` per Markdown text, below ``folder``.

    A task that runs again writes its files again, with the same content.
    """
    summary, markdown = side_outputs(summaries)
    summary.write.mode("overwrite").json(f"{folder}/json")
    target = folder if re.match(r"\w+:", folder) else f"file://{os.path.abspath(folder)}"
    system, root = fs.FileSystem.from_uri(f"{target}/markdown")
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stem, text in zip(batch["stem"], batch["markdown"]):
                with system.open_output_stream(f"{root}/{stem}.md") as file:
                    file.write(text.encode())
            yield pd.DataFrame({"written": [len(batch)]})

    markdown.mapInPandas(write, "written bigint").agg(F.sum("written")).collect()


def write_postings(postings: DataFrame, path: str, partitions: int | None = None) -> None:
    """Postings sorted by term, so a scan for a few terms skips most row groups; a frequent term spans several files."""
    ranged = postings.repartitionByRange(partitions, "term", "doc_id") if partitions else postings.repartitionByRange(
        "term", "doc_id")
    ranged.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def store_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Save a table bucketed and sorted by ``key``; two tables with equal buckets join on it without a shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
