"""Files to document rows in one plan: decode, find copies, classify, extract, judge, name; what fails goes to rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions.fields import extract_fields
from sheafwork.functions.text import basename
from sheafwork.operators import classify, fields, linking
from sheafwork.session import cut_lineage
from sheafwork.sources.files import decode_text_files, hash_files


def ingest(files: DataFrame, as_of: Column, day: Column) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of files with doc_id, path and content.

    A document has duplicate_of (the first document with its bytes), type, tags, date, total, vendor, anomalies and
    new_name. Amounts are judged against the earlier ones of their vendor, in the order of doc_id. A file without
    content, or whose content is white space, is rejected with a reason. ``as_of`` decides which dates are odd, ``day``
    opens the new names; neither is read from a clock.

    Texts stay in their rows. They are read three times: for the rejects, for the amounts that are stored before they
    are judged, and for the documents, where copies and judged amounts join as narrow rows.
    """
    decoded = decode_text_files(hash_files(files))
    reason = F.when(F.col("content").isNull() | (F.length("content") == 0), "empty file").when(
        F.trim(F.regexp_replace("text", r"\s", " ")) == "", "no text")
    rejects = decoded.withColumn("reason", reason).filter("reason is not null").select("doc_id", "path", "reason")
    good = decoded.withColumn("reason", reason).filter("reason is null").drop("reason", "content")

    tags = F.concat(F.array_compact(F.array(classify.project_tag(F.col("text")))), linking.vendor_tags(F.col("text")))
    read = good.select(
        "doc_id", "path", "hash", "confidence", classify.classify_keywords(F.col("text")).alias("kind"), tags.alias("tags"),
        fields.normalise_fields(extract_fields(F.col("text"))).alias("fields"))
    read = cut_lineage(read)  # what is known of a text is small; the texts are not carried further

    copies = linking.exact_duplicates(read.select("doc_id", "hash"), "hash").select(
        "doc_id", F.col("first_id").alias("duplicate_of"))
    amounts = read.filter("fields.total is not null").select(
        "doc_id", F.col("fields.vendor.value").alias("vendor"), F.col("fields.total.value").alias("total"))
    judged = fields.amount_anomalies(amounts, "vendor", "doc_id", "total").select(
        "doc_id", F.col("anomalies").alias("amount_anomalies"))
    joined = read.join(copies, "doc_id", "left").join(judged, "doc_id", "left")
    none = F.array().cast("array<string>")
    documents = joined.select(
        "doc_id", "path", "duplicate_of", F.col("kind.type").alias("type"), F.col("kind.tag").alias("keyword"), "tags",
        F.col("fields.date.value").alias("date"), F.col("fields.total.value").alias("total"),
        F.col("fields.vendor.value").alias("vendor"),
        F.concat(fields.field_anomalies(F.col("fields"), as_of), F.coalesce("amount_anomalies", none)).alias("anomalies"),
        classify.smart_filename(day, F.col("kind.type"), F.col("tags"), basename(F.col("path"))).alias("new_name"))
    return documents, rejects
