"""Registry reads: filters, projections, pages and newest-k lists over the documents table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions.text import extension

# Extensions shown in the gallery and those the visual branch accepts.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".jfif", ".avif", ".gif", ".tif", ".tiff")
PDF_EXTENSIONS = (".pdf",)
# Language codes and what they mean.
LANGUAGES = {"spa": "es", "es": "es", "esp": "es", "spanish": "es", "eng": "en", "en": "en", "english": "en"}
# Layout labels and their normal form.
LAYOUT_LABELS = {
    "text": "text", "title": "title", "table": "table", "figure": "figure", "header": "title", "footer": "other",
    "caption": "text", "list": "text", "figure_caption": "figure", "equation": "other", "seal": "seal",
    "signature": "signature",
}
PROGRESS = 50


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _matching(docs: DataFrame, status: str | None, type_: str | None, search: str | None) -> DataFrame:
    if status:
        docs = docs.filter(F.col("status") == status)
    if type_:
        docs = docs.filter(F.col("type") == type_)
    if search:
        docs = docs.filter(F.col("filename").ilike(f"%{search}%") | F.col("type").ilike(f"%{search}%"))
    return docs


def list_documents(
    docs: DataFrame, status: str | None = None, type_: str | None = None, search: str | None = None, page: int = 1,
    per_page: int = 20,
) -> DataFrame:
    """One page of the documents that match, newest first (ids break ties)."""
    chosen = _matching(docs, status, type_, search)
    return chosen.orderBy(F.desc("datetime"), F.desc("doc_id")).offset((page - 1) * per_page).limit(per_page)


def page_count(
    docs: DataFrame, status: str | None = None, type_: str | None = None, search: str | None = None, per_page: int = 20
) -> DataFrame:
    """Matching rows and number of pages (at least one)."""
    total = _matching(docs, status, type_, search).agg(F.count("*").alias("total"))
    return total.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint"))


def keyword_documents(docs: DataFrame, texts: DataFrame, keyword: str | None = None, limit: int = 100) -> DataFrame:
    """Documents whose name or text holds the keyword; without one, the newest.

    Texts are searched where they are read; only the ids of those that match are shuffled.
    """
    if keyword:
        pattern = f"%{keyword}%"
        matching = texts.filter(F.col("text").ilike(pattern)).select(F.col("id_doc").alias("doc_id")).distinct()
        found = docs.join(matching.withColumn("_in_text", F.lit(True)), "doc_id", "left")
        docs = found.filter(F.col("filename").ilike(pattern) | F.col("_in_text")).drop("_in_text")
    return docs.orderBy(F.desc("datetime"), F.desc("doc_id")).limit(limit)


def verification_queue(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents waiting for review, with recognition confidence, oldest first."""
    waiting = docs.filter(F.col("workflow_state") == "pending")
    confidence = texts.select(F.col("id_doc").alias("doc_id"), "confidence")
    joined = waiting.join(confidence, "doc_id", "left")
    return joined.select("doc_id", "filename", "datetime", "confidence", "type").orderBy("datetime", "doc_id")


def active_work(docs: DataFrame, limit: int = 50) -> DataFrame:
    """Documents in processing, shown as tasks."""
    running = docs.filter(F.col("status") == "processing").orderBy("doc_id").limit(limit)
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("Detectando..."))
    return running.select(
        F.concat(F.lit("DOC-"), F.col("doc_id")).alias("id"),
        F.concat(F.lit("Procesando: "), F.col("filename")).alias("name"),
        F.concat(F.lit("Tipo: "), kind).alias("args"),
        F.lit("active").alias("status"),
        F.lit(PROGRESS).cast("bigint").alias("progress"),
    )


def gallery_recent(docs: DataFrame, k: int = 50) -> DataFrame:
    """Images among the newest k documents; the limit comes first, so fewer than k can remain."""
    newest = docs.orderBy(F.desc("doc_id")).limit(k)
    return newest.filter(extension(F.col("path")).isin(*IMAGE_EXTENSIONS)).select(
        "doc_id", "filename", "path", F.lit(0.0).alias("score"), "datetime", parse_json_array(F.col("tags")).alias("tags")
    )


def parse_json_array(value: Column) -> Column:
    """JSON text → array of strings; null, empty or invalid text gives an empty array."""
    return F.coalesce(F.from_json(value, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def parse_json(value: Column, schema: str, default: Column | None = None) -> Column:
    """JSON text → typed value, or the default when null or invalid."""
    parsed = F.from_json(value, schema, {"mode": "PERMISSIVE"})
    return parsed if default is None else F.coalesce(parsed, default)


def provider_lookup(providers: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Providers whose canonical name or any alias contains the query, ignoring case."""
    q = query.lower()
    hit = F.lower("canonical_name").contains(q) | F.exists("aliases", lambda a: F.lower(a).contains(q))
    return providers.filter(hit).orderBy("provider_id").limit(limit).select(
        F.col("provider_id").alias("id"), F.col("canonical_name").alias("name"),
        F.coalesce("vat_number", F.lit("")).alias("vat"), F.coalesce("category", F.lit("")).alias("category"),
    )


def review_fields(structured: DataFrame) -> DataFrame:
    """Flatten ``fields`` into value and ``_conf`` columns; an edited value wins over the extracted one."""
    def value(edited: str, extracted: Column) -> Column:
        return F.coalesce(F.nullif(F.col(edited), F.lit("")), extracted.cast("string"))

    return structured.select(
        "doc_id",
        F.col("fields.date.confidence").alias("date_conf"),
        F.col("fields.total.confidence").alias("total_conf"),
        F.col("fields.vendor.confidence").alias("vendor_conf"),
        value("date", F.col("fields.date.value")).alias("date"),
        value("total", F.col("fields.total.value")).alias("total"),
        value("supplier", F.col("fields.vendor.value")).alias("vendor"),
    )


def map_language(code: Column) -> Column:
    """Language code as engines expect it; unknown codes stay, an empty one is English."""
    clean = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    return F.coalesce(literal_map(LANGUAGES)[clean], F.nullif(clean, F.lit("")), F.lit("en"))


def normalise_layout_label(label: Column) -> Column:
    return F.coalesce(literal_map(LAYOUT_LABELS)[F.coalesce(label, F.lit("text"))], F.lit("other"))


def normalise_bbox(numbers: Column) -> Column:
    """Four numbers are rounded half to even, an 8-number polygon becomes its bounding box, anything else is null."""
    def whole(x: Column) -> Column:
        return F.bround(x, 0).cast("int")

    xs = F.filter(numbers, lambda _, i: i % 2 == 0)
    ys = F.filter(numbers, lambda _, i: i % 2 == 1)
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when(F.size(numbers) == 4, F.transform(numbers, whole)).when(
        F.size(numbers) == 8, F.transform(box, whole)
    )


def visual_kind(filename: Column) -> Column:
    """``image``, ``pdf`` or ``other`` from the extension."""
    ext = extension(filename)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*PDF_EXTENSIONS), "pdf").otherwise("other")


def is_visual(filename: Column) -> Column:
    return extension(filename).isin(*IMAGE_EXTENSIONS, *PDF_EXTENSIONS)


def recent_documents(docs: DataFrame, k: int = 10) -> DataFrame:
    return docs.orderBy(F.desc("datetime"), F.desc("doc_id")).limit(k)


def metrics_history(metrics: DataFrame, limit: int = 20) -> DataFrame:
    """Newest batches, rounded for display."""
    return metrics.orderBy(F.desc("datetime")).limit(limit).select(
        F.col("datetime").alias("date"), F.col("ok_docs").alias("ok"), F.col("failed_docs").alias("failed"),
        F.round("avg_time", 2).alias("avg_time"), F.round("reliability_pct", 1).alias("reliability"),
    )


def recent_logs(logs: DataFrame, limit: int = 100) -> DataFrame:
    return logs.orderBy(F.desc("datetime"), F.desc("log_id")).limit(limit).select("datetime", "event", "detail", "level")


def version_history(versions: DataFrame, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """Versions of the documents named (or all), newest first."""
    if doc_ids is not None:
        versions = versions.filter(F.col("doc_id").isin(*doc_ids))
    return versions.select("doc_id", "version_number", "created_at", "created_by", "change_reason").orderBy(
        "doc_id", F.desc("version_number")
    )
