"""Edits as transforms: the old state and the change come in, the new state goes out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.plans.prefix import row_numbers


def _filled(column: str) -> Column:
    """The value of a patch column, null when it is empty."""
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def apply_document_patch(docs: DataFrame, texts: DataFrame, patches: DataFrame
                         ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, texts, rejected patches) after a partial update; at most one patch per document.

    ``patches``: doc_id and nullable filename, type, status, tags, text, markdown, date, total, supplier. Empty strings
    leave filename, type and status alone; tags, text and markdown are replaced whenever given; date, total and supplier
    are merged into ``data`` (map<string,string>) of the text row. A patch whose date is not ISO is rejected whole.
    """
    parsed = F.try_to_date("date", "yyyy-MM-dd")
    dated = _filled("date").isNotNull()
    bad = dated & (parsed.isNull() | ~F.col("date").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"))
    rejected = patches.filter(bad)
    accepted = patches.filter(~bad)

    doc_patch = accepted.select(
        "doc_id", _filled("filename").alias("_filename"), _filled("type").alias("_type"),
        F.nullif("status", F.lit("")).alias("_status"), F.col("tags").alias("_tags"))
    new_docs = docs.join(doc_patch, "doc_id", "left").withColumns(
        {c: F.coalesce(f"_{c}", c) for c in ("filename", "type", "status", "tags")}
    ).select(docs.columns)

    def entry(key: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))

    entries = F.array_compact(F.array(
        entry("date", _filled("date")), entry("total", F.col("total")), entry("supplier", _filled("supplier"))))
    text_patch = accepted.select(
        F.col("doc_id").alias("id_doc"), F.col("text").alias("_text"), F.col("markdown").alias("_markdown"),
        entries.alias("_entries"))
    old = F.coalesce("data", F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
    kept = F.map_filter(old, lambda k, _: ~F.exists(F.coalesce("_entries", F.array().cast(
        "array<struct<key:string,value:string>>")), lambda e: e["key"] == k))
    merged = F.when(F.size("_entries") > 0, F.map_concat(kept, F.map_from_entries("_entries"))).otherwise(F.col("data"))
    new_texts = texts.join(text_patch, "id_doc", "left").withColumns({
        "text": F.coalesce("_text", "text"), "markdown_text": F.coalesce("_markdown", "markdown_text"), "data": merged,
    }).select(texts.columns)
    return new_docs, new_texts, rejected


def bulk_set(docs: DataFrame, ids: Iterable[int] | DataFrame, column: str, value: object) -> DataFrame:
    """Set one column (state, type, folder; None moves to the root) for the documents listed."""
    target = F.lit(value).cast(docs.schema[column].dataType)
    if isinstance(ids, DataFrame):
        marks = ids.select(F.col(ids.columns[0]).alias("doc_id")).distinct().withColumn("_hit", F.lit(True))
        marked = docs.join(marks, "doc_id", "left")
        return marked.withColumn(column, F.when(F.col("_hit"), target).otherwise(F.col(column))).select(docs.columns)
    return docs.withColumn(column, F.when(F.col("doc_id").isin(*ids), target).otherwise(F.col(column)))


def replace_fields(texts: DataFrame, fields: DataFrame) -> DataFrame:
    """Replace ``structured_data.fields`` where new fields are given; the rest of the struct stays.

    ``fields``: id_doc, fields (same struct type).
    """
    new = fields.select("id_doc", F.col("fields").alias("_fields"), F.lit(True).alias("_given"))
    replaced = F.struct(F.col("_fields").alias("fields"), F.col("structured_data.anomalies").alias("anomalies"))
    joined = texts.join(new, "id_doc", "left")
    return joined.withColumn(
        "structured_data", F.when(F.col("_given"), replaced).otherwise(F.col("structured_data"))).select(texts.columns)


def dismiss_anomaly(texts: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Remove one anomaly code per row of ``dismissals`` (id_doc, code); several codes per document are fine."""
    codes = dismissals.groupBy("id_doc").agg(F.collect_set("code").alias("_codes"))
    left = F.filter("anomalies", lambda a: ~F.array_contains(F.col("_codes"), a))
    joined = texts.join(codes, "id_doc", "left")
    return joined.withColumn(
        "anomalies", F.when(F.col("_codes").isNotNull(), left).otherwise(F.col("anomalies"))).select(texts.columns)


def delete_cascade(tables: Mapping[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove documents and every child row. ``tables``: name → (frame, its document id column)."""
    gone = ids.select(F.col(ids.columns[0]).alias("_gone"))
    return {name: df.join(gone, df[key] == gone["_gone"], "left_anti") for name, (df, key) in tables.items()}


def next_version(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Number new versions on from each document's highest, in ``order`` (a unique number per row)."""
    highest = existing.groupBy("doc_id").agg(F.max("version_number").alias("_highest"))
    numbered = row_numbers(new, ["doc_id"], [order], bucket_by=order, name="_n")
    version = F.coalesce("_highest", F.lit(0)) + F.col("_n")
    return numbered.join(highest, "doc_id", "left").withColumn("version_number", version.cast("bigint")).drop(
        "_n", "_highest")


def snapshot_version(detail: DataFrame, versions: DataFrame, ids: DataFrame, created_at: Column, reason: str,
                     user: str) -> DataFrame:
    """Versions with one more for each listed document: its current text, Markdown and structured data.

    One snapshot per document, so its number is the highest so far plus one.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias("doc_id")).distinct()
    highest = versions.groupBy("doc_id").agg(F.max("version_number").alias("_highest"))
    shots = detail.join(wanted, "doc_id", "left_semi").join(highest, "doc_id", "left").select(
        "doc_id", (F.coalesce("_highest", F.lit(0)) + 1).cast("bigint").alias("version_number"),
        F.col("text").alias("text_content"), F.col("markdown_text").alias("markdown_content"), "structured_data",
        created_at.alias("created_at"), F.lit(user).alias("created_by"), F.lit(reason).alias("change_reason"))
    return versions.unionByName(shots)


def restore_version(texts: DataFrame, versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Put the chosen versions' content back. ``chosen``: doc_id, version_number (one per document)."""
    back = versions.join(chosen, ["doc_id", "version_number"]).select(
        F.col("doc_id").alias("id_doc"), F.col("text_content").alias("_text"),
        F.col("markdown_content").alias("_markdown"), F.col("structured_data").alias("_data"),
        F.lit(True).alias("_given"))
    given = F.coalesce("_given", F.lit(False))
    return texts.join(back, "id_doc", "left").withColumns({
        "text": F.when(given, F.col("_text")).otherwise(F.col("text")),
        "markdown_text": F.when(given, F.col("_markdown")).otherwise(F.col("markdown_text")),
        "structured_data": F.when(given, F.col("_data")).otherwise(F.col("structured_data")),
    }).select(texts.columns)


def append_rows(table: DataFrame, rows: DataFrame, id_column: str, order: str) -> DataFrame:
    """Table plus rows, the new ones numbered from the highest id on in ``order`` (a unique number per row)."""
    highest = F.coalesce(table.select(F.max(id_column)).scalar(), F.lit(0))
    numbered = row_numbers(rows, [], [order], bucket_by=order, name=id_column)
    return table.unionByName(numbered.withColumn(id_column, (F.col(id_column) + highest).cast("bigint")).select(
        table.columns))


def ensure_columns(df: DataFrame, columns: Mapping[str, tuple[T.DataType, object]]) -> DataFrame:
    """Add the columns that are missing, with their default; those present stay untouched."""
    missing = {c: F.lit(default).cast(kind) for c, (kind, default) in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def last_per_key(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of every key; ranks above n are dropped before the shuffle as well as after."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")
