"""Joins between documents, texts, blocks, hits and vendors."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions.text import strip
from sheafwork.operators.listing import parse_json_array

MATCH_RATIO = 0.85
# Vendor names and their aliases.
VENDORS = {
    "Amazon": ["Amzn", "Amazon Mkt", "AWS"],
    "Leroy Merlin": ["Leroy", "L. Merlin", "LeroyMerlin"],
    "IKEA": ["Ikea", "IKEA Ibérica"],
}


def document_detail(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Every document with its recognised text, when there is one, and tags decoded."""
    detail = docs.join(texts.withColumnRenamed("id_doc", "doc_id"), "doc_id", "left")
    return detail.withColumn("tags", parse_json_array(F.col("tags")))


def recent_tables(docs: DataFrame, texts: DataFrame, k: int = 10) -> DataFrame:
    """Tables of the newest k documents that have any, one row per table with its index."""
    with_tables = docs.join(texts.filter(F.col("tables").isNotNull()).withColumnRenamed("id_doc", "doc_id"), "doc_id")
    newest = with_tables.orderBy(F.desc("datetime"), F.desc("doc_id")).limit(k)
    return newest.select("doc_id", "filename", "datetime", F.posexplode("tables").alias("index", "table")).select(
        "doc_id", "filename", "datetime", F.col("index").cast("bigint").alias("index"), "table"
    )


def indexable_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents that have text: what a rebuild of the index reads."""
    usable = texts.filter(F.col("text").isNotNull()).select(F.col("id_doc").alias("doc_id"), "text")
    return docs.select("doc_id", "filename").join(usable, "doc_id")


def ocr_coverage(docs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with text, documents without)."""
    ids = texts.select(F.col("id_doc").alias("doc_id"))
    return docs.join(ids, "doc_id", "left_semi"), docs.join(ids, "doc_id", "left_anti")


def select_by_ids(docs: DataFrame, ids: Iterable[int] | DataFrame) -> DataFrame:
    """Rows whose id is listed: a literal list becomes a pushed-down filter, a frame a semi join."""
    if isinstance(ids, DataFrame):
        return docs.join(ids.select(F.col(ids.columns[0]).alias("doc_id")), "doc_id", "left_semi")
    return docs.filter(F.col("doc_id").isin(*ids))


def enrich_hits(hits: DataFrame, docs: DataFrame, exclude_path: str | None = None) -> DataFrame:
    """Search hits with their document; hits on unknown paths are dropped, the score is kept."""
    if exclude_path is not None:
        hits = hits.filter(F.col("path") != exclude_path)
    found = hits.select("path", "score").join(docs, "path")
    return found.select("doc_id", "filename", "path", "score", parse_json_array(F.col("tags")).alias("tags"))


def merge_block_results(layout: DataFrame, results: DataFrame) -> DataFrame:
    """Layout blocks with their recognition result; blocks without one get empty text and confidence 0."""
    got = results.select("doc_id", "block_id", "text", "confidence")
    return layout.join(got, ["doc_id", "block_id"], "left").withColumns({
        "text": F.coalesce("text", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0)),
    })


def alias_table(vendors: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Lower-cased name or alias → canonical name; later entries replace earlier ones in place."""
    table: dict[str, str] = {}
    for canonical, aliases in vendors.items():
        for name in [canonical, *aliases]:
            table[name.lower()] = canonical
    return table


def match_vendor_fuzzy(name: Column, vendors: Mapping[str, Sequence[str]] = VENDORS) -> Column:
    """Canonical vendor: the exact alias, else the alias most alike (ratio above 0.85), else the name unchanged.

    The vendor table is configuration, so it travels as literals and nothing is shuffled: a name that fills a third of
    the rows costs one comparison per batch. Names that an edit-distance bound rules out never reach Python.
    """
    table = alias_table(vendors)
    if not table:
        return name
    lowered = F.lower(strip(name))
    exact = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[lowered]
    reachable = F.lit(False)
    for alias in table:
        total = F.length(lowered) + len(alias)
        reachable = reachable | (1 - F.levenshtein(lowered, F.lit(alias)) / total > MATCH_RATIO)

    @F.pandas_udf("string")
    def best(names: pd.Series) -> pd.Series:
        def pick(value: str | None) -> str | None:
            if value is None:
                return None
            ratio, found = 0.0, None
            for alias, canonical in table.items():
                score = SequenceMatcher(None, value, alias).ratio()
                if score > ratio:
                    ratio, found = score, canonical
            return found if ratio > MATCH_RATIO else None

        return names.map({value: pick(value) for value in names.dropna().unique()})

    return F.coalesce(exact, best(F.when(exact.isNull() & reachable, lowered)), name)


def vendor_tags(text: Column, vendors: Mapping[str, Sequence[str]] = VENDORS) -> Column:
    """One ``Vendor: X`` tag per vendor whose name or alias occurs in the text."""
    lowered = F.lower(text)
    tags = []
    for canonical, aliases in vendors.items():
        found = F.lit(False)
        for name in [canonical, *aliases]:
            found = found | lowered.contains(name.lower())
        tags.append(F.when(found, F.lit(f"Vendor: {canonical}")))
    return F.array_compact(F.array(*tags))


def exact_duplicates(docs: DataFrame, hash_column: str = "md5_hash", id_column: str = "doc_id") -> DataFrame:
    """Rows whose content was stored before, with the first id that has it.

    The first id per hash is a partial-aggregated minimum. Only hashes that repeat take part in the join, and a hash
    with very many copies stays on the streamed side, where a skewed partition can be split.
    """
    first = docs.groupBy(hash_column).agg(F.min(id_column).alias("first_id"), F.count("*").alias("_copies"))
    repeated = first.filter(F.col("_copies") > 1).drop("_copies")
    return docs.join(repeated, hash_column).filter(F.col(id_column) != F.col("first_id"))
