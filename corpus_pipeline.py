"""A training corpus from raw documents: quality, near copies, benchmark leaks, token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm import decontaminate, jaccard, pieces, quality
from sheafwork.llm.common import table
from sheafwork.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule, and do not fail a rule under which their host is condemned."""
    return quality.passing(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more, the smallest doc_id stays."""
    return jaccard.one_per_component(docs, percent=80, words=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_ids, ids): every text as ids that decode to it."""
    encoded, ids = pieces.with_ids(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", F.size(ids).cast("bigint").alias("n_ids"), F.col(ids).alias("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: None: decontamination and segmentation have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for index, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if index + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
