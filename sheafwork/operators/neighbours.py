"""Nearest neighbours, zero-shot labels, near copies and embedding upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sheafwork.plans.blockwise import blocks_for, dense, first_near, matrix, meet, nearest, unit
from sheafwork.plans.sizing import block_count, rows_if_small
from sheafwork.session import cut_lineage

#: Queries that travel to the corpus; beyond them, queries of a block.
QUERIES_AT_ONCE, QUERIES_IN_BLOCK = 1024, 16_384
LABEL_SCALE = 100.0
LABEL_MINIMUM = 0.05
NEAR = 0.985
Encoder = Callable[[list[str]], np.ndarray]


def _best(candidates: DataFrame, k: int, largest: bool) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if largest else F.asc("score"), "id")
    ranked = candidates.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    largest = metric == "ip"
    queries, corpus = (side.select(F.col(side.columns[0]).cast("bigint").alias("id"), F.col(side.columns[1]).alias("vec")).filter(
        "vec is not null") for side in (queries, corpus))
    schema, names = "query_id bigint, id bigint, score double", ["query_id", "id", "score"]

    def met(asked: pa.Array, wanted: np.ndarray, stored: pa.Table) -> pa.Table:
        """The k best of the stored rows for every query."""
        stored = stored.sort_by("id")
        ids, rows = stored["id"].combine_chunks(), dense(stored["vec"])
        found = [pa.table([asked.take(pa.array(query)), ids.take(pa.array(row)), pa.array(score)], names=names)
                 for query, row, score in nearest(wanted, rows, k, metric)]
        return pa.concat_tables(found)

    few = rows_if_small(queries, QUERIES_AT_ONCE)
    if few is not None:
        if not few:
            return corpus.select(F.lit(0).cast("bigint").alias("query_id"), F.lit(0).cast("bigint").alias("rank"), "id",
                                 F.lit(0.0).alias("score")).limit(0)
        asked, wanted = pa.array([r["id"] for r in few], pa.int64()), np.array([r["vec"] for r in few], dtype="float64")
        places = pa.array(np.arange(len(few)))
        order = [("query_id", "ascending"), ("score", "descending" if largest else "ascending"), ("id", "ascending")]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: pa.Table | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                found = met(places, wanted, pa.Table.from_batches([batch]))
                held = (found if held is None else pa.concat_tables([held, found])).sort_by(order)
                own = np.bincount(held["query_id"].to_numpy(), minlength=len(wanted))
                turn = np.arange(len(held)) - np.repeat(np.cumsum(own) - own, own)
                held = held.filter(pa.array(turn < k))
            if held is not None:
                named = held.set_column(0, "query_id", asked.take(held["query_id"].combine_chunks()))
                yield from named.combine_chunks().to_batches()

        return _best(corpus.mapInArrow(scan, schema), k, largest)

    def body(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not len(asked) or not len(stored):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        return met(asked["id"].combine_chunks(), dense(asked["vec"]), stored)

    query_blocks = block_count(queries, QUERIES_IN_BLOCK)
    return _best(meet(queries, corpus, query_blocks, blocks_for(corpus, others=query_blocks), body, schema), k, largest)


def knn_l2(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): the k stored vectors at the smallest Euclidean distance.

    Both frames are (id, vector). Up to 1024 queries travel to the corpus, which is read once and not shuffled: every
    task keeps its own k best. More queries than that meet the corpus block by block.
    """
    return _knn(queries, corpus, k, "l2")


def knn_inner_product(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """The k stored vectors with the largest inner product; a corpus smaller than k gives all of it."""
    return _knn(queries, corpus, k, "ip")


def similar_documents(stored: DataFrame, ids: Sequence[int] | DataFrame, k: int = 10) -> DataFrame:
    """Neighbours of stored items among the k nearest, each item itself left out, score to four places."""
    if isinstance(ids, DataFrame):
        asked = stored.join(ids.select(F.col(ids.columns[0]).alias(stored.columns[0])), stored.columns[0], "left_semi")
    else:
        asked = stored.filter(F.col(stored.columns[0]).isin(*ids))
    near = knn_inner_product(asked, stored, k)
    return near.filter("id <> query_id").withColumn("score", F.round("score", 4))


def zero_shot_labels(vector: Column, labels: Mapping[str, Sequence[float]], minimum: float = LABEL_MINIMUM) -> Column:
    """Array of struct(label, score), best first: softmax of 100 × cosine over the candidate labels, above 0.05.

    The candidates are configuration, a short list, and travel with the function.
    """
    names = list(labels)
    known = unit(np.array([labels[n] for n in names], dtype="float64"))

    @F.pandas_udf(ArrayType(DoubleType()))
    def softmax(vectors: pd.Series) -> pd.Series:
        present = vectors[vectors.notna()]
        if present.empty:
            return pd.Series([None] * len(vectors), index=vectors.index)
        logits = LABEL_SCALE * np.round(unit(matrix(present)) @ known.T, 9)
        weights = np.exp(logits - logits.max(axis=1, keepdims=True))
        scores = weights / weights.sum(axis=1, keepdims=True)
        return pd.Series(list(scores), index=present.index).reindex(vectors.index)

    rated = F.zip_with(softmax(vector), F.array(*[F.lit(n) for n in names]), lambda s, n: F.struct(
        (-s).alias("rank"), n.alias("label")))
    kept = F.filter(F.array_sort(rated), lambda x: -x["rank"] > minimum)
    return F.transform(kept, lambda x: F.struct(x["label"].alias("label"), (-x["rank"]).alias("score")))


def _vectors(frame: DataFrame) -> DataFrame:
    """(id, vec) of the rows that have both: a missing vector is near nothing."""
    return frame.select(F.col(frame.columns[0]).alias("id"), F.col(frame.columns[1]).alias("vec")).filter(
        "id is not null and vec is not null")


def _representatives(vectors: DataFrame) -> DataFrame:
    """One row per distinct vector: the smallest id that has it. Combines on the map side whatever the copy count."""
    return vectors.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")


def _with_representative(vectors: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id, rep): every id with the smallest id of its vector; a vector of many copies is split by the skew join."""
    reps = distinct.select(F.col("id").alias("rep"), "vec")
    return vectors.join(reps, "vec").select("id", "rep")


def near_duplicate_pairs(vectors: DataFrame, threshold: float = NEAR) -> DataFrame:
    """(id, first_id): every item that has an earlier near copy, with the first such item.

    Identical vectors are folded into one before anything is compared, and the comparison returns one partner per row,
    so a group of copies costs rows and not pairs.
    """
    vectors = _vectors(vectors)
    distinct = cut_lineage(_representatives(vectors))
    near = first_near(distinct, distinct, threshold, below=True).select(F.col("id").alias("rep"), "first_id")
    placed = _with_representative(vectors, distinct).join(near, "rep", "left")
    first = F.least("rep", F.coalesce("first_id", "rep"))
    return placed.select("id", first.alias("first_id")).filter("first_id < id")


def near_duplicate_groups(vectors: DataFrame, threshold: float = NEAR) -> DataFrame:
    """(primary_id, duplicate_id): the groups a scan in id order finds, one row per duplicate.

    An item is primary unless an earlier primary is near it; a duplicate belongs to its first near primary. Items with
    no near copy settle at once and drop out. The others are settled in rounds: those without a smaller unsettled
    neighbour are primaries, and what is near a new primary is a duplicate. The smallest unsettled item settles in
    every round, so the rounds end; each is checkpointed in the shared folder.
    """
    vectors = _vectors(vectors)
    distinct = cut_lineage(_representatives(vectors))
    paired = first_near(distinct, distinct, threshold).select("id")
    active = cut_lineage(distinct.join(paired, "id", "left_semi"))
    primaries, open_items = active.limit(0), active
    while not open_items.isEmpty():
        blocked = first_near(open_items, open_items, threshold, below=True).select("id")
        new = cut_lineage(open_items.join(blocked, "id", "left_anti"))
        primaries = cut_lineage(primaries.unionByName(new))
        rest = open_items.join(new.select("id"), "id", "left_anti")
        taken = first_near(rest, new, threshold).select("id")
        open_items = cut_lineage(rest.join(taken, "id", "left_anti"))
    followers = active.join(primaries.select("id"), "id", "left_anti")
    owner = first_near(followers, primaries, threshold).select(F.col("id").alias("rep"), F.col("first_id").alias("own"))
    placed = _with_representative(vectors, distinct).join(owner, "rep", "left")
    return placed.select(F.coalesce("own", "rep").alias("primary_id"), F.col("id").alias("duplicate_id")).filter(
        "primary_id <> duplicate_id")


def embed(texts: DataFrame, encoder: Encoder, column: str = "text", batch: int = 256) -> DataFrame:
    """Add ``embedding`` from a user's encoder, called on batches inside the tasks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                yield part.assign(embedding=list(np.asarray(encoder(list(part[column])), dtype="float32")))

    return texts.mapInPandas(run, schema)


def incremental_embeddings(items: DataFrame, cache: DataFrame, encoder: Encoder) -> DataFrame:
    """(path, mtime, embedding) of all items; only those missing from the cache, or newer than it, are encoded.

    ``items``: path, mtime, text. ``cache``: path, mtime, embedding.
    """
    stored = cache.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), "embedding")
    fresh = (F.col("path") == F.col("_path")) & (F.col("_mtime") >= F.col("mtime"))
    stale = items.join(stored, fresh, "left_anti")
    valid = items.join(stored, fresh).select("path", F.col("_mtime").alias("mtime"), "embedding")
    return valid.unionByName(embed(stale, encoder).select("path", "mtime", "embedding"))


def rebuild_index(docs: DataFrame, texts: DataFrame, encoder: Encoder) -> DataFrame:
    """All chunks of all documents with text, embedded anew."""
    from sheafwork.operators.linking import indexable_texts
    from sheafwork.operators.search import chunk_text

    return embed(chunk_text(indexable_texts(docs, texts)), encoder, "chunk")
