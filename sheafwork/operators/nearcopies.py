"""Near copies of vectors without comparing all of them: a random-projection index, and groups on a stored graph."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.plans.blockwise import blocks_for, dense, earliest_near, meet, unit
from sheafwork.plans.graph import scan_groups
from sheafwork.session import cut_lineage

NEAR = 0.985
#: Tables of the index, bits that choose a bucket besides log2(rows), and neighbouring buckets that a row asks in each.
TABLES, PROBES = 8, 2
#: Rows a bucket should hold; more bits are used beyond MOST_IN_BUCKET, and pivots where even those do not split it.
IN_BUCKET, MOST_IN_BUCKET = 32, 2048
MORE_BITS, ALL_BITS, PIVOTS = 12, 60, 128
#: Earlier near copies that a row of the graph lists.
LISTED = 8
SLICE = 512


def _flat(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(vectors), -1)


def bucket_keys(vectors: DataFrame, bits: int, tables: int = TABLES, probes: int = PROBES, seed: int = 11) -> DataFrame:
    """(id, tab, code, rest, asks): for every table the row's bucket, and the neighbouring ones across its nearest planes.

    A code is the signs of ``bits`` random projections; ``rest`` has the signs of MORE_BITS further ones.
    """
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit(_flat(batch.column(1)))
            if planes is None or planes.shape[1] != rows.shape[1]:
                planes = np.random.RandomState(seed).randn(tables * (bits + MORE_BITS), rows.shape[1])
            side = (rows @ planes.T).reshape(len(rows), tables, bits + MORE_BITS)
            weights = 1 << np.arange(bits, dtype=np.int64)
            code = (side[:, :, :bits] > 0) @ weights
            rest = (side[:, :, bits:] > 0) @ (1 << np.arange(MORE_BITS, dtype=np.int64))
            nearest = np.argsort(np.abs(side[:, :, :bits]), axis=2)[:, :, :probes]
            asked = [code] + [code ^ weights[nearest[:, :, p]] for p in range(nearest.shape[2])]
            n = len(rows) * tables
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), tables)
            tab = np.tile(np.arange(tables, dtype=np.int32), len(rows))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(ids, len(asked))), pa.array(np.tile(tab, len(asked))),
                pa.array(np.concatenate([c.ravel() for c in asked])), pa.array(np.tile(rest.ravel(), len(asked))),
                pa.array(np.repeat(np.arange(len(asked)) > 0, n))], names=["id", "tab", "code", "rest", "asks"])

    return vectors.select("id", "vec").mapInArrow(body, "id bigint, tab int, code bigint, rest bigint, asks boolean")


def _meetings(vectors: DataFrame, rows: int) -> DataFrame:
    """(id, task, holds, asks): who meets in which bucket. A bucket has at most about MOST_IN_BUCKET rows and its pivots."""
    bits = max(2, min(ALL_BITS - MORE_BITS, math.ceil(math.log2(max(2, rows / IN_BUCKET)))))
    keys = cut_lineage(bucket_keys(vectors, bits))

    def hot(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_IN_BUCKET)

    first = hot(keys, ["tab", "code"]).select("tab", "code", F.lit(True).alias("hot"))
    split = keys.join(first, ["tab", "code"], "left").withColumn("sub", F.when(F.col("hot"), F.col("rest"))).drop("hot", "rest")
    split = split.withColumn("sub", F.coalesce("sub", F.lit(-1)))
    second = hot(split, ["tab", "code", "sub"]).withColumn("parts", F.ceil(F.col("n") / MOST_IN_BUCKET)).drop("n")
    placed = split.join(second, ["tab", "code", "sub"], "left").withColumn(
        "part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))))
    # rows that so many planes do not part are near each other: the earliest of them meet all
    crowd = placed.filter("parts is not null")
    pivots = crowd.filter("not asks").groupBy("tab", "code", "sub", "parts", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PIVOTS)).alias("p"))
    pivots = pivots.agg(F.min("id").alias("id")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    task = F.xxhash64("tab", "code", "sub", "part").alias("task")
    own = placed.select("id", task, (~F.col("asks")).alias("holds"))
    return own.union(pivots.select("id", task, F.lit(True))).groupBy("id", "task").agg(F.max("holds").alias("holds"))


def _earlier_near(threshold: float, k: int) -> Callable[[pa.Table], pa.Table]:
    """(id, near): up to k smallest earlier ids of a bucket whose cosine reaches the threshold."""
    def body(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("id")
        ids, holds = bucket["id"].to_numpy(), bucket["holds"].to_numpy(zero_copy_only=False)
        rows = unit(_flat(bucket["vec"].combine_chunks()))
        stored, kept = ids[holds], rows[holds]
        out_ids: list[np.ndarray] = []
        out: list[np.ndarray] = []
        for at in range(0, len(ids), SLICE):
            scores = np.round(rows[at:at + SLICE] @ kept.T, 9)
            near = (scores >= threshold) & (stored[None, :] < ids[at:at + SLICE, None])
            place = np.cumsum(near, axis=1)
            i, j = np.nonzero(near & (place <= k))
            out_ids.append(ids[at:at + SLICE][i])
            out.append(stored[j])
        schema = pa.schema([("id", pa.int64()), ("near", pa.int64())])
        found = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (out_ids, out)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], schema=schema)

    return body


def near_candidates(vectors: DataFrame, threshold: float = NEAR, k: int = 1) -> DataFrame:
    """(id, near): near earlier vectors that meet in a bucket of the index, up to k of every row and bucket.

    A row meets at most about MOST_IN_BUCKET + PIVOTS others in each of its TABLES * (1 + PROBES) buckets, however many rows there are.
    """
    meetings = _meetings(vectors, vectors.count())
    met = meetings.join(vectors.select("id", "vec"), "id").groupBy("task").applyInArrow(
        _earlier_near(threshold, k), "id bigint, near bigint")
    return met


def near_duplicate_pairs_fast(vectors: DataFrame, threshold: float = NEAR) -> DataFrame:
    """(id, first_id): every item for which the index finds an earlier near copy, with the first one found.

    Every row is a true near copy; some may be missed, or found with a later partner than the first. Identical
    vectors are folded first and never missed. Items without an id or a vector are near nothing.
    """
    vectors, distinct, placed = _folded(vectors)
    near = near_candidates(distinct, threshold).groupBy("id").agg(F.min("near").alias("first"))
    found = placed.join(near.withColumnRenamed("id", "rep"), "rep", "left")
    return found.select("id", F.least("rep", F.coalesce("first", "rep")).alias("first_id")).filter("first_id < id")


def _folded(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as (id, vec), one row per distinct vector under its smallest id, and (id, rep)."""
    vectors = vectors.select(F.col(vectors.columns[0]).alias("id"), F.col(vectors.columns[1]).alias("vec")).filter(
        "id is not null and vec is not null")
    distinct = cut_lineage(vectors.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"))
    return vectors, distinct, vectors.join(distinct.withColumnRenamed("id", "rep"), "vec").select("id", "rep")


def near_lists(left: DataFrame, right: DataFrame, threshold: float = NEAR, k: int = LISTED) -> DataFrame:
    """(id, near): the k smallest earlier near ids of every row of ``left``, exactly: all of ``right`` is compared.

    ``left`` has (id, vec, after); only ids above ``after`` count.
    """
    def body(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("id"), b.sort_by("id")
        ids, right_ids = a["id"].to_numpy(), b["id"].to_numpy()
        out = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
        if len(a) and len(b):
            near = earliest_near(ids, dense(a["vec"]), right_ids, dense(b["vec"]), threshold, k, True, a["after"].to_numpy())
            out += [(ids[i], right_ids[j]) for i, j, _ in near]
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=["id", "near"])

    asked = left.select(F.col("id").cast("bigint").alias("id"), "vec", F.col("after").cast("double").alias("after"))
    stored = right.select(F.col("id").cast("bigint").alias("id"), "vec")
    met = meet(asked, stored, blocks_for(left), blocks_for(right), body, "id bigint, near bigint")
    return met.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("near")), 1, k).alias("near"))


def near_duplicate_groups(vectors: DataFrame, threshold: float = NEAR, listed: int = LISTED) -> DataFrame:
    """(primary_id, duplicate_id): the groups a scan in id order finds, one row per duplicate.

    An item is primary unless an earlier primary is near it; a duplicate belongs to its first near primary. One pass over
    the vectors writes, for every item, its first ``listed`` earlier near ids; the groups are then settled on these stored edges
    (plans/graph.py). Only an item whose listed ids all turn out to be duplicates is compared again, with the ids behind its list.
    """
    _, distinct, placed = _folded(vectors)
    asked = distinct.withColumn("after", F.lit(float("-inf")))
    edges, unended, settled = None, None, None
    while True:
        lists = cut_lineage(near_lists(asked, distinct, threshold, listed))
        more = lists.select(F.col("id").alias("v"), F.explode("near").alias("u"))
        full = lists.filter(F.size("near") == listed).select(F.col("id").alias("v"), F.array_max("near").cast("double").alias("after"))
        edges = cut_lineage(more if edges is None else edges.union(more))
        unended = cut_lineage(full)
        settled, left = scan_groups(edges, unended)
        if left is None:
            break
        again = unended.join(left, "v")
        asked = distinct.join(again.withColumnRenamed("v", "id"), "id")
    found = placed.join(settled.select(F.col("id").alias("rep"), "owner"), "rep", "left")
    return found.select(F.coalesce("owner", "rep").alias("primary_id"), F.col("id").alias("duplicate_id")).filter(
        "primary_id <> duplicate_id")


def near_duplicate_groups_fast(vectors: DataFrame, threshold: float = NEAR, listed: int = LISTED) -> DataFrame:
    """The same groups on the edges that the index finds: the vectors are read once, in buckets, and never compared all with all."""
    _, distinct, placed = _folded(vectors)
    edges = cut_lineage(near_candidates(distinct, threshold, listed).select(F.col("id").alias("v"), F.col("near").alias("u")))
    settled, _ = scan_groups(edges)
    found = placed.join(settled.select(F.col("id").alias("rep"), "owner"), "rep", "left")
    return found.select(F.coalesce("owner", "rep").alias("primary_id"), F.col("id").alias("duplicate_id")).filter(
        "primary_id <> duplicate_id")
