"""Shards that all have the mixture of the whole: proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; a row's place is its fractional rank
(rank - phase) / (rows of the source); rows are sorted by it and cut into shards of equal counts. The phase is between 0
and 1 and drawn by hash for each source, so sources of one size do not all step at the same places. With k sources, a
shard of s of N rows holds of a source of n rows n s / N, give or take less than 2 + k n / N.

No source and no table is ranked in one task. The hash is uniform, so its leading bits cut every source into equal
buckets; rows are counted per bucket, bucket counts are accumulated, and a row needs only its rank in its own bucket.
The same is done once more for the global order, whose buckets are equal slices of the fractional rank.

Defined results: a null text has no bytes; a null source is a source of its own; repeated rows are rows like others;
fewer rows than shards leave shards empty; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import text_bytes
from sheafwork.session import cut_lineage

#: Rows that one bucket should hold; buckets, not sources, are what a task ranks.
ROWS_PER_BUCKET = 500


def _offsets(counts: DataFrame, keys: list[str], bucket: str, n: str, to: str) -> DataFrame:
    """Rows of the same keys in earlier buckets. There is one row per bucket, so a key's rows are few."""
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(to, F.coalesce(F.sum(n).over(earlier), F.lit(0)))


def interleave(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               seed: int = 17, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot); slots of a shard are gapless from 0.

    ``size`` is the text's UTF-8 bytes plus 8. The counts of any two shards differ by at most one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (text_bytes(F.col(text)) + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.crc32(body.cast("binary"))).alias("h"))
    rows = cut_lineage(rows)  # a few numbers per document; the texts are read once
    total = rows.count()
    buckets = max(1, -(-total // rows_per_bucket))
    # the hash as a fraction of its range, sliced; a source's rows fall evenly over the slices
    bucket = F.least(F.floor((F.shiftrightunsigned("h", 11) / float(1 << 53)) * buckets), F.lit(buckets - 1))
    cut = rows.withColumn("b", bucket.cast("int"))

    counts = cut.groupBy("source", "b").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("source").agg(F.sum("n").alias("of_source"))
    placed = _offsets(counts, ["source"], "b", "n", "before")
    placed = placed.alias("p").join(whole.alias("w"), F.col("p.source").eqNullSafe(F.col("w.source")))
    placed = placed.select(F.col("p.source").alias("s"), F.col("p.b").alias("pb"), "before", "of_source")

    order = [F.shiftrightunsigned("h", 11), F.col("h"), *[F.col(c) for c in ("doc_id", "size", "text_crc32")]]
    within = Window.partitionBy("source", "b").orderBy(*order)
    ranked = cut.withColumn("r", F.row_number().over(within))
    ranked = ranked.join(placed, ranked["source"].eqNullSafe(placed["s"]) & (ranked["b"] == placed["pb"]))
    phase = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 20)) / float(1 << 20)
    place = (F.col("before") + F.col("r") - phase) / F.col("of_source")
    ordered = ranked.select("doc_id", "source", "size", "text_crc32", "h", place.alias("place"),
                            F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("int").alias("g"))

    per_slice = ordered.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    starts = _offsets(per_slice, [], "g", "n", "start").select(F.col("g").alias("sg"), "start")
    inside = Window.partitionBy("g").orderBy("place", "source", *order[1:])
    at = ordered.withColumn("r", F.row_number().over(inside)).join(starts, F.col("g") == F.col("sg"))
    position: Column = F.col("start") + F.col("r") - 1
    # shard i holds the positions p with floor(p * shards / total) = i, in whole numbers
    sharded = at.withColumn("position", position)
    sharded = sharded.withColumn("shard", F.expr(f"cast((position * {shards}L) div {max(total, 1)}L as int)"))
    first = F.expr(f"(cast(shard as bigint) * {total}L + {shards - 1}L) div {shards}L")
    return sharded.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("position") - first).alias("slot"))
