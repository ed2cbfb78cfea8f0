"""Importance resampling towards a target: array-scored weights, ranks by parallel sorting by regular sampling.

A text's features are its runs of one to ``longest`` words, hashed into buckets by crc32. Bucket counts of the corpus and
of the target give every bucket a gain, an array of ``buckets`` numbers, which is all that travels to the tasks; a text's weight is the
floored mean of its features' gains, and its score adds Gumbel noise from a hash of its id, so the highest scores are a
draw without replacement in proportion to exp(weight / 1000).

The scores are ranked without one large sort: every task writes its rows sorted, a local run; regular samples of the
runs, at every ``stride``-th place, give regular splitters; rows are exchanged by the segment between splitters in which
they fall and merged there; and the prefix sums of the segments' counts turn local ranks into exact ones. Segments
that lie behind the last drawn rank are counted but neither exchanged nor sorted.

Words: lower-cased A-Z, then runs of letters, digits and anything beyond ASCII. Defined results: a null or empty text has no
features, weight 0; a null id is hashed as the empty text, comes after all others in ties and stays null; rows that repeat
an id are rows like others, and ties beyond the id go by features and weight; an empty corpus gives no rows, an empty target
counts nothing. Other columns are not looked at. Very long texts are read in one piece with arrays of a few times their size; words
are never made into strings. The driver gets bucket counts, at most SAMPLES_PER_SEGMENT samples a segment and one more for
half the runs, and counts of at most MOST_SEGMENTS segments.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.words import Words, bytes_of
from sheafwork.session import cut_lineage

#: Rows a segment should hold, segments at most, and regular samples drawn for each.
ROWS_PER_SEGMENT, MOST_SEGMENTS, SAMPLES_PER_SEGMENT = 1000, 4096, 64
#: Bytes of text measured at a time; a longer text is measured alone.
SLICE_BYTES = 1 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 48
_LAST_ID = (1 << 63) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def crc_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of each range of bytes, going on from ``before``: one step of all ranges at a time, the longest last."""
    state = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32) if before is None else ~before.astype(np.uint32)
    order = np.argsort(lengths, kind="stable")
    by_length = lengths[order]
    usual = int(np.searchsorted(by_length, LONG_WORD, "right"))
    values, at = state[order], starts[order]
    for j in range(int(by_length[usual - 1]) if usual else 0):
        live = slice(int(np.searchsorted(by_length, j, "right")), usual)
        c = values[live]
        values[live] = _CRC[(c ^ data[at[live] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    for i in range(usual, len(order)):
        whole = data[at[i]:at[i] + by_length[i]].tobytes()
        values[i] = zlib.crc32(whole, int(values[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    state[order] = values
    return ~state


def words_in(texts: pa.Array) -> Words:
    """Words of a string array: lower-cased A-Z, runs of ASCII letters and digits and of all bytes beyond ASCII."""
    data, offsets = bytes_of(texts)
    data = _LOWER[data]
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([True], ~inside[:-1])) if len(data) else inside
    after = np.concatenate((~inside[1:], [True])) if len(data) else inside
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return Words(data, starts, ends - starts, np.empty(0, dtype=np.uint64), np.diff(np.searchsorted(starts, offsets)))


def feature_buckets(words: Words, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature: runs of one to ``longest`` words of a text, joined by one space."""
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    space = np.uint32(32)
    state = crc_of(words.data, words.starts, words.lengths)
    texts, found = [text], [state % np.uint32(buckets)]
    first = np.arange(len(text))
    for n in range(1, longest):
        if n >= len(text):
            break
        keep = text[first[:len(text) - n]] == text[n:]
        first, last = np.flatnonzero(keep), np.flatnonzero(keep) + n
        # ``state`` is that of the run one word shorter, by its first word
        c = ~state[first]
        c = _CRC[(c ^ space) & np.uint32(255)] ^ (c >> np.uint32(8))
        longer = crc_of(words.data, words.starts[last], words.lengths[last], ~c)
        state = np.zeros(len(text), dtype=np.uint32)
        state[first] = longer
        texts.append(text[first])
        found.append(longer % np.uint32(buckets))
        first = np.arange(len(text))
    return np.concatenate(texts), np.concatenate(found).astype(np.int64)


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Rows of a batch, about SLICE_BYTES of text at a time."""
    _, offsets = bytes_of(texts)
    first = 0
    while first < len(texts):
        to = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield slice(first, to)
        first = to


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends one row per bucket it has met."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            for rows in _slices(column):
                _, found = feature_buckets(words_in(column[rows]), longest, buckets)
                held += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(held[met], pa.int64())], names=["bucket", "n"])

    summed = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for r in summed.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale ln(p / q)) of every bucket, p its smoothed share of the target and q of the source."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, doc_id: str, text: str, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a text's features; 0 without features."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column(1), batch.num_rows
            numbers = np.zeros((3, n), dtype=np.int64)
            for rows in _slices(column):
                words = words_in(column[rows])
                whose, found = feature_buckets(words, longest, buckets)
                count = rows.stop - rows.start
                numbers[0, rows] = words.counts
                numbers[1, rows] = np.bincount(whose, minlength=count)
                by = np.argsort(whose, kind="stable") if longest > 1 else slice(None)
                ends = np.cumsum(numbers[1, rows])
                running = np.concatenate(([0], np.cumsum(gains[found[by]])))
                numbers[2, rows] = running[ends] - running[ends - numbers[1, rows]]
            numbers[2] //= np.maximum(numbers[1], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in numbers)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """floor(-scale ln(-ln u)), u from the first 32 bits of sha256(``seed:doc_id``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(u))).cast("bigint")


def _segments(rows: DataFrame, scores: np.ndarray, ids: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """``rows`` with ``segment``, how many splitters (score down, id up) are not behind the row, and ``before``, the
    rows of earlier segments."""
    tied, first = np.unique(-scores, return_index=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = -batch.column(batch.schema.get_field_index("score")).to_numpy(zero_copy_only=False)
            own = batch.column(batch.schema.get_field_index("doc_id")).fill_null(_LAST_ID).to_numpy(zero_copy_only=False)
            at = np.searchsorted(-scores, key, "left")
            for t in np.intersect1d(tied, key).tolist():
                low, high = np.searchsorted(-scores, t, "left"), np.searchsorted(-scores, t, "right")
                same = np.flatnonzero(key == t)
                at[same] = low + np.searchsorted(ids[low:high], own[same], "right")
            offset = np.zeros(len(at), dtype=np.int64) if before is None else before[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(offset, pa.int64())],
                                             names=[*batch.schema.names, "segment", "before"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(place, f"{schema}, segment int, before bigint")


def ranked(scored: DataFrame, eligible: Column, percent: int, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... over the eligible rows by falling score and rising doc_id, up to ``percent``
    hundredths of them; null for the others. ``scored`` has doc_id, n_features, weight, score and what ``eligible`` needs."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    runs = cut_lineage(scored.withColumn("fit", eligible).sortWithinPartitions(F.desc("fit"), *order))
    total = runs.filter("fit").count()
    draw = total * percent // 100
    segments = max(1, min(MOST_SEGMENTS, total // rows_per_segment))
    stride = max(1, total // (segments * SAMPLES_PER_SEGMENT))
    place = F.col("_metadata.row_index")
    sampled = runs.filter("fit").filter(place % stride == stride // 2).select(
        "score", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id")).toPandas().to_numpy(dtype=np.int64)
    sampled = sampled[np.lexsort((sampled[:, 1], -sampled[:, 0]))]
    cuts = sampled[[len(sampled) * i // segments for i in range(1, segments)] if len(sampled) else []]
    scores, ids = np.ascontiguousarray(cuts[:, 0]), np.ascontiguousarray(cuts[:, 1])

    rows = runs.filter("fit").drop("fit")
    sizes = np.zeros(segments, dtype=np.int64)
    for r in _segments(rows.select("doc_id", "score"), scores, ids).groupBy("segment").count().collect():
        sizes[r["segment"]] = r["count"]
    before = np.cumsum(sizes) - sizes

    placed = _segments(rows, scores, ids, before)
    local = F.row_number().over(Window.partitionBy("segment").orderBy(*order))
    head = placed.filter(F.col("before") < draw).withColumn("rank", F.col("before") + local)
    tail = placed.filter(F.col("before") >= draw).withColumn("rank", F.lit(None).cast("bigint"))
    out = head.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(tail).drop("segment", "before")
    rest = runs.filter(~F.col("fit")).drop("fit").withColumn("rank", F.lit(None).cast("bigint"))
    return out.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): all documents, those drawn with their rank."""
    gains = bucket_gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    scored = weighted(docs, gains, doc_id, text, longest)
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    drawn = ranked(scored, F.col("n_words") >= least_words, percent)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
