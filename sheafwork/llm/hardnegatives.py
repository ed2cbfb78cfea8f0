"""Hard negatives by Kronecker-packed products: several candidates' scores from one multiplication.

Vectors become whole numbers, and a row's score for an anchor is their inner product. The components of several
candidates are put into separated fields of one wide integer, with a bias that keeps the fields from borrowing of each
other; every anchor component multiplies the packed component once, and the fields of the sum are the exact scores.

A field is as wide as the largest possible score of a meeting, |anchor| |candidate| by Cauchy and Schwarz, asks for. While the
whole sum stays under 2^53 the wide integer is carried by a double, whose products and sums are then exact in any order;
beyond that, it is a Python integer of eight fields.

Rows are cut into blocks by a hash of their id and meet the anchors, a stated set, block by block: once for the
positives of an anchor's own label, once for the negatives between the bounds that each positive sets. A meeting gives a
few rows for each anchor or positive; the best of them are taken over all blocks. A label or a vector that many rows share
is spread over all blocks.

Defined results: rows with a null id, a null label, a null vector or a component that is null or not finite (also once
scaled) take no part. An id names a row: of several rows with one id, that of the least label and vector takes part, so
repeated rows count once. Vectors of different lengths have no score together. An anchor without positives, or a positive without
negatives, gives no row; no rows, no result. A score that does not fit a long is none. Other columns are not
looked at. Memory: a task holds one block of rows and one of anchors, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.session import cut_lineage

#: Rows and anchors of a block at most, and rows at least; between them, as many blocks of rows as BLOCKS.
ROWS_PER_BLOCK, LEAST_ROWS, BLOCKS, ANCHORS_PER_BLOCK = 4096, 256, 64, 2048
#: Anchors multiplied at a time.
SLICE = 128
#: Fields of a Python integer.
WIDE_FIELDS = 8
_LONG = 1 << 63


def field_layout(reach: int, exact_bits: int = 53) -> tuple[int, int]:
    """(width, fields): fields of scores between -reach and reach that one integer under 2^exact_bits holds.

    The fields below the top one are biased by ``reach``; the top one keeps its sign. 0 fields: not even one fits.
    """
    width, fields = (2 * reach).bit_length(), 0
    while (reach << width * fields) + sum(2 * reach << width * j for j in range(fields)) < 1 << exact_bits:
        fields += 1
    return width, fields


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, int]:
    """Exact inner products of all rows of two arrays of whole numbers held as doubles, and a bound on their size."""
    n, size = candidates.shape
    longest = [max(1.0, float((m * m).sum(axis=1).max(initial=0.0))) for m in (anchors, candidates)]
    bound = longest[0] * longest[1]
    if bound < 2.0**98:
        reach = int(math.sqrt(bound)) + 2
        width, fields = field_layout(reach)
        kind: type = np.float64
    else:
        anchors, candidates = (np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
                               for m in (anchors, candidates))
        squares = [max([1, *(sum(x * x for x in row) for row in m.tolist())]) for m in (anchors, candidates)]
        reach = math.isqrt(squares[0] * squares[1]) + 1
        width, fields, kind = (2 * reach).bit_length(), WIDE_FIELDS, object
    words = -(-n // fields)
    room = np.zeros((words * fields, size), dtype=kind)
    room[:n] = candidates
    # one component more holds the bias of every field but the top one; it meets an anchor component of 1
    packed = np.zeros((words, size + 1), dtype=kind)
    for j in range(fields):
        packed[:, :size] += room[j::fields] * kind(1 << width * j) if kind is np.float64 else room[j::fields] * (1 << width * j)
        if j < fields - 1:
            packed[:, size] += reach << width * j
    ones = np.ones((len(anchors), 1), dtype=kind)
    sums = np.hstack((anchors, ones)) @ packed.T
    if kind is np.float64:
        sums = sums.astype(np.int64)
    scores = np.empty((len(anchors), words * fields), dtype=sums.dtype)
    for j in range(fields - 1):
        scores[:, j::fields] = ((sums >> width * j) & ((1 << width) - 1)) - reach
    scores[:, fields - 1::fields] = sums >> width * (fields - 1)
    return scores[:, :n], reach


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest keys of every row, in no order; keys of a row differ or are negative."""
    k = min(k, keys.shape[1])
    if keys.dtype == object:
        return np.argsort(-keys, axis=1, kind="stable")[:, :k]
    return np.argpartition(keys, keys.shape[1] - k, axis=1)[:, keys.shape[1] - k:]


def _matrices(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(vector length, rows in the order of their ids, their vectors) of a meeting's table, one vector length at a time."""
    vectors = table["vec"].combine_chunks()
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    lengths = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    ids = table["id"].to_numpy()
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        at = at[np.argsort(ids[at], kind="stable")]
        yield size, at, flat[starts[at][:, None] + np.arange(size)] if size else np.empty((len(at), 0))


def _meetings(rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(anchor places, row places by id, scores, reach) of every slice of anchors with the rows of their vector length."""
    if not rows.num_rows or not anchors.num_rows:
        return
    asked = {size: (at, matrix) for size, at, matrix in _matrices(anchors)}
    for size, at, matrix in _matrices(rows):
        if size in asked:
            whose, theirs = asked[size]
            for first in range(0, len(whose), SLICE):
                scores, reach = packed_products(theirs[first:first + SLICE], matrix)
                yield whose[first:first + SLICE], at, scores, reach


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64), pa.int64())


def _keys(scores: np.ndarray, reach: int) -> np.ndarray:
    """Distinct non-negative keys: the higher score first, then the smaller place; -1 where a score does not fit a long."""
    n = scores.shape[1]
    keys = (scores + reach) * n + np.arange(n - 1, -1, -1)
    return keys if reach < _LONG else np.where((scores >= -_LONG) & (scores < _LONG), keys, -1)


_POSITIVES = "anchor_id bigint, id bigint, score bigint"
_NEGATIVES = "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])


def _nearest_alike(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best rows of a block for each anchor among those of its label."""
    def body(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        schema, out = _arrow(_POSITIVES), []
        row_ids, row_labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        ids, labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        for label in np.unique(labels):
            mine, theirs = anchors.filter(pa.array(labels == label)), rows.filter(pa.array(row_labels == label))
            own, near = ids[labels == label], row_ids[row_labels == label]
            for whose, at, scores, reach in _meetings(theirs, mine):
                keys = _keys(scores, reach)
                keys[own[whose][:, None] == near[at][None, :]] = -1
                best = _best(keys, k)
                chosen = np.take_along_axis(keys, best, axis=1)
                i, j = np.nonzero(chosen >= 0)
                place = best[i, j]
                out.append(pa.Table.from_arrays([pa.array(own[whose][i]), pa.array(near[at][place]), _longs(scores[i, place])],
                                                schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return body


def _nearest_unlike(k: int, least: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best rows of a block for each positive among those of another label and between its bounds."""
    def body(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        schema, out = _arrow(_NEGATIVES), []
        row_ids, row_labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        ids, labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        positives = anchors["positives"].to_pylist()
        for whose, at, scores, reach in _meetings(rows, anchors):
            keys = _keys(scores, reach)
            keys[labels[whose][:, None] == row_labels[at][None, :]] = -1
            hundred = scores * 100
            for p in range(max(len(x) for x in positives)):
                has = np.flatnonzero([len(positives[w]) > p for w in whose.tolist()])
                if not len(has):
                    continue
                found = [positives[w][p] for w in whose[has].tolist()]
                score = np.array([f["score"] for f in found], dtype=scores.dtype)[:, None]
                fits = (score * least <= hundred[has]) & (hundred[has] <= score * most)
                masked = np.where(fits, keys[has], -1)
                best = _best(masked, k)
                i, j = np.nonzero(np.take_along_axis(masked, best, axis=1) >= 0)
                place = best[i, j]
                out.append(pa.Table.from_arrays([
                    pa.array(ids[whose[has]][i]), pa.array(np.array([f["id"] for f in found], dtype=np.int64)[i]),
                    _longs(score[:, 0][i]), pa.array(row_ids[at][place]), _longs(scores[has][i, place])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return body


def _meet(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int,
          body: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``body`` on every block of rows with every block of anchors."""
    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    r = rows.select(*[F.col(c).alias(c) for c in rows.columns], block(row_blocks).alias("rb"), copies(anchor_blocks).alias("ab"))
    a = anchors.select(*[F.col(c).alias(c) for c in anchors.columns], block(anchor_blocks).alias("ab"),
                       copies(row_blocks).alias("rb"))
    return r.groupBy("rb", "ab").cogroup(a.groupBy("rb", "ab")).applyInArrow(body, schema)


def taking_part(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, vec) of the rows that take part, components scaled; a meeting takes their floors."""
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(float(scale)))
    sound = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    given = rows.select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), scaled.alias("vec"))
    given = given.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & sound)
    first = given.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"))
    return first.select("id", "r.label", "r.vec")


def hard_negatives(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding",
                   label: Column | str = "label", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
                   scale: int = 256, rows_per_block: int = ROWS_PER_BLOCK,
                   anchors_per_block: int = ANCHORS_PER_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the column ``id``, the row's id as a long. An anchor's positives are its best other
    rows of its label; each of them gets the best rows of other labels whose score is at least ``least`` and at most
    ``most`` hundredths of its own.
    """
    label = F.col(label) if isinstance(label, str) else label
    stored = cut_lineage(taking_part(rows, vec_id, vector, label, scale))
    asked = stored.filter(anchors)
    total, questions = stored.count(), asked.count()
    size = max(LEAST_ROWS, min(rows_per_block, -(-total // BLOCKS)))
    row_blocks, anchor_blocks = max(1, -(-total // size)), max(1, -(-questions // anchors_per_block))

    alike = _meet(stored, asked, row_blocks, anchor_blocks, _nearest_alike(positives), _POSITIVES)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = alike.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives)
    chosen = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("positives"))
    ready = asked.join(chosen, asked["id"] == chosen["anchor_id"]).select("id", "label", "vec", "positives")

    unlike = _meet(stored, ready, row_blocks, anchor_blocks, _nearest_unlike(negatives, least, most), _NEGATIVES)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    ranked = unlike.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                         F.col("score").alias("negative_score"))
