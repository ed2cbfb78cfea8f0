"""Exact nearest neighbours by pivots: a question meets only the cells that can hold one of its neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.plans.blockwise import matrix, similarities, top_k
from sheafwork.session import cut_lineage

#: Pivots at most (their vectors, and one radius and one count each, go to every task), and rows of a cell that meet in one task.
MOST_PIVOTS, ROWS_AT_ONCE = 2048, 8192
#: Bounds are computed in other orders than scores; they have this much room.
SLACK = 1e-6
SLICE = 1024


class Cells(NamedTuple):
    """A corpus cut into the Voronoi cells of its pivots: stored rows (cell, part, id, vec), and each cell's radius and count."""

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray


def _to_pivots(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def _named(frame: DataFrame) -> DataFrame:
    given = frame.select(F.col(frame.columns[0]).alias("id"), F.col(frame.columns[1]).alias("vec"))
    return given.filter("id is not null and vec is not null")


def build_cells(corpus: DataFrame, pivots: int | None = None, rows_at_once: int = ROWS_AT_ONCE) -> Cells:
    """Cells of (id, vector) rows. Pivots are the vectors of the least hashed ids, about the square root of their number.

    One pass assigns every vector to its nearest pivot; nothing is compared with anything but pivots. The stored rows are
    spread over parts by a hash of the id, so a cell of many copies is many parts.
    """
    corpus = _named(corpus)
    total = corpus.count()
    wanted = pivots or max(1, min(MOST_PIVOTS, math.isqrt(total)))
    chosen = corpus.dropDuplicates(["vec"]).orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    centres = np.array([r["vec"] for r in chosen], dtype="float64") if chosen else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(batch.num_rows, -1)
            cell, gap = [], []
            for first in range(0, len(rows), SLICE):
                apart = _to_pivots(rows[first:first + SLICE], centres)
                nearest = apart.argmin(axis=1)
                cell.append(nearest)
                gap.append(apart[np.arange(len(nearest)), nearest])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(cell), pa.int32()),
                                              pa.array(np.concatenate(gap))], names=["id", "vec", "cell", "gap"])

    kind = corpus.schema["vec"].dataType.simpleString()
    placed = cut_lineage(corpus.mapInArrow(assign, f"id bigint, vec {kind}, cell int, gap double"))
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for r in placed.groupBy("cell").agg(F.max("gap").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], count[r["cell"]] = r["r"], r["n"]
    parts = np.maximum(1, -(-count // rows_at_once)).tolist()
    most = F.element_at(F.lit(parts), F.col("cell") + 1)
    rows = placed.select("cell", F.pmod(F.xxhash64("id"), most).cast("int").alias("part"), "id", "vec")
    return Cells(rows, centres, radius, count)


def knn_cells(questions: DataFrame, cells: Cells, k: int = 5, counts: dict[str, int] | None = None,
              rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """(query_id, rank, id, score): the k stored vectors at the smallest Euclidean distance, as an exact search gives them.

    A question first meets its nearest cells, as many as hold k vectors. The k-th distance found is a bound: a cell
    whose pivot is farther away than its radius and the bound together, or farther than the nearest pivot by more than twice the
    bound, holds nothing nearer and is passed over. ``counts`` is filled with the numbers of (question, cell) pairs and of
    those that met.
    """
    pivots, radius, held = cells.pivots, cells.radius, cells.count
    parts = np.maximum(1, -(-held // rows_at_once))
    questions = cut_lineage(_named(questions))
    kind = questions.schema["vec"].dataType.simpleString()
    if not held.any():
        return questions.select(F.col("id").alias("query_id"), F.lit(0).cast("bigint").alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)

    def with_cells(frame: DataFrame, first: bool) -> DataFrame:
        """Questions with the cells they meet; ``bound`` is their k-th distance so far."""
        def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    rows = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(part.num_rows, -1)
                    apart = _to_pivots(rows, pivots)
                    order = np.argsort(apart, axis=1, kind="stable")
                    before = np.cumsum(held[order], axis=1) - held[order]
                    early = np.zeros_like(apart, dtype=bool)
                    np.put_along_axis(early, order, before < k, axis=1)
                    early &= held[None, :] > 0
                    if first:
                        meets = early
                    else:
                        bound = part.column(2).to_numpy(zero_copy_only=False)[:, None] + SLACK
                        near = np.maximum(apart - radius[None, :], (apart - apart.min(axis=1, keepdims=True)) / 2)
                        meets = ~early & (held[None, :] > 0) & ((near <= bound) | np.isnan(bound))
                    i, c = np.nonzero(meets)
                    i, c, n = np.repeat(i, parts[c]), np.repeat(c, parts[c]), parts[c]
                    p = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(c, pa.int32()),
                                                      pa.array(p, pa.int32())], names=["id", "vec", "cell", "part"])

        return frame.mapInArrow(body, f"id bigint, vec {kind}, cell int, part int")

    def body(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.array([], "int64"), "id": pd.array([], "int64"), "score": pd.array([], "float64")})]
        if len(asked) and len(stored):
            ids, rows = stored["id"].to_numpy(), matrix(stored["vec"])
            for first in range(0, len(asked), SLICE):
                some = asked.iloc[first:first + SLICE]
                for query, scores in zip(some["id"], similarities(matrix(some["vec"]), rows, "l2")):
                    got, best = top_k(ids, scores, k, False)
                    out.append(pd.DataFrame({"query_id": query, "id": got, "score": best}))
        return pd.concat(out)

    def met(asked: DataFrame) -> DataFrame:
        rows = cells.rows.select(*[F.col(c).alias(c) for c in ("id", "vec", "cell", "part")])
        return asked.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInPandas(
            body, "query_id bigint, id bigint, score double")

    best = Window.partitionBy("query_id").orderBy("score", "id")
    early = cut_lineage(met(with_cells(questions, True)).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k))
    bounds = early.filter(F.col("r") == k).select("query_id", F.col("score").alias("bound"))
    known = questions.join(bounds, questions["id"] == bounds["query_id"], "left").select("id", "vec", "bound")
    later = cut_lineage(with_cells(known, False))
    if counts is not None:
        counts["pairs"] = questions.count() * int((held > 0).sum())
        counts["met"] = with_cells(questions, True).select("id", "cell").distinct().count() + later.select("id", "cell").distinct().count()
    found = early.drop("r").union(met(later)).withColumn("rank", F.row_number().over(best).cast("bigint"))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
