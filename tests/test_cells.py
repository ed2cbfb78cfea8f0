"""Neighbours by pivots against the exact search."""

from __future__ import annotations

import numpy as np
import pytest

from sheafwork.operators import cells, neighbours
from test_neighbours import clustered, frame


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("k,pivots,at_once", [(5, None, 8192), (1, 3, 20), (40, 25, 8192)])
def test_neighbours_are_those_of_the_exact_search(spark, k, pivots, at_once):
    vectors = clustered(8, 400)
    built = cells.build_cells(frame(spark, vectors), pivots, at_once)
    asked = frame(spark, vectors[:60])
    assert ranked(cells.knn_cells(asked, built, k, rows_at_once=at_once)) == ranked(neighbours.knn_l2(asked, frame(spark, vectors), k))


def test_far_cells_are_passed_over(spark):
    rng = np.random.RandomState(9)
    centres = 10 * rng.randn(20, 8)
    vectors = (centres[rng.randint(0, 20, 1000)] + 0.1 * rng.randn(1000, 8)).astype("float32")
    built = cells.build_cells(frame(spark, vectors))
    counts: dict[str, int] = {}
    asked = frame(spark, vectors[::10])
    got = cells.knn_cells(asked, built, 3, counts)
    exact = neighbours.knn_l2(asked, frame(spark, vectors), 3)
    assert ranked(got) == ranked(exact)
    assert counts["met"] < counts["pairs"] / 3


def test_small_and_missing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [5.0, 5.0])], "id bigint, vec array<float>")
    built = cells.build_cells(df)
    assert ranked(cells.knn_cells(df.filter("id = 1"), built, 9)) == [(1, 1, 1, 0.0), (1, 2, 3, 0.0), (1, 3, 4, round(float(np.hypot(4, 5)), 6))]
    assert cells.knn_cells(df.filter("false"), built, 3).count() == 0
    assert cells.knn_cells(df, cells.build_cells(df.filter("false")), 3).count() == 0
