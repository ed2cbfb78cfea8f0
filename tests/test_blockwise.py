"""Meetings of vectors: exact results from tiles of scores, whatever the size of the blocks."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sheafwork.operators import nearcopies, neighbours
from sheafwork.plans import blockwise
from test_neighbours import clustered, frame


def peak_mb(work) -> float:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def met(monkeypatch, module, left: pa.Table, right: pa.Table, call) -> pa.Table:
    """What the body of one meeting returns for these blocks, without Spark."""
    bodies = []

    class Caught(Exception):
        pass

    def meet(*args):
        bodies.append(args[4])
        raise Caught

    monkeypatch.setattr(module, "meet", meet)
    with pytest.raises(Caught):
        call()
    return bodies[0](left, right)


@pytest.mark.parametrize("what", ["ip", "l2", "first", "lists"])
def test_a_meeting_holds_a_tile_of_scores(spark, monkeypatch, what):
    """2,000 rows against 30,000 are 480 MB of scores; a meeting of them takes a few tiles beside its rows."""
    rng = np.random.RandomState(1)
    vectors = rng.randn(30_000, 8).astype("float32")
    vectors[1_000:3_000] = vectors[0]  # a crowd, in which all are near all
    kind = pa.list_(pa.float32())
    right = pa.table({"id": np.arange(30_000), "vec": pa.array(list(vectors), kind)})
    left = right.slice(500, 2_000).append_column("after", pa.array(np.full(2_000, -np.inf)))
    few = frame(spark, vectors[:3]).selectExpr("id", "vec", "cast('-Infinity' as double) as after")
    calls = {"ip": (neighbours, lambda: neighbours.knn_inner_product(few, few, 10)), "l2": (neighbours, lambda: neighbours.knn_l2(few, few, 10)),
             "first": (blockwise, lambda: blockwise.first_near(few, few, 0.985)), "lists": (nearcopies, lambda: nearcopies.near_lists(few, few, 0.985, 8))}
    monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", 1)
    found = []
    assert peak_mb(lambda: found.append(met(monkeypatch, calls[what][0], left, right, calls[what][1]))) < 120
    whole = vectors.astype("float64")
    if what in ("ip", "l2"):
        assert len(found[0]) == 20_000
        for query in (600, 2_400):
            scores = whole @ whole[query] if what == "ip" else -np.linalg.norm(whole - whole[query], axis=1)
            want = np.lexsort((np.arange(30_000), -np.round(scores, 9)))[:10]
            rows = found[0].filter(pa.compute.equal(found[0]["query_id"], query)).to_pylist()
            assert sorted(r["id"] for r in rows) == sorted(want.tolist())
            assert sorted(r["score"] for r in rows) == pytest.approx(sorted(abs(scores[want])), abs=1e-7)
    else:
        rows = found[0].to_pylist()
        mine = [r["first_id" if what == "first" else "near"] for r in rows if r["id"] == 2_400]
        earlier = np.flatnonzero(blockwise.unit(whole) @ blockwise.unit(whole[2_400:2_401])[0] >= 0.985)
        assert sorted(mine) == earlier[earlier < 2_400][:1 if what == "first" else 8].tolist()


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_both_ways_of_the_search_agree(spark, monkeypatch, metric):
    """Queries that travel to the corpus, and queries in blocks, with ties, copies and an item without an id."""
    monkeypatch.setattr(blockwise, "RIGHT_TILE", 32)
    monkeypatch.setattr(blockwise, "LEFT_TILE", 16)
    vectors = clustered(5, 300)
    corpus = frame(spark, vectors).union(spark.createDataFrame([(None, [9.0] * 16)], "id bigint, vec array<float>"))
    search = {"ip": neighbours.knn_inner_product, "l2": neighbours.knn_l2}[metric]

    def rows():
        return sorted((r["query_id"], r["rank"], -1 if r["id"] is None else r["id"], r["score"]) for r in search(frame(spark, vectors[:60]), corpus, 12).collect())

    few = rows()
    monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", 10)
    monkeypatch.setattr(neighbours, "QUERIES_IN_BLOCK", 25)
    assert rows() == few and len(few) == 60 * 12
    with pytest.raises(Exception, match="same length"):
        search(frame(spark, vectors[:60]), spark.createDataFrame([(1, [1.0]), (2, [1.0] * 16)], "id bigint, vec array<float>").coalesce(1), 3).collect()
