"""The near-copy index against the exact search, and groups on stored graphs against the scan."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from sheafwork.operators import nearcopies, neighbours
from sheafwork.plans import graph
from test_neighbours import clustered, frame, greedy


def scanned(edges: list[tuple[int, int]]) -> dict[int, int]:
    earlier: dict[int, set[int]] = {}
    nodes = set()
    for v, u in edges:
        nodes |= {u, v}
        earlier.setdefault(v, set()).add(u)
    owner: dict[int, int] = {}
    for n in sorted(nodes):
        owner[n] = min((u for u in earlier.get(n, ()) if owner[u] == u), default=n)
    return owner


def edge_frame(spark, edges):
    return spark.createDataFrame(pd.DataFrame(edges, columns=["v", "u"]), "v bigint, u bigint").repartition(3)


@pytest.mark.parametrize("seed,at_once", [(1, 200_000), (2, 6)])
def test_groups_on_random_graphs(spark, seed, at_once):
    r = random.Random(seed)
    edges = [(max(a, b), min(a, b)) for a, b in ((r.randrange(120), r.randrange(120)) for _ in range(110)) if a != b]
    settled, left = graph.scan_groups(edge_frame(spark, edges + edges[:5] + [(4, 4)]), edges_at_once=at_once)
    assert left is None
    assert {r["id"]: r["owner"] for r in settled.collect()} == scanned(edges) and settled.count() == len(scanned(edges))


def test_groups_on_a_long_chain(spark):
    edges = [(i + 1, i) for i in range(10_000)]
    settled, left = graph.scan_groups(edge_frame(spark, edges))
    assert left is None and {r["id"]: r["owner"] for r in settled.collect()} == scanned(edges)


def test_nodes_with_more_edges_than_listed_stay_open(spark):
    edges = [(1, 0), (2, 1), (5, 1), (6, 5), (7, 6), (9, 8)]
    settled, left = graph.scan_groups(edge_frame(spark, edges), spark.createDataFrame([(5,), (9,)], "v bigint"))
    assert {r["v"] for r in left.collect()} == {5, 6, 7}
    assert {r["id"]: r["owner"] for r in settled.collect()} == {0: 0, 1: 0, 2: 2, 8: 8, 9: 8}


def test_components_of_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(300)] + [(500 + i, 400) for i in range(50)] + [(900, 300), (950, 940)]
    found = {r["node"]: r["root"] for r in graph.smallest_reachable(edge_frame(spark, edges)).collect()}
    assert found == {**{i: 0 for i in range(301)}, 900: 0, 400: 400, **{500 + i: 400 for i in range(50)}, 940: 940, 950: 940}


@pytest.mark.parametrize("listed", [8, 1])
def test_listed_groups_equal_the_greedy_scan(spark, listed):
    vectors = clustered(5, 300)
    got = nearcopies.near_duplicate_groups(frame(spark, vectors), listed=listed).collect()
    want = greedy(vectors, 0.985)
    assert {r["duplicate_id"]: r["primary_id"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("most", [2048, 40])
def test_index_finds_nine_of_ten(spark, monkeypatch, most):
    """Also where a third of all rows are one crowd that no plane parts."""
    monkeypatch.setattr(nearcopies, "MOST_IN_BUCKET", most)
    monkeypatch.setattr(nearcopies, "PIVOTS", 16)
    rng = np.random.RandomState(6)
    centres = rng.randn(120, 32)
    copies = centres[rng.randint(0, 120, 500)]
    gap = 0.17 * np.linalg.norm(copies, axis=1, keepdims=True) * rng.rand(500, 1) / np.sqrt(32)
    crowd = centres[0] + 0.001 * rng.randn(300, 32)
    rows = np.vstack([centres, copies + gap * rng.randn(500, 32), crowd, crowd[:20]]).astype("float32")[rng.permutation(940)]
    exact = {r["id"]: r["first_id"] for r in neighbours.near_duplicate_pairs(frame(spark, rows)).collect()}
    fast = {r["id"]: r["first_id"] for r in nearcopies.near_duplicate_pairs_fast(frame(spark, rows)).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    assert all(unit[a] @ unit[b] >= 0.9849 and b < a for a, b in fast.items())
    assert set(fast) <= set(exact) and len(fast) >= 0.9 * len(exact)
    if most > 1000:
        assert sum(exact[a] == b for a, b in fast.items()) >= 0.9 * len(exact)


def test_fast_groups_have_near_primaries(spark):
    vectors = clustered(7, 400)
    got = {r["duplicate_id"]: r["primary_id"] for r in nearcopies.near_duplicate_groups_fast(frame(spark, vectors)).collect()}
    want = greedy(vectors, 0.985)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert all(unit[a] @ unit[b] >= 0.9849 and b not in got for a, b in got.items())
    assert len(set(got) & set(want)) >= 0.9 * len(want)


def test_missing_and_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [0.0, 0.0])],
                               "id bigint, vec array<float>")
    for search, columns in ((nearcopies.near_duplicate_pairs_fast, ("id", "first_id")),
                            (nearcopies.near_duplicate_groups, ("duplicate_id", "primary_id")),
                            (nearcopies.near_duplicate_groups_fast, ("duplicate_id", "primary_id"))):
        assert {tuple(r[c] for c in columns) for r in search(df).collect()} == {(3, 2)}
        assert search(df.filter("false")).count() == 0
