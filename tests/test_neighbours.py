from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sheafwork.operators import neighbours
from sheafwork.plans import blockwise
from sheafwork.plans.prefix import row_numbers, running_sums
from pyspark.sql import functions as F


def clustered(seed: int, n: int = 600) -> np.ndarray:
    """A third are one vector or jitters of it, the rest chains of slowly turning vectors and loners."""
    rng = np.random.RandomState(seed)
    hot = rng.randn(16)
    rows = []
    for i in range(n):
        if i % 6 == 0:
            rows.append(hot)
        elif i % 6 == 1:
            rows.append(hot + 0.02 * rng.randn(16))
        elif i % 6 == 2 and len(rows) > 3:
            rows.append(rows[-3] / np.linalg.norm(rows[-3]) + 0.045 * rng.randn(16))
        else:
            rows.append(rng.randn(16))
    return np.array(rows).astype("float32")


def greedy(vectors: np.ndarray, threshold: float) -> dict[int, int]:
    unit = vectors.astype("float64") / np.linalg.norm(vectors.astype("float64"), axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 9) >= threshold
    owner: dict[int, int] = {}
    for i in range(len(vectors)):
        if i in owner:
            continue
        owner[i] = i
        for j in range(i + 1, len(vectors)):
            if near[i, j] and j not in owner:
                owner[j] = i
    return {i: o for i, o in owner.items() if i != o}


def frame(spark, vectors):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(vectors)), "vec": list(vectors)}),
                                 "id bigint, vec array<float>").repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_the_greedy_scan(spark, seed, monkeypatch):
    monkeypatch.setattr(blockwise, "LEAST_ROWS", 100)
    vectors = clustered(seed)
    got = neighbours.near_duplicate_groups(frame(spark, vectors)).collect()
    want = greedy(vectors, 0.985)
    assert {r["duplicate_id"]: r["primary_id"] for r in got} == want
    assert len(got) == len(want)


def test_pairs_are_one_row_per_item(spark, monkeypatch):
    monkeypatch.setattr(blockwise, "LEAST_ROWS", 100)
    vectors = clustered(3)
    unit = vectors.astype("float64") / np.linalg.norm(vectors.astype("float64"), axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 9) >= 0.985
    want = {i: int(np.flatnonzero(near[i, :i])[0]) for i in range(len(vectors)) if near[i, :i].any()}
    got = neighbours.near_duplicate_pairs(frame(spark, vectors)).collect()
    assert {r["id"]: r["first_id"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("at_once", [1024, 7])
def test_knn_small_and_block_paths(spark, monkeypatch, at_once):
    monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", at_once)
    monkeypatch.setattr(blockwise, "LEAST_ROWS", 50)
    vectors = clustered(4, 240)
    asked = frame(spark, vectors[:30])
    got = neighbours.knn_l2(asked, frame(spark, vectors), 3).collect()
    for q in range(30):
        gaps = np.round(np.sqrt(((vectors[q].astype("float64") - vectors.astype("float64")) ** 2).sum(1)), 6)
        best = sorted(range(len(vectors)), key=lambda i: (gaps[i], i))[:3]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["score"] for r in mine] == pytest.approx([gaps[i] for i in best], abs=2e-6)
        assert [r["id"] for r in mine if r["score"] == 0] == [i for i in best if gaps[i] == 0]


def test_knn_contains_itself_and_clips_k(spark):
    vectors = np.eye(3, 16, dtype="float32")
    got = neighbours.knn_inner_product(frame(spark, vectors[:1]), frame(spark, vectors), 2).collect()
    assert 0 in [r["id"] for r in got] and len(got) == 2
    assert neighbours.knn_inner_product(frame(spark, vectors[:1]), frame(spark, vectors), 50).count() == 3


def test_incremental_embeddings_encode_only_what_is_stale(spark):
    items = spark.createDataFrame([("a", 5, "x"), ("b", 5, "y"), ("c", 5, "z")], "path string, mtime int, text string")
    cache = spark.createDataFrame([("a", 6, [9.0]), ("b", 4, [9.0])], "path string, mtime int, embedding array<float>")
    got = neighbours.incremental_embeddings(items, cache, lambda texts: np.ones((len(texts), 1))).collect()
    assert {r["path"]: (r["mtime"], r["embedding"]) for r in got} == {
        "a": (6, [9.0]), "b": (5, [1.0]), "c": (5, [1.0])}


def test_null_keys_and_orders_stay(spark):
    from sheafwork.operators.fields import amount_anomalies

    rows = [(i if i % 4 else None, None if i % 3 else 1, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "n bigint, k bigint, x double")
    got = running_sums(df, ["k"], ["n"], {"s": F.col("x")}, bucket_by="n", buckets=8).toPandas()
    assert len(got) == 40 and got["n"].isna().sum() == 10
    dated = got[got["n"].notna()].sort_values("n")
    for missing in (True, False):
        mine = dated[dated["k"].isna() == missing]
        before = sum(x for n, k, x in rows if n is None and (k is None) == missing)
        assert (mine["s"] == before + mine["x"].cumsum() - mine["x"]).all()
    assert row_numbers(df, ["k"], ["n"], bucket_by="n", name="i").count() == 40
    amounts = spark.createDataFrame([*rows, (99, None, None)], df.schema)
    flagged = {(r["n"], r["x"]): r["anomalies"] for r in amount_anomalies(amounts, "k", "n", "x").collect()}
    assert len(flagged) == 41 and flagged[99, None] == ["invalid_amount"]


def test_missing_vectors_are_near_nothing(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, None), (5, [0.0, 1.0])],
                                    "id bigint, v array<double>")
    assert [tuple(r) for r in neighbours.near_duplicate_pairs(vectors).collect()] == [(3, 1)]
    assert [tuple(r) for r in neighbours.near_duplicate_groups(vectors).collect()] == [(1, 3)]


def test_running_sums_with_a_hot_key(spark):
    rng = np.random.RandomState(0)
    data = pd.DataFrame({"k": np.where(rng.rand(2000) < 0.4, 1, rng.randint(0, 50, 2000)), "n": rng.permutation(2000),
                         "x": rng.randint(0, 9, 2000)})
    df = spark.createDataFrame(data)
    got = running_sums(df, ["k"], ["n"], {"s": F.col("x")}, bucket_by="n", buckets=16).toPandas()
    ordered = data.sort_values("n")
    ordered["s"] = ordered.groupby("k")["x"].cumsum() - ordered["x"]
    merged = got.merge(ordered, on=["k", "n", "x"], suffixes=("", "_want"))
    assert len(merged) == 2000 and (merged["s"] == merged["s_want"]).all()
    numbers = row_numbers(df, [], ["n"], bucket_by="n", name="i").toPandas()
    assert (numbers["i"] == numbers["n"] + 1).all()
