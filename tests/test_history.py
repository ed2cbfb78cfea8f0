"""Idle batches by the clock, and new content against a store with Bloom filters."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from sheafwork.streaming import history, idle

SCHEMA = "doc_id bigint, md5_hash string"


def test_last_batch_closes_by_itself_and_survives_a_restart(spark, tmp_path):
    feed, out, cp = (str(tmp_path / x) for x in ("feed", "out", "cp"))
    schema = "src string, ts timestamp"
    spark.conf.set("spark.sql.shuffle.partitions", 2)

    def arrive(rows):
        spark.createDataFrame(rows, "src string, ts string").select("src", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(feed)

    def start(idle_seconds):
        stream = spark.readStream.schema(schema).parquet(feed)
        return idle.stream_idle_batches(stream, "src", "ts", idle_seconds).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", cp).trigger(processingTime="500 milliseconds").start()

    def closed():
        read = spark.read.schema("src string, first timestamp, last timestamp, n bigint").parquet(out)
        return sorted((r["src"], str(r["first"])[11:16], str(r["last"])[11:16], r["n"]) for r in read.collect())

    def wait(n):
        until = time.time() + 240
        while time.time() < until and len(closed()) < n:
            time.sleep(0.5)
        return closed()

    arrive([("a", "2024-01-01 10:00"), ("a", "2024-01-01 10:05"), ("b", "2024-01-01 09:00")])
    query = start(6)
    try:
        first = [("a", "10:00", "10:05", 2), ("b", "09:00", "09:00", 1)]
        assert wait(2) == first  # without any later arrival
        arrive([("a", "2024-01-01 11:00")])
        until = time.time() + 60
        while time.time() < until and sum(p["numInputRows"] for p in query.recentProgress) < 4:
            time.sleep(0.2)
    finally:
        query.stop()
    query = start(6)  # the open batch and its timer come from the checkpoint
    try:
        assert wait(3) == sorted([*first, ("a", "11:00", "11:00", 1)])  # a batch of its own: nothing was kept of the first one
        until = time.time() + 90
        rows = None
        while time.time() < until and rows != 0:
            time.sleep(0.5)
            rows = (query.lastProgress or {"stateOperators": [{"numRowsTotal": None}]})["stateOperators"][0]["numRowsTotal"]
        assert rows == 0
    finally:
        query.stop()


def test_store_adds_what_is_new_and_a_replay_nothing(spark, tmp_path):
    feed, store, cp = (str(tmp_path / x) for x in ("feed", "store", "cp"))

    def send(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        history.dedup_history(spark.readStream.schema(SCHEMA).parquet(feed), store, cp).awaitTermination(120)
        return sorted(map(tuple, history.history(spark, store, SCHEMA).collect()), key=repr)

    first = [(1, "aa1"), (3, None), (4, "bb2")]
    assert send([(1, "aa1"), (2, "aa1"), (3, None), (4, "bb2")]) == first
    assert send([(5, "bb2"), (6, None), (7, "cc3"), (8, "AA1")]) == sorted([*first, (6, None), (7, "cc3"), (8, "AA1")], key=repr)
    before = sorted(map(tuple, history.history(spark, store, SCHEMA).collect()), key=repr)
    again = spark.createDataFrame([(5, "bb2"), (6, None), (7, "cc3"), (8, "AA1")], SCHEMA)
    own = next(p.name[2:] for p in (tmp_path / "store" / "data").iterdir() if p.name.endswith("-1"))
    history.add_new(again, store, own)
    assert sorted(map(tuple, history.history(spark, store, SCHEMA).collect()), key=repr) == before


def test_parts_read_do_not_grow_with_the_store(spark, tmp_path):
    store = str(tmp_path / "store")
    read = []
    for b in range(5):
        rows = spark.range(b * 300, b * 300 + 300).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("md5_hash"))
        twins = spark.range(4).select((F.col("id") + 10_000).alias("doc_id"), F.md5(F.col("id").cast("string")).alias("md5_hash"))
        read.append(len(history.add_new(rows.union(twins) if b else rows, store, f"t-{b}")))
    assert history.history(spark, store, SCHEMA).count() == 1500
    assert read[0] == 0 and all(4 <= n <= 20 for n in read[1:])  # four hashes are there, false answers are few


def test_filters_hold_what_they_were_given():
    r = np.random.default_rng(1)
    one, two = r.integers(-2**63, 2**63, 3000), r.integers(-2**63, 2**63, 3000)
    bits = history.bloom_filter(one[:1000], two[:1000])
    assert history.may_hold(bits, one[:1000], two[:1000]).all()
    assert history.may_hold(bits, one[1000:], two[1000:]).mean() < 0.03
    assert not history.may_hold(history.bloom_filter(one[:0], two[:0]), one, two).any()
