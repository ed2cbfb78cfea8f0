from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sheafwork.catalog.derived import frame
from sheafwork.operators.search import build_text_index
from sheafwork.streaming import jobs


def drain(stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def as_stream(df, tmp_path, name, files=4):
    """The rows of ``df`` as files read one per trigger, in ``ts`` order."""
    folder = str(tmp_path / name)
    cuts = [None, *df.selectExpr("unix_micros(ts) as t").approxQuantile("t", [i / files for i in range(1, files)], 0), None]
    for low, high in zip(cuts, cuts[1:]):
        part = df.filter(F.lit(low is None) | (F.unix_micros("ts") >= F.lit(low or 0)))
        part.filter(F.lit(high is None) | (F.unix_micros("ts") < F.lit(high or 0))).coalesce(1).write.mode(
            "append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def events(spark, sf):
    return frame(spark, sf, "records").withColumn("ts", F.col("ts").cast("timestamp")).join(
        frame(spark, sf, "events").select("event_id", "user_id"), "event_id")


def test_hot_folder_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("a")
    (inbox / "b.exe").write_text("b")
    seen = str(tmp_path / "seen")

    def run():
        stream = jobs.stream_hot_folder(spark, str(inbox)).select("path")
        query = stream.writeStream.format("parquet").option("path", seen).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        return sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.schema("path string").parquet(seen).collect())

    assert run() == ["a.txt"]
    (inbox / "c.PNG").write_text("c")
    assert run() == ["a.txt", "c.PNG"]
    assert run() == ["a.txt", "c.PNG"]


def test_dedup_stream(spark, tmp_path, events):
    twice = events.unionByName(events.limit(50)).withColumn("md5_hash", F.md5("filename"))
    got = drain(jobs.stream_dedup(as_stream(twice, tmp_path, "dup"), delay="60 days"), tmp_path, "dedup")
    assert got.count() == events.count()


def test_dedup_into_store_across_runs(spark, tmp_path):
    def feed(rows, run):
        df = spark.createDataFrame(rows, "doc_id bigint, md5_hash string").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "feed"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed"))
        jobs.dedup_into(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(60)
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "store")).select("doc_id", "md5_hash").collect())

    assert feed([(1, "x"), (2, "x"), (3, "y")], 1) == [(1, "x"), (3, "y")]
    assert feed([(4, "y"), (5, "z"), (6, "z")], 2) == [(1, "x"), (3, "y"), (5, "z")]


def test_quiet_batches_equal_their_twin(spark, tmp_path, events):
    stream = jobs.stream_quiet_batches(as_stream(events, tmp_path, "quiet"), "user_id", "ts", "2 hours", "0 seconds")
    got = {(r["user_id"], r["first"], r["last"], r["n"]) for r in drain(stream, tmp_path, "quiet_out").collect()}
    twin = jobs.quiet_batches(events, "user_id", "ts", 7200)
    want = {(r["user_id"], r["first"], r["last"], r["n"]) for r in twin.collect()}
    end = events.agg(F.max("ts")).first()[0]
    closed = {w for w in want if (end - w[2]).total_seconds() > 7200}
    assert closed and closed <= got <= want


def test_metrics_equal_their_twin_for_closed_windows(spark, tmp_path, events):
    stream = jobs.stream_batch_metrics(as_stream(events, tmp_path, "metrics"))
    got = {r["start"]: (r["ok_docs"], r["failed_docs"], round(r["avg_time"], 6)) for r in
           drain(stream, tmp_path, "metrics_out").collect()}
    twin = jobs.windowed_metrics(events).collect()
    end = events.agg(F.max("ts")).first()[0]
    want = {r["start"]: (r["ok_docs"], r["failed_docs"], round(r["avg_time"], 6)) for r in twin
            if (end - r["end"]).total_seconds() >= 3600}
    assert want and got == want


def test_index_upkeep_stream(spark, tmp_path):
    """Edits replace a document's postings, a null text removes it, replaying changes nothing."""
    schema = "seq bigint, doc_id bigint, filename string, text string"
    feed, index = str(tmp_path / "feed"), str(tmp_path / "index")

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).parquet(feed)
        jobs.stream_index_upkeep(stream, index, str(tmp_path / "cp")).awaitTermination(60)
        return {tuple(r) for r in jobs.current_postings(spark, index).collect()}

    def batch(rows):
        return {tuple(r) for r in build_text_index(spark.createDataFrame(rows, schema)).collect()}

    assert send([(1, 1, "a.txt", "running dogs"), (2, 2, "b.txt", "cats"), (3, 1, "a.txt", "runs twice")]) == batch(
        [(3, 1, "a.txt", "runs twice"), (2, 2, "b.txt", "cats")])
    assert send([(4, 2, "b.txt", None), (5, 3, "c.txt", "new dogs")]) == batch(
        [(3, 1, "a.txt", "runs twice"), (5, 3, "c.txt", "new dogs")])


def test_rows_without_a_hash_all_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "doc_id bigint, md5_hash string")
    stored = spark.createDataFrame([("b",), (None,)], "md5_hash string")
    assert sorted(r["doc_id"] for r in jobs.new_to_store(rows, stored).collect()) == [1, 2, 3]
    timed = rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    timed.write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_dedup(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema(timed.schema).parquet(str(tmp_path / "out")).count() == 4
