"""The watched folder as Structured Streaming jobs, each with the transform its batch twin uses."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheafwork.operators.search import build_text_index
from sheafwork.sources.files import FILE_TYPES, allowed

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_hot_folder(spark: SparkSession, folder: str, extensions: Iterable[str] = FILE_TYPES,
                      files_per_trigger: int = 1000) -> DataFrame:
    """New files of the allowed kinds, each once; the query's checkpoint remembers what was taken."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.filter(allowed(F.col("path"), extensions, folder))


def take_into(stream: DataFrame, store: str, checkpoint: str, extensions: Iterable[str] = FILE_TYPES,
              root: str = "") -> StreamingQuery:
    """Append what arrives to a Parquet store, exactly once: rows with a ``path`` of an allowed kind below ``root``."""
    taken = stream.filter(allowed(F.col("path"), extensions, root))
    return taken.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def stream_dedup(rows: DataFrame, time: str = "ts", hash_column: str = "md5_hash", delay: str = "1 day") -> DataFrame:
    """First row of every content within the watermark; state older than that is forgotten.

    Rows without a hash are no copies of each other and all pass.
    """
    watched = rows.withWatermark(time, delay)
    hashed = watched.filter(F.col(hash_column).isNotNull()).dropDuplicatesWithinWatermark([hash_column])
    return hashed.unionByName(watched.filter(F.col(hash_column).isNull()))


def new_to_store(batch: DataFrame, stored: DataFrame, hash_column: str = "md5_hash", order: str = "doc_id") -> DataFrame:
    """Rows of a micro-batch whose content neither the store nor an earlier row of the batch has; those without a hash pass."""
    hashed = batch.filter(F.col(hash_column).isNotNull())
    firsts = hashed.groupBy(hash_column).agg(F.min_by(F.struct(*batch.columns), order).alias("_row"))
    new = firsts.join(stored.select(hash_column), hash_column, "left_anti").select("_row.*")
    return new.unionByName(batch.filter(F.col(hash_column).isNull()))


def dedup_into(stream: DataFrame, store: str, checkpoint: str, hash_column: str = "md5_hash") -> StreamingQuery:
    """Append to the Parquet store what it does not hold yet, whatever the age of the first copy.

    A batch that is replayed after a failure finds its rows stored and adds nothing.
    """
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.schema(batch.schema).parquet(store) if _exists(spark, store) else batch.limit(0)
        new_to_store(batch, stored, hash_column).write.mode("append").parquet(store)

    return _finish(stream, write, checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except Exception as error:  # noqa: BLE001 - only a missing or still empty store counts as absent
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise


def _finish(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def stream_quiet_batches(rows: DataFrame, source: str, time: str, gap: str, delay: str = "1 day") -> DataFrame:
    """Batches that close after a pause: one row per source and batch with its first and last arrival and size."""
    sessions = rows.withWatermark(time, delay).groupBy(source, F.session_window(time, gap))
    return sessions.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).select(
        source, "first", "last", "n")


def quiet_batches(rows: DataFrame, source: str, time: str, gap_seconds: int) -> DataFrame:
    """The batch twin. Arrivals are first folded into slots of one gap, which can never hold a pause, so a source with
    very many arrivals is a list of slots and not of arrivals when it is ordered."""
    def seconds(moment: str) -> F.Column:
        return F.unix_micros(F.col(moment).cast("timestamp")) / F.lit(1_000_000)

    slot = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(gap_seconds * 1_000_000))
    slots = rows.groupBy(source, slot.alias("_slot")).agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))
    ordered = Window.partitionBy(source).orderBy("_slot")
    pause = seconds("first") - F.lag(seconds("last")).over(ordered)
    starts = F.sum(F.when(pause <= gap_seconds, 0).otherwise(1)).over(ordered)
    return slots.withColumn("_batch", starts).groupBy(source, "_batch").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_batch")


def windowed_metrics(records: DataFrame, time: str = "ts", width: str = "1 day") -> DataFrame:
    """ok, failed, seconds per document and reliability per tumbling window; the same on a batch and on a stream."""
    ok, failed = F.count_if(F.col("status") == "OK"), F.count_if(F.col("status") == "FAILED")
    counts = records.groupBy(F.window(time, width)).agg(
        ok.alias("ok_docs"), failed.alias("failed_docs"), F.sum("duration").alias("_spent"))
    total = F.col("ok_docs") + F.col("failed_docs")
    return counts.select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "ok_docs", "failed_docs",
        F.when(total == 0, 0.0).otherwise(F.col("_spent") / total).alias("avg_time"),
        F.when(total == 0, 0.0).otherwise(F.col("ok_docs") / total * 100.0).alias("reliability_pct"))


def stream_batch_metrics(records: DataFrame, time: str = "ts", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Metrics of closed windows, emitted once the watermark has passed them."""
    return windowed_metrics(records.withWatermark(time, delay), time, width)


def updated_postings(postings: DataFrame, changed: DataFrame, deleted: DataFrame | None = None,
                     stemmed: bool = True) -> DataFrame:
    """Postings after documents came, changed or went: a changed document's old postings are replaced whole.

    ``changed``: doc_id, filename, text.
    """
    gone = changed.select("doc_id")
    if deleted is not None:
        gone = gone.unionByName(deleted.select("doc_id"))
    kept = postings.join(gone, "doc_id", "left_anti")
    return kept.select("term", "doc_id", "field", "tf").unionByName(build_text_index(changed, stemmed=stemmed))


def stream_index_upkeep(stream: DataFrame, index: str, checkpoint: str, stemmed: bool = True) -> StreamingQuery:
    """Keep versions of the postings below ``index``: every micro-batch writes ``v=batch`` with its documents' postings.

    A version holds the postings of the batch's documents only; ``current_postings`` takes each document's newest. A
    replayed batch overwrites its own version, so nothing is counted twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("doc_id").agg(F.max_by(F.struct("filename", "text"), "seq").alias("d"))
        docs = latest.select("doc_id", "d.filename", "d.text")
        marks = docs.select(F.lit(None).cast("string").alias("term"), "doc_id", F.lit(None).cast("string").alias("field"),
                            F.lit(0).cast("bigint").alias("tf"))
        build_text_index(docs.filter("text is not null"), stemmed=stemmed).unionByName(marks).write.mode(
            "overwrite").parquet(f"{index}/v={number}")

    return _finish(stream, write, checkpoint)


def current_postings(spark: SparkSession, index: str) -> DataFrame:
    """Postings of every document's newest version; a document whose newest text is null has none."""
    stored = spark.read.parquet(index)
    newest = stored.filter("term is null").groupBy("doc_id").agg(F.max("v").alias("v"))
    return stored.filter("term is not null").join(newest, ["doc_id", "v"], "left_semi").select(
        "term", "doc_id", "field", "tf")


def quarantine_unfinished(started: DataFrame, completed: DataFrame, key: str = "path") -> DataFrame:
    """Items that were started but never completed."""
    return started.join(completed.select(key), key, "left_anti").dropDuplicates([key])
