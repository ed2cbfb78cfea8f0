"""New content against all of history: a store by hash prefix with a Bloom filter for each of its parts.

    <store>/data/b=<batch>/prefix=<two digits of the hash, or none>/…parquet     rows
    <store>/blooms/b=<batch>/…parquet                                           (prefix, bits): one filter per part

A micro-batch tests its hashes on the filters of their prefixes and reads only parts that may hold one of them, so what it reads
follows its own content and not the age of the store. Both folders of a batch are written in full by that batch alone, data
first, and a batch is part of the store once its filters are there. A batch that is replayed overwrites its own folders
and is not compared with them, so it adds nothing, rows without a hash included.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheafwork.session import cut_lineage

#: Bits of a filter per hash (rounded up to a power of two), and places a hash sets: about one false answer in a hundred or fewer.
BITS_PER_HASH, PLACES = 12, 6
NO_HASH = "none"


def _places(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` bits every hash sets, a row per hash."""
    steps = np.arange(PLACES, dtype=np.uint64)[None, :]
    return (one.view(np.uint64)[:, None] + steps * (two.view(np.uint64)[:, None] | np.uint64(1))) % np.uint64(size)


def bloom_filter(one: np.ndarray, two: np.ndarray) -> bytes:
    """A filter of the hashes given as two 64-bit numbers each."""
    size = max(64, 1 << int(np.ceil(np.log2(max(1, len(one)) * BITS_PER_HASH))))
    bits = np.zeros(size, dtype=bool)
    bits[_places(one, two, size).astype(np.int64).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter may hold: all that it does hold, and few others."""
    flags = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
    return flags[_places(one, two, len(flags)).astype(np.int64)].all(axis=1)


def _keyed(rows: DataFrame, hash_column: str) -> DataFrame:
    prefix = F.when(F.col(hash_column).isNull(), NO_HASH).otherwise(F.lower(F.substring(hash_column, 1, 2)))
    return rows.withColumn("prefix", F.regexp_replace(prefix, r"[^0-9a-z]", "_"))


def _numbers(hash_column: str) -> list:
    return [F.xxhash64(hash_column).alias("one"), F.xxhash64(F.lit(1), hash_column).alias("two")]


def _present(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path))


def parts_to_read(new: DataFrame, store: str, own: str, hash_column: str) -> list[str]:
    """Folders of the store's parts that may hold a hash of ``new``, those of the batch ``own`` left out.

    One short string per part travels to the driver.
    """
    spark = new.sparkSession
    if not _present(spark, f"{store}/blooms"):
        return []
    asked = new.filter(F.col(hash_column).isNotNull()).select("prefix", *_numbers(hash_column))
    asked = asked.groupBy("prefix").agg(F.collect_list("one").alias("ones"), F.collect_list("two").alias("twos"))
    filters = spark.read.schema("prefix string, bits binary, b string").parquet(f"{store}/blooms").filter(F.col("b") != own)

    def test(batches):
        for batch in batches:
            keep = [bool(may_hold(bits.as_py(), *(np.array(x.as_py(), dtype=np.int64) for x in (ones, twos))).any())
                    for bits, ones, twos in zip(*(batch.column(i) for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["b", "prefix"]).filter(pa.array(keep, pa.bool_()))

    found = filters.join(asked, "prefix").select("b", "prefix", "bits", "ones", "twos").mapInArrow(test, "b string, prefix string")
    return [f"{store}/data/b={r['b']}/prefix={r['prefix']}" for r in found.distinct().collect()]


def add_new(batch: DataFrame, store: str, own: str, hash_column: str = "md5_hash", order: str = "doc_id") -> list[str]:
    """Add to the store what neither it nor an earlier row of the batch has; rows without a hash are all new.

    Returns the parts that were read. ``own`` names the batch: the same name again replaces what it added.
    """
    rows = _keyed(batch, hash_column)
    hashed = rows.filter(F.col(hash_column).isNotNull()).groupBy(hash_column).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    new = cut_lineage(hashed.select("r.*").unionByName(rows.filter(F.col(hash_column).isNull())))
    read = parts_to_read(new, store, own, hash_column)
    if read:
        held = batch.sparkSession.read.schema(batch.schema).parquet(*read).select(hash_column)
        new = cut_lineage(new.join(held, hash_column, "left_anti").select(*new.columns))

    def pack(group: pa.Table) -> pa.Table:
        bits = bloom_filter(group["one"].to_numpy(), group["two"].to_numpy())
        return pa.table({"prefix": group["prefix"].slice(0, 1), "bits": pa.array([bits], pa.binary())})

    filters = new.filter(F.col(hash_column).isNotNull()).select("prefix", *_numbers(hash_column)).groupBy("prefix").applyInArrow(
        pack, "prefix string, bits binary")
    new.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{store}/data/b={own}")
    filters.write.mode("overwrite").parquet(f"{store}/blooms/b={own}")
    return read


def history(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """All rows of the store's committed batches."""
    done = spark.read.schema("prefix string, bits binary, b string").parquet(f"{store}/blooms").select("b").distinct()
    rows = spark.read.schema(f"{schema}, b string, prefix string").parquet(f"{store}/data")
    return rows.join(done, "b", "left_semi").drop("b", "prefix")


def dedup_history(stream: DataFrame, store: str, checkpoint: str, hash_column: str = "md5_hash", order: str = "doc_id",
                  seen: Callable[[int, list[str]], None] | None = None) -> StreamingQuery:
    """Run a stream into the store, once for what is available. ``seen`` is told the parts each batch has read.

    Batches are named by the checkpoint and their number, so several streams, or one begun anew, can share a store.
    """
    run = f"{zlib.crc32(checkpoint.encode()):08x}"

    def write(batch: DataFrame, number: int) -> None:
        read = add_new(batch, store, f"{run}-{number}", hash_column, order)
        if seen is not None:
            seen(number, read)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
