"""Token ids in grammar-compressed files (Re-Pair) with random access.

Documents are range-partitioned by id; a partition writes its documents in order as blocks of bounded size. Within a
block, frequent pairs of ids are replaced by nonterminals, round after round: every pair of neighbours is counted exactly,
the most frequent ones become rules, and their occurrences are replaced from left to right, until no pair is frequent.
Later rounds count only what can have changed, pairs with a new symbol and frequent ones left over. A
pair never holds the end id, so no rule spans two documents. A block stores its rules, the expansion length of each, where
every document starts among its symbols, and the symbols, so one document, or one position in it, is decoded without the
rest.

A block is one row (shard, block, doc_ids, n_tokens, payload) of a Parquet table in the shared folder: Spark's writer
commits whole tasks, so a lost executor leaves no half file. The payload's layout, little-endian, is:

    uint32 magic, width (2 or 4 bytes a symbol), terminals, rules, documents; uint64 symbols
    uint32[rules, 2] the pair of each rule; symbol ``terminals + i`` stands for rule i
    uint32[rules]    expansion lengths
    uint64[documents + 1] first symbol of each document
    uint64[documents + 1] first id of each document in the block
    uint16/32[symbols]

Defined results: a null text is an empty one, with the end id alone; a null doc_id comes first; rows with one doc_id
stay together, ordered by text; an empty table writes no block and reads as no rows; further columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import blocks_for
from sheafwork.llm.tokens import encoder
from sheafwork.session import shared_folder

MAGIC = 0x52503031
END = 1
TERMINALS = 49_408
#: Rules a round may add (the other pairs are counted anew in the next one), and how often a pair must occur.
RULES_PER_ROUND, LEAST = 4_000, 16
#: Ids after which a block is closed, and text bytes of a partition.
BLOCK_IDS, PARTITION_BYTES = 2_000_000, 16 << 20
_SPREAD, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 20


def compress(ids: np.ndarray, starts: np.ndarray, end: int = END, terminals: int = TERMINALS, rounds: int | None = None,
             most: int = RULES_PER_ROUND, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, pairs of the rules, first symbol of each document); without ``rounds`` until no pair occurs ``least`` times."""
    symbols, starts, pairs = ids.astype(np.int32), starts.astype(np.int64), []
    added = 0
    # places whose pair can be frequent: at first all; later those that hold a new symbol, and those left over by the last round
    open_ = (symbols[:-1] != end) & (symbols[1:] != end)
    for _ in count() if rounds is None else range(rounds):
        # pairs of 16-bit symbols are 32-bit numbers
        shift, kind = (16, np.uint32) if terminals + added <= 1 << 16 else (32, np.uint64)
        whole = symbols.astype(kind)
        at = np.flatnonzero(open_)
        code = (whole[:-1] << kind(shift) | whole[1:])[at] if 2 * len(at) > len(whole) else whole[at] << kind(shift) | whole[at + 1]
        slot = _slot(code)
        # a slot counts all pairs that share it, so those in a slot below ``least`` are rare; the others are counted exactly
        often = (np.bincount(slot, minlength=1 << _SLOTS) >= least)[slot]
        at, code, slot = at[often], code[often], slot[often]
        ordered = np.sort(code)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[:len(ordered)]
        counts = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(counts >= least)
        often = often[np.argsort(-counts[often], kind="stable")]
        if not len(often):
            break
        found = ordered[first[often]]
        rules = found[:most]
        rule = _places(code, slot, found)
        left_over = at[rule >= len(rules)]
        chosen = (rule >= 0) & (rule < len(rules))
        at, rule = at[chosen], rule[chosen]
        # of overlapping occurrences the first, third, ... of each run are replaced
        run = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(at) != 1)), np.arange(len(at)), 0))
        odd = (np.arange(len(at)) - run) % 2 == 0
        at, rule = at[odd], rule[odd]
        symbols[at] = terminals + added + rule
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        touched = np.zeros(len(symbols), dtype=bool)
        touched[left_over] = True
        symbols, touched = symbols[keep], touched[keep]
        new = symbols >= terminals + added
        # a pair of older symbols never gains occurrences, so one that was rare stays rare
        open_ = (touched[:-1] | new[:-1] | new[1:]) & (symbols[:-1] != end) & (symbols[1:] != end)
        starts = starts - np.searchsorted(at + 1, starts, "left")
        pairs.append(np.stack((rules >> kind(shift), rules & kind((1 << shift) - 1)), axis=1).astype(np.int64))
        added += len(rules)
    return symbols, np.concatenate([np.empty((0, 2), dtype=np.int64), *pairs]), starts


def _slot(code: np.ndarray) -> np.ndarray:
    bits = 8 * code.itemsize
    return ((code * code.dtype.type(_SPREAD >> np.uint64(64 - bits))) >> code.dtype.type(bits - _SLOTS)).astype(np.int32)


def _places(code: np.ndarray, slot: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The place of every code among the rules, or -1: one rule of a slot by a table, the others by a search."""
    of_rule = _slot(rules)
    table = np.full(1 << _SLOTS, -1, dtype=np.int32)
    table[of_rule] = np.arange(len(rules), dtype=np.int32)
    place = table[slot]
    place[rules[place] != code] = -1
    rest = np.flatnonzero(table[of_rule] != np.arange(len(rules)))
    if len(rest):
        shared = np.zeros(1 << _SLOTS, dtype=bool)
        shared[of_rule[rest]] = True
        rest = rest[np.argsort(rules[rest])]
        open_ = np.flatnonzero(shared[slot] & (place < 0))
        found = np.minimum(np.searchsorted(rules[rest], code[open_]), len(rest) - 1)
        place[open_] = np.where(rules[rest][found] == code[open_], rest[found], -1)
    return place


def expansion_lengths(pairs: np.ndarray, terminals: int = TERMINALS) -> np.ndarray:
    """How many ids each rule stands for; a rule's symbols are terminals or earlier rules."""
    lengths = np.ones(len(pairs), dtype=np.int64)
    for i, (a, b) in enumerate(pairs.tolist()):
        lengths[i] = (lengths[a - terminals] if a >= terminals else 1) + (lengths[b - terminals] if b >= terminals else 1)
    return lengths


def pack(ids: np.ndarray, counts: np.ndarray, end: int = END, terminals: int = TERMINALS, **options: int) -> bytes:
    """A block's payload: documents of ``counts`` ids each."""
    first = np.concatenate(([0], np.cumsum(counts)))
    symbols, pairs, starts = compress(ids, first, end, terminals, **options)
    width = 2 if terminals + len(pairs) <= 1 << 16 else 4
    head = np.array([MAGIC, width, terminals, len(pairs), len(counts)], dtype="<u4").tobytes()
    return b"".join((head, np.array([len(symbols)], dtype="<u8").tobytes(), pairs.astype("<u4").tobytes(),
                     expansion_lengths(pairs, terminals).astype("<u4").tobytes(), starts.astype("<u8").tobytes(),
                     first.astype("<u8").tobytes(), symbols.astype(f"<u{width}").tobytes()))


class Block:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        magic, width, self.terminals, rules, documents = np.frombuffer(payload, "<u4", 5).tolist()
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        n, at = int(np.frombuffer(payload, "<u8", 1, 20)[0]), 28

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(payload, kind, count, at)
            at += part.nbytes
            return part

        self.pairs = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.starts = take("<u8", documents + 1).astype(np.int64)
        self.first = take("<u8", documents + 1).astype(np.int64)
        self.symbols = take(f"<u{width}", n)
        # every rule written out once, earlier rules into later ones
        spelled: list[np.ndarray] = []
        for a, b in self.pairs.tolist():
            spelled.append(np.concatenate([spelled[s - self.terminals] if s >= self.terminals
                                           else np.array([s], dtype=np.int32) for s in (a, b)]))
        # every symbol's ids in one array, terminals first
        self.spelled = np.concatenate([np.arange(self.terminals, dtype=np.int32), *spelled])
        self.size = np.concatenate((np.ones(self.terminals, dtype=np.int64), self.lengths))
        self.spelled_at = np.cumsum(self.size) - self.size

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        ends = np.cumsum(size)
        source = np.repeat(self.spelled_at[symbols] - (ends - size), size)
        source += np.arange(len(source))
        return self.spelled[source]

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i`` alone."""
        return self.expand(self.symbols[self.starts[i]:self.starts[i + 1]])

    def at(self, i: int, position: int) -> int:
        """The id at one position of document ``i``: its symbol is found by expansion lengths, and that one expanded."""
        s = self.symbols[self.starts[i]:self.starts[i + 1]]
        size = self.size[s]
        ends = np.cumsum(size)
        k = int(np.searchsorted(ends, position, "right"))
        return int(self.expand(s[k:k + 1])[position - (ends[k] - size[k])])

    def documents(self) -> Iterator[np.ndarray]:
        whole = self.expand(self.symbols)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            yield whole[a:b]


def write_ids(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END,
              terminals: int = TERMINALS, block_ids: int = BLOCK_IDS, partition_bytes: int = PARTITION_BYTES) -> None:
    """Encode all texts and write their ids, in ascending order of doc_id, to a new folder ``path``."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held = TaskContext.get().partitionId(), 0, 0
        encode, docs_held, ids, counts = encoder(tokenizer).encode, [], [], []

        def close() -> pa.RecordBatch:
            flat, sizes = np.concatenate(ids), np.concatenate(counts)
            payload = pack(flat, sizes, end, terminals)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()),
                 pa.array([docs_held], pa.list_(pa.int64())), pa.array([len(flat)], pa.int64()),
                 pa.array([payload], pa.binary())], names=["shard", "block", "doc_ids", "n_tokens", "payload"])

        for batch in batches:
            for part in range(0, batch.num_rows, 200):
                rows = batch.slice(part, 200)
                flat, sizes = encode(rows.column(1), end)
                docs_held += rows.column(0).to_pylist()
                ids.append(flat)
                counts.append(sizes)
                held += len(flat)
                if held >= block_ids:
                    yield close()
                    docs_held, ids, counts, held, block = [], [], [], 0, block + 1
        if docs_held:
            yield close()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(blocks_for(rows, "text", partition_bytes), "doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(body, "shard int, block int, doc_ids array<bigint>, n_tokens bigint, payload binary")
    written.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, in no order.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is of its ids as little-endian uint32.
    """
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, ids, payload in zip(*(c for c in batch.columns)):
                opened = Block(payload.as_py())
                crc = [zlib.crc32(d.astype("<u4", copy=False).tobytes()) for d in opened.documents()]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()),
                     pa.array(ids.as_py(), pa.int64()), pa.array(opened.first[:-1]), pa.array(np.diff(opened.first)),
                     pa.array(crc, pa.int64())],
                    names=["shard", "block", "doc_id", "first", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(path)
    read = blocks.select("shard", "block", "doc_ids", "payload").mapInArrow(
        body, "shard int, block int, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint")
    # one row per shard, then one per block: prefix sums of few numbers
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block")
    starts = blocks.select("shard", "block", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("in_shard"))
    starts = starts.join(earlier, "shard")
    return read.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("shard_start") + F.col("in_shard") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def through_files(docs: DataFrame, tokenizer: str, **options: object) -> DataFrame:
    """``write_ids`` to a new folder below the shared one, then ``read_documents``."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/sheafwork-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, **options)
    return read_documents(spark, path)
