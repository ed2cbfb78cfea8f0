"""Ranked search for a frame of questions: posting blocks with their largest impact, and top-k that passes blocks over.

Questions travel to the index and not blocks to questions: a block is read and decoded once for up to QUESTIONS_IN_BLOCK questions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions.tokens import stem, terms
from sheafwork.operators.search import B, K1
from sheafwork.session import cut_lineage

#: Width of a slice of ids: a term's postings in one slice are one block.
SLICE_IDS = 2048
#: Slices of a question that are read before the bound is known.
FIRST_SLICES = 4
#: Postings of the slices that a task decodes at a time, slots in which their bounds are kept, terms whose shares it spreads over all documents of
#: them, and what share of the documents such a term has at least (one in so many).
BUNDLE_POSTINGS, MOST_SLOTS, MOST_DENSE, SPARSE = 1_000_000, 64, 500, 32
#: Questions that a task holds, and those whose bounds it computes at a time.
QUESTIONS_IN_BLOCK, QUESTIONS_AT_ONCE = 65_536, 4096
#: Postings of a part of the index at least, and parts at most for each core.
LEAST_POSTINGS, PARTS_PER_CORE = 500_000, 3
#: Bounds are summed in other orders than scores, which count at nine places.
SLACK = 1e-8


def corpus_numbers(lengths: DataFrame) -> tuple[int, float]:
    """(documents with terms, their mean length): two numbers that scores need."""
    counted = F.col("n_terms") > 0  # rows of one document are one document with all their terms
    row = lengths.agg(F.count_distinct(F.when(counted, F.col("doc_id"))).alias("named"), F.count_if(counted & F.col("doc_id").isNull()).alias("unnamed"),
                      F.sum(F.when(counted, F.col("n_terms"))).alias("terms")).first()
    n = row["named"] + row["unnamed"]
    return n, row["terms"] / n if n else 1.0


def _groups(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, low first, and how many groups each has."""
    numbers = numbers.astype(np.uint64)
    width = np.maximum(1, np.ceil(np.log2(numbers.astype(np.float64) + 1) / 7)).astype(np.int64)
    width += numbers >> (width * 7).astype(np.uint64) > 0
    at = np.repeat(np.cumsum(width) - width, width)
    place = np.arange(len(at)) - at
    part = (np.repeat(numbers, width) >> (7 * place).astype(np.uint64)) & np.uint64(127)
    more = place < np.repeat(width, width) - 1
    return part.astype(np.uint8) | (more * 128).astype(np.uint8), width


def encode_ids(ids: np.ndarray) -> bytes:
    """Ascending ids as differences in groups of seven bits."""
    return _groups(np.diff(ids, prepend=np.int64(0)))[0].tobytes()


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values`` up to each of the ends, as binary."""
    offsets = (np.concatenate(([0], ends)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(data: bytes) -> np.ndarray:
    """What groups of seven bits stand for."""
    raw = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first).astype(np.int64)


def decode_ids(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data))


def build_blocks(postings: DataFrame, lengths: DataFrame, slice_ids: int = SLICE_IDS) -> DataFrame:
    """(term, slice, n, top, ids, tfs, sizes): a term's postings within one slice of ids, and their largest impact.

    Fields are added up. ``top`` is the largest share, before the term's rarity, that a document of the block can add to a
    score. Blocks are at most ``slice_ids`` postings, so a term of every document is many blocks in many tasks. Ids are not negative.
    """
    _, mean = corpus_numbers(lengths)
    # dealt by document once, for the sums and for the lengths
    summed = postings.repartition("doc_id").groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    sized = summed.join(lengths.groupBy("doc_id").agg(F.sum("n_terms").alias("n_terms")), "doc_id")
    cut = sized.select("term", F.floor(F.col("doc_id") / slice_ids).alias("slice"), "doc_id", "tf", "n_terms")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by term and slice: a block may go on in the next batch
            table = pa.Table.from_batches([*held, batch])
            term, part = table["term"].combine_chunks(), table["slice"].to_numpy()
            code = term.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero((np.diff(code) != 0) | (np.diff(part) != 0)) + 1)) if len(code) else np.array([0])
            if len(starts) > 1:
                yield packed(table, starts)
            held = table.slice(int(starts[-1])).combine_chunks().to_batches()
        if held and held[0].num_rows:
            yield packed(pa.Table.from_batches(held), np.array([0, held[0].num_rows]))

    def packed(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """The blocks that begin at all starts but the last, where they end; all of them are encoded at once."""
        starts, ends = starts[:-1], starts[1:]
        ids, tf, size = (table[c].to_numpy()[:ends[-1]] for c in ("doc_id", "tf", "n_terms"))
        share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        gaps = np.diff(ids, prepend=np.int64(0))
        gaps[starts] = ids[starts]
        groups, width = _groups(gaps)
        first = pa.array(starts)
        return pa.RecordBatch.from_arrays([
            table["term"].combine_chunks().take(first), table["slice"].combine_chunks().take(first), pa.array(ends - starts, pa.int32()),
            pa.array(np.maximum.reduceat(share, starts)), _cut(groups, np.cumsum(width)[ends - 1]), _cut(tf.astype("<i4"), ends),
            _cut(size.astype("<i4"), ends)], names=["term", "slice", "n", "top", "ids", "tfs", "sizes"])

    dealt = cut.repartition("term", "slice").sortWithinPartitions("term", "slice", "doc_id")
    return dealt.mapInArrow(blocks, "term string, slice bigint, n int, top double, ids binary, tfs binary, sizes binary")


def question_terms(questions: DataFrame, stemmed: bool) -> DataFrame:
    """(question_id, term): the distinct terms of every question; rows of one id are one question."""
    found = terms(F.col(questions.columns[1]))
    said = questions.select(F.col(questions.columns[0]).alias("question_id"), F.explode(F.array_distinct(found)).alias("term"))
    if stemmed:
        said = said.withColumn("term", stem("term"))
    return said.filter("question_id is not null").distinct()


def rated_terms(blocks: DataFrame, asked: DataFrame, documents: int) -> DataFrame:
    """(question_id, term, weight, df) of the questions whose terms all occur: a term's rarity, and how many documents have it.

    Only the narrow columns of the blocks are read.
    """
    own = asked.select("term").distinct()
    held = cut_lineage(blocks.select("term", "n").join(own, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")))
    idf = F.log(1 + (F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = cut_lineage(asked.join(held, "term", "left").withColumn("weight", idf))
    unheld = rated.filter("df is null").select("question_id").distinct()
    return cut_lineage(rated.join(unheld, "question_id", "left_anti").select("question_id", "term", "weight", "df"))


class Bundle:
    """Some slices of the index in arrays: for each term its documents, by their place in the bundle, and their shares of a score."""

    def __init__(self, table: pa.Table, number: dict[str, int], mean: float):
        """``table`` has whole slices, sorted by slice and term; ``number`` has the terms that questions have."""
        n = table["n"].to_numpy().astype(np.int64)
        starts = np.cumsum(n) - n
        sums = _numbers(b"".join(table["ids"].to_pylist()))
        np.cumsum(sums, out=sums)
        ids = sums - np.repeat(np.concatenate(([0], sums))[starts], n)
        tf, size = (np.frombuffer(b"".join(table[c].to_pylist()), "<i4").astype(np.float64) for c in ("tfs", "sizes"))
        share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        slices, of_block = np.unique(table["slice"].to_numpy(), return_inverse=True)
        self.slots = min(MOST_SLOTS, len(slices))
        slot = of_block * self.slots // len(slices)
        names = table["term"].combine_chunks().dictionary_encode()
        numbers = np.array([number[t] for t in names.dictionary.to_pylist()], dtype=np.int64)
        term = numbers[names.indices.to_numpy(zero_copy_only=False)]
        self.row = np.full(len(number) + 1, -1)
        present = np.unique(term)
        self.row[present] = np.arange(len(present))
        block_row = self.row[term]
        self.top = np.zeros((len(present) + 1, self.slots))  # the last row stands for terms that are not here
        np.maximum.at(self.top, (block_row, slot), table["top"].to_numpy())
        self.documents, place = np.unique(ids, return_inverse=True)
        self.slot_of = np.zeros(len(self.documents), dtype=np.int64)
        self.slot_of[place] = np.repeat(slot, n)
        order = np.argsort(np.repeat(block_row, n), kind="stable")  # a term's blocks stay in order of slices, so places ascend
        counts = np.bincount(block_row, weights=n, minlength=len(present)).astype(np.int64)
        cuts = np.cumsum(counts)[:-1]
        self.places, self.shares, self.count = np.split(place[order], cuts), np.split(share[order], cuts), counts
        self.dense: dict[int, np.ndarray] = {}
        for t in np.argsort(-counts)[:MOST_DENSE].tolist():
            if counts[t] * SPARSE < len(self.documents):
                break
            self.dense[t] = np.zeros(len(self.documents))
            self.dense[t][self.places[t]] = self.shares[t]

    def scores(self, terms_: np.ndarray, weights: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the documents in the chosen slots that hold all terms: from the rarest term's documents on."""
        order = np.argsort(self.count[terms_], kind="stable")
        first = int(terms_[order[0]])
        at, score = self.places[first], self.shares[first] * weights[order[0]]
        if not slots.all():
            chosen = slots[self.slot_of[at]]
            at, score = at[chosen], score[chosen]
        for i in order[1:].tolist():
            t = int(terms_[i])
            if t in self.dense:
                share = self.dense[t][at]
                has = share > 0
            else:
                found = np.minimum(np.searchsorted(self.places[t], at), self.count[t] - 1)
                share, has = self.shares[t][found], self.places[t][found] == at
            at, score = at[has], score[has] + weights[i] * share[has]
        return self.documents[at], score


class Ranking:
    """The k best documents so far of every question of a block, and the bounds that other documents must reach."""

    def __init__(self, table: pa.Table, k: int, first_slices: int):
        table = table.sort_by([("question_id", "ascending"), ("term", "ascending")])
        ids = table["question_id"].to_numpy()
        names = table["term"].combine_chunks().dictionary_encode()
        self.number = {t: i for i, t in enumerate(names.dictionary.to_pylist())}
        self.terms, self.weights = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), table["weight"].to_numpy()
        self.starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        self.ends = np.append(self.starts[1:], len(ids))
        self.questions, self.k, self.first_slices = ids[self.starts], k, first_slices
        self.floor = np.full(len(self.questions), -np.inf)
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.candidates = self.read = 0

    def meet(self, bundle: Bundle) -> None:
        for first in range(0, len(self.questions), QUESTIONS_AT_ONCE):
            last = min(first + QUESTIONS_AT_ONCE, len(self.questions))
            begin, end = self.starts[first], self.ends[last - 1]
            rows = bundle.row[self.terms[begin:end]]
            tops = bundle.top[rows]
            starts = self.starts[first:last] - begin
            have = np.minimum.reduceat(tops, starts, axis=0) > 0
            bound = np.add.reduceat(tops * self.weights[begin:end, None], starts, axis=0)
            enter = have & (bound >= self.floor[first:last, None] - SLACK)
            self.candidates += int(have.sum())
            for i in np.flatnonzero(enter.any(axis=1)).tolist():
                q, own = first + i, slice(self.starts[first + i] - begin, self.ends[first + i] - begin)
                slots, weights = enter[i], self.weights[begin:end][own]
                if self.floor[q] == -np.inf and slots.sum() > self.first_slices:
                    early = np.zeros_like(slots)
                    early[np.argsort(np.where(slots, -bound[i], np.inf), kind="stable")[:self.first_slices]] = True
                    self._take(q, *bundle.scores(rows[own], weights, early))
                    self.read += int(early.sum())
                    slots = slots & ~early & (bound[i] >= self.floor[q] - SLACK)
                if slots.any():
                    self._take(q, *bundle.scores(rows[own], weights, slots))
                    self.read += int(slots.sum())

    def _take(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if self.floor[q] > -np.inf:
            enter = scores >= self.floor[q] - SLACK
            ids, scores = ids[enter], scores[enter]
        if not len(ids):
            return
        if len(scores) > 4 * self.k:
            enter = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k] - SLACK
            ids, scores = ids[enter], scores[enter]
        if q in self.best:
            ids, scores = np.concatenate((self.best[q][0], ids)), np.concatenate((self.best[q][1], scores))
        order = np.lexsort((ids, -np.round(scores, 9)))[:self.k]
        self.best[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.floor[q] = scores[order[-1]]

    def rows(self) -> pa.RecordBatch:
        """The best of all questions, and a row without a question that has the numbers of candidates and of slices read."""
        held = sorted(self.best)
        own = np.repeat(self.questions[held], [len(self.best[q][0]) for q in held]) if held else np.empty(0, dtype=np.int64)
        ids, scores = (np.concatenate([[x], *[self.best[q][i] for q in held]]) for i, x in enumerate((self.candidates, float(self.read))))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([None], pa.int64()), pa.array(own, pa.int64())]),
                                           pa.array(ids.astype(np.int64)), pa.array(scores)], names=["question_id", "doc_id", "score"])


def scored(blocks: DataFrame, rated: DataFrame, mean: float, k: int, first_slices: int) -> DataFrame:
    """(question_id, doc_id, score): for every question the k best of each part of the index, and what ``Ranking.rows`` counts.

    The index is dealt by slice to parts; a part's blocks travel once to every block of questions that has their term. A task holds a block of
    questions and a bundle of slices at a time.
    """
    numbers = rated.agg(F.count_distinct("question_id").alias("q")).first()["q"], rated.select("term", "df").distinct().agg(
        F.sum("df").alias("n")).first()["n"]
    question_blocks, cores = -(-numbers[0] // QUESTIONS_IN_BLOCK) or 1, blocks.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(PARTS_PER_CORE * cores, (numbers[1] or 0) // LEAST_POSTINGS))
    block = F.pmod(F.xxhash64("question_id"), F.lit(question_blocks)).cast("int").alias("question_block")
    part = F.pmod(F.xxhash64("slice"), F.lit(parts)).cast("int").alias("part")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    asked = rated.select(everywhere, block, F.lit(-1).cast("bigint").alias("slice"), "question_id", "term", "weight")
    terms_ = cut_lineage(rated.select("term", block).distinct())
    held = blocks.join(terms_, "term").select(part, "question_block", "slice", "term", "n", "top", "ids", "tfs", "sizes")
    rows = asked.unionByName(held, allowMissingColumns=True)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking: Ranking | None = None
        group, waiting, pieces, postings = None, [], [], 0
        for batch in batches:  # sorted by part, block of questions and slice: each may go on in the next batch
            keys = [batch.column(i).to_numpy() for i in range(3)]
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in keys], axis=0)) + 1
            for begin, end in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if begin == end:
                    continue
                now, piece = tuple(int(x[begin]) for x in keys), batch.slice(begin, end - begin)
                if group is not None and now != group:
                    if group[2] < 0:
                        ranking, waiting = Ranking(pa.Table.from_batches(waiting), k, first_slices), []
                    if pieces and (now[:2] != group[:2] or postings >= BUNDLE_POSTINGS):
                        ranking.meet(Bundle(pa.Table.from_batches(pieces), ranking.number, mean))
                        pieces, postings = [], 0
                    if now[:2] != group[:2]:
                        yield ranking.rows()
                group = now
                if now[2] < 0:
                    waiting.append(piece.select(["question_id", "term", "weight"]))
                else:
                    pieces.append(piece.select(["slice", "term", "n", "top", "ids", "tfs", "sizes"]))
                    postings += int(np.sum(piece.column("n").to_numpy()))
        if group is not None:
            if group[2] < 0:
                ranking = Ranking(pa.Table.from_batches(waiting), k, first_slices)
            if pieces:
                ranking.meet(Bundle(pa.Table.from_batches(pieces), ranking.number, mean))
            yield ranking.rows()

    dealt = rows.repartition(parts * question_blocks, "part", "question_block").sortWithinPartitions("part", "question_block", "slice", "term")
    return dealt.mapInArrow(body, "question_id bigint, doc_id bigint, score double")


def search_many(blocks: DataFrame, questions: DataFrame, corpus: tuple[int, float], k: int = 50, stemmed: bool = True,
                first_slices: int = FIRST_SLICES, counts: dict[str, int] | None = None) -> DataFrame:
    """(question_id, rank, doc_id, score): for every question the k best documents that hold all its terms, by BM25.

    ``questions`` is (id, text), ``blocks`` a stored result of ``build_blocks`` and ``corpus`` what ``corpus_numbers`` gave
    for it. Every part of the index meets all questions at once. There a question's slices of the highest bounds are read first; the score of
    its k-th document so far is what any other slice's bound must reach to be read at all. Questions without terms, or with a term
    nobody has, have no rows. ``counts``, when given, is filled with the numbers of slices that could have been read and that were.
    """
    documents, mean = corpus
    asked = cut_lineage(question_terms(questions.select(F.col(questions.columns[0]).cast("bigint"), questions.columns[1]), stemmed))
    found = scored(blocks, rated_terms(blocks, asked, documents), mean, k, first_slices)
    if counts is not None:
        found = cut_lineage(found)
        sums = found.filter("question_id is null").agg(F.sum("doc_id").alias("candidates"), F.sum("score").alias("read")).first()
        counts["candidates"], counts["read"] = sums["candidates"] or 0, int(sums["read"] or 0)
    best = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = found.filter("question_id is not null").withColumn("rank", F.row_number().over(best).cast("bigint"))
    return ranked.filter(F.col("rank") <= k).select("question_id", "rank", "doc_id", "score")


__all__ = ["build_blocks", "corpus_numbers", "search_many"]
