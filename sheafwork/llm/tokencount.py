"""Token counts without tokenizing: unigram forward scores along a trie of distinct pre-tokens.

A pre-token is a stretch of text between white space, with the spaces before it. The distinct new pre-tokens of a batch
are put into a trie. The forward score of a trie node is the best score of any segmentation of the prefix it stands for:
the best, over the pieces that end there, of an ancestor's score plus the piece's. It is computed once per node, so once
per shared prefix, for all nodes of one depth together; with it goes the number of pieces on the best path. The count
at a pre-token's last node is kept, and a text's count is the sum over its pre-tokens.

Pieces, scores, spelling of unknown characters by bytes and ties are those of ``pieces``, so a count is the length of
that module's encoding.

Defined results: a null or empty text has no pre-tokens and no tokens; repeated rows are counted each; an empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.pieces import HIDDEN, MARK, Vocabulary
from sheafwork.llm.words import WordIndex, after_space, mix, pieces_of

#: Pre-tokens of at most so many characters go into one trie of a rectangular layout; longer ones into tries of theirs.
WIDE = 48
#: Pre-tokens of a trie; more make several.
PER_TRIE = 20_000
SLOTS = 20
_BASE = 0x9E3779B97F4A7C15


class TokenCounter:
    """Numbers of pieces of whole texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        codes, scores = [], []
        for piece, (score, _) in self.vocabulary.scores.items():
            h = 0
            for c in piece:
                h = (h * _BASE + ord(c) + 1) % (1 << 64)
            codes.append(h)
            scores.append(score)
        keys = mix(np.array(codes, dtype=np.uint64))
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], np.array(scores)[order]
        self.maybe = np.zeros(1 << SLOTS, dtype=bool)  # most substrings are no pieces: one look says so
        self.maybe[self.keys >> np.uint64(64 - SLOTS)] = True
        self.powers = [pow(_BASE, i, 1 << 64) for i in range(self.vocabulary.longest + 1)]
        self.counts = np.empty(0, dtype=np.int64)
        self.numbers = WordIndex(self._learn, self._keep)

    def _keep(self, numbers: np.ndarray) -> None:
        self.counts = self.counts[numbers]

    def _learn(self, stretches: list[bytes]) -> None:
        self.counts = np.concatenate((self.counts, self.count([s.decode() for s in stretches])))

    def count(self, stretches: list[str]) -> np.ndarray:
        """Pieces of each stretch, by tries of stretches of like length."""
        read = [s.replace(MARK, HIDDEN).replace(" ", MARK) for s in stretches]
        spelled = [s.replace(" ", MARK) for s in stretches]
        order = sorted(range(len(read)), key=lambda i: (len(read[i]) > WIDE and len(read[i]), read[i], spelled[i]))
        out = np.zeros(len(read), dtype=np.int64)
        at = 0
        while at < len(order):
            to = at + 1
            if len(read[order[at]]) <= WIDE:
                while to < len(order) and to - at < PER_TRIE and len(read[order[to]]) <= WIDE:
                    to += 1
            part = order[at:to]
            out[part] = self._trie([read[i] for i in part], [stretches[i] for i in part])
            at = to
        return out

    def _trie(self, words: list[str], originals: list[str]) -> np.ndarray:
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        points = np.zeros((len(words), width), dtype=np.uint64)
        cost = np.ones((len(words), width), dtype=np.int64)  # bytes that spell a character
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        written = np.frombuffer("".join(originals).encode("utf-32-le"), dtype="<u4")
        filled = np.arange(width) < lengths[:, None]
        points[filled] = flat.astype(np.uint64) + np.uint64(1)
        cost[filled] = 1 + (written >= 0x80) + (written >= 0x800) + (written >= 0x10000)
        # nodes: a word makes new ones from where it leaves the word before it; a node's first word stands for it
        same = np.concatenate((np.zeros((1, width), dtype=bool), (points[1:] == points[:-1]) & (cost[1:] == cost[:-1])))
        new = ~np.logical_and.accumulate(same, axis=1) & filled
        node = np.zeros((len(words), width + 1), dtype=np.int64)
        node[:, 1:][new] = np.arange(1, int(new.sum()) + 1)
        np.maximum.accumulate(node, axis=0, out=node)
        hashed = np.zeros((len(words), width + 1), dtype=np.uint64)
        for d in range(width):
            hashed[:, d + 1] = hashed[:, d] * np.uint64(_BASE) + points[:, d]
        score = np.full(int(new.sum()) + 1, -np.inf)
        tokens = np.zeros(len(score), dtype=np.int64)
        score[0] = 0.0
        for d in range(1, width + 1):
            rows = np.flatnonzero(new[:, d - 1])
            if not len(rows):
                continue
            best, count = np.full(len(rows), -np.inf), np.zeros(len(rows), dtype=np.int64)
            covered = np.zeros(len(rows), dtype=bool)
            for length in range(min(d, self.vocabulary.longest), 0, -1):
                code = mix(hashed[rows, d] - hashed[rows, d - length] * np.uint64(self.powers[length]))
                hit = np.flatnonzero(self.maybe[code >> np.uint64(64 - SLOTS)])
                at = np.minimum(np.searchsorted(self.keys, code[hit]), len(self.keys) - 1)
                real = self.keys[at] == code[hit]
                hit, at = hit[real], at[real]
                before = node[rows[hit], d - length]
                total = score[before] + self.scores[at]
                better = total > best[hit]
                best[hit[better]], count[hit[better]] = total[better], tokens[before[better]] + 1
                if length == 1:
                    covered[hit] = True
            before = node[rows, d - 1]
            total = score[before] + self.vocabulary.unknown
            spell = ~covered & (total > best)
            best[spell], count[spell] = total[spell], tokens[before[spell]] + cost[rows[spell], d - 1]
            score[node[rows, d]], tokens[node[rows, d]] = best, count
        return tokens[node[np.arange(len(words)), lengths]]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of every text."""
        found = pieces_of(after_space(texts))
        numbers = self.numbers(found)  # before the counts are read: it adds to them
        counts = self.counts[numbers]
        ends = np.cumsum(found.counts)
        running = np.concatenate(([0], np.cumsum(counts)))
        return found.counts, running[ends] - running[ends - found.counts]


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The worker's counter for a file: Spark reuses Python workers, and so what they have learned."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens), one row per row of ``docs``; documents are not shuffled."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                pretokens, tokens = count(rows.column(1))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pretokens), pa.array(tokens)],
                                                 names=["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(body, "doc_id bigint, n_pretokens bigint, n_tokens bigint")
