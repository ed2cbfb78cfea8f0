"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces and one Viterbi pass.

A text is written as SentencePiece writes it: a space before it, and every space as the mark U+2581. The automaton reads
it once; at each position its output links give every piece that ends there, and each relaxes the best score of that
position. A character that no piece of one character covers may be spelled by its UTF-8 bytes, at a score below all
pieces. Of equal scores the longer last piece is taken. The mark itself, where a text holds it, is spelled by bytes, so
decoding gives back every text exactly.

No piece holds white space behind another character, so a text's best segmentation is that of its stretches between
white space; each distinct stretch is segmented once per worker and remembered, up to a bound.

Defined results: a null text has null ids and an empty text none; null ids decode to null; further columns stay as they
are.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import fresh
from sheafwork.llm.words import Ragged, WordIndex, after_space, pieces_of

MARK = "▁"
#: Stands for the mark while a text is segmented; in no piece (fixed value).
HIDDEN = "\x01"
#: An unknown character scores so much less than the least piece (fixed value of the format).
UNKNOWN = 10.0


class Vocabulary:
    """The pieces of a SentencePiece model file, their scores, and what each id decodes to."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.scores: dict[str, tuple[float, int]] = {}
        self.decoded: list[bytes] = []
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.decoded.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.decoded.append(b"")
            else:
                self.decoded.append(piece.replace(MARK, " ").encode())
                if HIDDEN not in piece:
                    self.scores[piece] = (model.get_score(i), i)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces: texts could not be given back exactly")
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("a piece crosses white space")
        self.unknown = min(score for score, _ in self.scores.values()) - UNKNOWN
        self.longest = max(map(len, self.scores))


class Segmenter:
    """Ids of whole texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for piece, (score, i) in self.vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.known = Ragged()
        self.numbers = WordIndex(self._learn, self.known.keep)

    def _learn(self, stretches: list[bytes]) -> None:
        self.known.add([self.segment(s.decode()) for s in stretches])

    def segment(self, text: str) -> list[int]:
        """The ids of one stretch whose spaces are still spaces: Viterbi over the automaton's matches."""
        read = text.replace(MARK, HIDDEN).replace(" ", MARK)
        n, unknown = len(read), self.vocabulary.unknown
        best, back, covered = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1), [False] * (n + 1)
        settled = 0

        def settle(to: int) -> None:
            """Positions up to ``to`` have all their pieces: those no single character piece ends at may be spelled."""
            nonlocal settled
            while settled < to:
                settled += 1
                if not covered[settled] and best[settled - 1] + unknown > best[settled]:
                    best[settled], back[settled] = best[settled - 1] + unknown, (settled - 1, -1)

        for last, (length, score, piece) in self.automaton.iter(read):
            settle(last)
            end, start = last + 1, last + 1 - length
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, piece)
            if length == 1:
                covered[end] = True
        settle(n)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.vocabulary.byte_ids[list(text[start].encode())][::-1].tolist())
            at = start
        return out[::-1]

    def encode(self, texts: pa.Array) -> pa.Array:
        """A list of ids per text, null for a null text."""
        found = pieces_of(after_space(texts))
        ids, lengths = self.known.take(self.numbers(found))
        offsets = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(found.counts)))]
        return _lists(offsets, ids, texts)


def _lists(offsets: np.ndarray, values: np.ndarray, texts: pa.Array) -> pa.Array:
    at = pa.array(offsets.astype(np.int32), mask=np.append(np.asarray(texts.is_null()), False)) \
        if texts.null_count else pa.array(offsets.astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(values, pa.int32()))


def decode(ids: pa.Array, table: list[bytes]) -> list[str | None]:
    """The texts of id lists: the pieces' bytes, without the space put before them."""
    out: list[str | None] = []
    for entry in ids:
        if not entry.is_valid:
            out.append(None)
            continue
        body = b"".join(map(table.__getitem__, entry.values.to_numpy().tolist()))
        out.append(body[1:].decode("utf-8", "replace"))
    return out


_segmenters: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    """The worker's segmenter for a file: Spark reuses Python workers, and so what they have learned."""
    if path not in _segmenters:
        _segmenters[path] = Segmenter(path)
    return _segmenters[path]


def piece_ids(text: Column, path: str) -> Column:
    """The ids of a text column as ``array<int>``; evaluated once however often the result is used."""
    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        segment = segmenter(path)
        for batch in texts:
            for at in range(0, len(batch), 200):
                yield segment.encode(batch.slice(at, 200))
            pa.default_memory_pool().release_unused()  # two workers share what an executor leaves beside its heap

    return encode.asNondeterministic()(text)


def piece_text(ids: Column, path: str) -> Column:
    """The text of an id column."""
    @F.arrow_udf("string")
    def restore(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = Vocabulary(path).decoded
        for batch in lists:
            yield pa.array(decode(batch, table), pa.string())

    return restore(ids)


def with_ids(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> tuple[DataFrame, str]:
    """``docs`` with one more column of ids, whose name is returned."""
    name = fresh(docs, ids)
    return docs.withColumn(name, piece_ids(F.col(text), path)), name
