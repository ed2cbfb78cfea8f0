"""Words of whole texts as arrays: where they are, and a 64-bit hash of each.

A batch of texts is one Arrow array; its bytes are scanned with numpy, a stretch of bounded size at a time, and no
Python string is made. A word is a run of bytes other than ASCII white space; UTF-8 keeps these bytes for themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sheafwork.llm.common import SPACE

#: Bytes scanned at a time; a stretch ends at white space, so a longer word makes a longer stretch.
STRETCH = 1 << 20
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = _LOWER.copy()
_LETTERS[[c for c in range(128) if not chr(c).isalnum()]] = 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, size=256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = [_powers(_BASE, STRETCH), _powers(_INVERSE, STRETCH)]


class Words(NamedTuple):
    """Words of a batch in order; ``counts`` has how many each text has."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.starts[i] + self.lengths[i]].tobytes()

    def per_text(self, values: np.ndarray) -> list[np.ndarray]:
        return np.split(values, np.cumsum(self.counts)[:-1])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, and where each text starts; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def words_of(texts: pa.Array, lower: bool = False, letters_only: bool = False) -> Words:
    """All words of a string array; ``lower`` maps A-Z to a-z first, ``letters_only`` also ASCII other than letters and
    digits to spaces."""
    data, offsets = bytes_of(texts)
    if lower or letters_only:
        data = (_LETTERS if letters_only else _LOWER)[data]
    filled = ~_IS_SPACE[data]
    # a text's first byte starts a word even when the text before it does not end in white space
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([True], ~filled[:-1])) if len(data) else filled
    after = np.concatenate((~filled[1:], [True])) if len(data) else filled
    starts = np.flatnonzero(filled & (before | edge[:-1]))
    ends = np.flatnonzero(filled & (after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends - starts, hashes_of(data, starts, ends), np.diff(first))


def after_space(texts: pa.Array) -> pa.Array:
    """Every text behind one space; an empty text stays empty and a null one null."""
    texts = texts.cast(pa.large_string())
    empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    return pc.if_else(pc.equal(texts, empty), empty, pc.binary_join_element_wise(space, texts, empty))


def pieces_of(texts: pa.Array) -> Words:
    """Every byte of a string array, cut before runs of spaces and around the other white space characters."""
    data, offsets = bytes_of(texts)
    if not len(data):
        return Words(data, *[np.empty(0, dtype=np.int64)] * 2, np.empty(0, dtype=np.uint64), np.diff(offsets))
    blank = data == 32
    other = _IS_SPACE[data] & ~blank
    begins = blank & np.concatenate(([True], ~blank[:-1]))
    begins |= other | np.concatenate(([True], other[:-1]))
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends - starts, hashes_of(data, starts, ends), np.diff(first))


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ascending, disjoint range of bytes: differences of a running polynomial sum."""
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + STRETCH, "right")))
        size = int(ends[to - 1]) - begin
        power, inverse = _POWERS if size <= STRETCH else (_powers(_BASE, size), _powers(_INVERSE, size))
        running = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_LETTER[data[begin:begin + size]] * power[:size], out=running[1:])
        a, b = starts[at:to] - begin, ends[at:to] - begin
        hashes[at:to] = (running[b] - running[a]) * inverse[a]
        at = to
    return mix(hashes + (ends - starts).astype(np.uint64))


class WordIndex:
    """Numbers for words by hash, dense from 0; ``learn`` is given the words that are new, or, with ``places``, the batch and
    where they are in it.

    A direct-mapped table answers nearly all lookups with two array reads; the rest go through a dictionary. Beyond
    ``most`` words those that only one batch had are forgotten, and if need be the rarer half; ``keep`` is given the
    numbers that stay, in the order of their new ones.
    """

    def __init__(self, learn: Callable[..., None], keep: Callable[[np.ndarray], None], most: int = 250_000,
                 bits: int = 20, places: bool = False):
        self.learn, self.keep, self.most, self.shift, self.places = learn, keep, most, np.uint64(64 - bits), places
        self.slot_hash = np.zeros(1 << bits, dtype=np.uint64)
        self.slot_number = np.full(1 << bits, -1, dtype=np.int32)
        self.numbers: dict[int, int] = {}
        self.batches = np.zeros(1 << 16, dtype=np.int32)  # how many batches had each word

    def _forget(self) -> None:
        used = self.batches[:len(self.numbers)]
        stay = np.flatnonzero(used > 1)
        if len(stay) > self.most // 2:
            stay = np.sort(stay[np.argsort(-used[stay], kind="stable")[:self.most // 2]])
        hashes = np.fromiter(self.numbers, dtype=np.uint64, count=len(self.numbers))[stay]
        self.numbers = dict(zip(hashes.tolist(), range(len(stay))))
        self.slot_number[:] = -1
        self.batches[:len(stay)] = 1
        self.batches[len(stay):] = 0
        self.keep(stay)

    def __call__(self, words: Words) -> np.ndarray:
        if len(self.numbers) > self.most:
            self._forget()
        slots = (words.hashes >> self.shift).astype(np.int64)
        out = self.slot_number[slots]
        missing = np.flatnonzero((self.slot_hash[slots] != words.hashes) | (out < 0))
        if len(missing):
            unknown, first, back = np.unique(words.hashes[missing], return_index=True, return_inverse=True)
            numbers, new = np.empty(len(unknown), dtype=np.int32), []
            get, count = self.numbers.get, len(self.numbers)
            for i, h in enumerate(unknown.tolist()):
                n = get(h)
                if n is None:
                    n = count + len(new)
                    new.append(i)
                    self.numbers[h] = n
                numbers[i] = n
            if new:
                at = missing[first[new]]
                if self.places:
                    self.learn(words, at)
                else:
                    self.learn([words.word(i) for i in at])
            out[missing] = numbers[back]
            into = (unknown >> self.shift).astype(np.int64)
            self.slot_hash[into], self.slot_number[into] = unknown, numbers
        while len(self.numbers) > len(self.batches):
            self.batches = np.concatenate((self.batches, np.zeros_like(self.batches)))
        self.batches[out] += 1  # once per word, however often the batch has it
        return out


class Ragged:
    """Lists of numbers, one per word number, in one growing array."""

    def __init__(self) -> None:
        self.values = np.empty(1 << 16, dtype=np.int32)
        self.first = np.empty(1 << 14, dtype=np.int64)
        self.length = np.empty(1 << 14, dtype=np.int64)
        self.used = self.known = 0

    def __len__(self) -> int:
        return self.known

    def add(self, lists: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        self.add_flat(np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(lengths.sum())), lengths)

    def add_flat(self, values: np.ndarray, lengths: np.ndarray) -> None:
        total, to = len(values), self.known + len(lengths)
        while self.used + total > len(self.values):
            self.values = np.concatenate((self.values, np.empty_like(self.values)))
        while to > len(self.first):
            self.first = np.concatenate((self.first, np.empty_like(self.first)))
            self.length = np.concatenate((self.length, np.empty_like(self.length)))
        self.values[self.used:self.used + total] = values
        self.first[self.known:to] = self.used + np.cumsum(lengths) - lengths
        self.length[self.known:to] = lengths
        self.used, self.known = self.used + total, to

    def keep(self, numbers: np.ndarray) -> None:
        values, self.length = self.take(numbers)
        self.first = np.cumsum(self.length) - self.length
        self.values = np.append(values, np.int32(0))
        self.used, self.known = len(values), len(numbers)
        if not self.known:
            self.first, self.length = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after the other, and their lengths."""
        lengths = self.length[numbers]
        begin = np.cumsum(lengths) - lengths
        source = np.repeat(self.first[numbers] - begin, lengths)
        source += np.arange(len(source))
        return self.values[source], lengths
