"""Benchmark passages inside documents, by the q-gram lemma.

Items and documents are normalised alike (lower case, runs of white space as one space). An item is cut into windows of
``WINDOW`` characters every ``STRIDE`` (shorter items are one window), so a document that holds a long part of an item
is found as well. A window of n characters may differ from the text by k = n // 12 edits. By the q-gram lemma a region
within k edits shares at least n - q + 1 - k q of the window's q-grams with it, and all of these lie on diagonals
(position in the text less position in the window) that differ by at most k. Shared q-grams are counted in overlapping
bands of 2(k + 1) diagonals that start every k + 1; bands that reach the bound are verified by banded alignment.

Items longer than ``PART`` are also cut into windows of ``PART`` characters every ``PART_STRIDE``, for documents that hold
less of an item than such a window: every run of ``PART + PART_STRIDE - 1`` (59) characters of an item holds one of them. They
count, with their own spans and edits, only for items that no other window finds in the document.

Items travel to the tasks in blocks of at most ``BLOCK_CHARS`` characters, one pass over the documents per block, so what
a task holds does not grow with the benchmark. Documents are not shuffled.

Defined results: null or empty texts match nothing and null items are no items; an item with fewer than ``LEAST``
characters after normalising is no evidence and is not searched; repeated documents and items return once per row of
documents and per distinct (item_id, text); an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import fresh

WINDOW, STRIDE, LEAST = 96, 48, 24
PART, PART_STRIDE = 48, 12
ERRORS_PER = 12
BLOCK_CHARS = 1_000_000
#: Windows of at least so many characters use q-grams of 8, shorter ones of 4; either way the lemma's bound is positive.
LONG = 48
FIELDS = ("item_id", "first", "last", "edits")
FOUND = "array<struct<item_id:bigint,first:bigint,last:bigint,edits:bigint>>"
TABLE_BITS = 20
_BASE = 0x9E3779B97F4A7C15
#: A text is searched in stretches of so many characters that overlap by more than a region, so memory is bounded.
STRETCH = 1 << 20
#: Shared q-grams counted at a time; a stretch with more is taken in halves.
MOST_HITS = 2_000_000


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points after normalising, and the place in ``text`` each comes from."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lowered; those stay as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    space = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0xA0)
    points[space] = 32
    keep = ~(space & np.concatenate(([False], space[:-1]))) if len(points) else space
    return points[keep], np.flatnonzero(keep)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of every run of q characters, by doubling (q is 4 or 8)."""
    out, width, base = points * np.uint64(_BASE) + np.uint64(1), 1, _BASE
    while width < q:
        if len(out) <= width:
            return out[:0]
        out = out[:-width] * np.uint64(base) + (out[width:] ^ (out[width:] >> np.uint64(29)))
        width, base = 2 * width, base * base % (1 << 64)
    return out


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes ^ (codes >> np.uint64(31))) * np.uint64(_BASE)) >> np.uint64(64 - TABLE_BITS)


def windows_of(length: int, window: int = WINDOW, stride: int = STRIDE) -> list[tuple[int, int]]:
    """(start, length) of an item's windows; the last one ends with the item."""
    if length <= window:
        return [(0, length)]
    starts = list(range(0, length - window, stride)) + [length - window]
    return [(s, window) for s in starts]


def align(window: list[int], text: list[int], budget: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the text region nearest to the window, or None if it needs more than ``budget`` edits.

    Only cells on the diagonals ``low`` to ``high`` (text position less window position) are computed; the region may
    start and end anywhere. Of equally near regions the one that ends first is taken.
    """
    big = budget + 1
    width = high - low + 1
    # cell j of row i stands for i window characters against the text up to position i + low + j
    row = [0 if 0 <= low + j <= len(text) else big for j in range(width)]
    start = [low + j for j in range(width)]
    for i, c in enumerate(window, 1):
        new, begun, least = [big] * width, [0] * width, big
        for j in range(width):
            at = i + low + j
            if at < 0 or at > len(text):
                continue
            best, from_ = big, 0
            if at > 0:
                best, from_ = row[j] + (text[at - 1] != c), start[j]
            if j + 1 < width and row[j + 1] + 1 < best:
                best, from_ = row[j + 1] + 1, start[j + 1]
            if j and new[j - 1] + 1 < best:
                best, from_ = new[j - 1] + 1, begun[j - 1]
            new[j], begun[j] = min(best, big), from_
            least = min(least, new[j])
        if least > budget:
            return None
        row, start = new, begun
    j = min(range(width), key=row.__getitem__)
    return row[j], start[j], len(window) + low + j


def nearest(window: np.ndarray, text: np.ndarray, budget: int, low: int, high: int) -> tuple[int, int, int] | None:
    """``align``, after a look for the window as it stands."""
    body, wanted, at = text.tobytes(), window.tobytes(), -1
    while (at := body.find(wanted, at + 1)) >= 0:
        if at % 4 == 0:
            return 0, at // 4, at // 4 + len(window)
    return align(window.tolist(), text.tolist(), budget, low, high)


class Windows:
    """The windows of one block of items, with tables of their q-grams: long ones, short ones, parts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.points, part = [], [], []
        for item_id, text in items:
            points, _ = normalise(text.strip())
            if len(points) >= LEAST:
                parts = windows_of(len(points), PART, PART_STRIDE) if len(points) > PART else []
                for k, (start, length) in enumerate((whole := windows_of(len(points))) + parts):
                    self.item.append(item_id)
                    self.points.append(points[start:start + length])
                    part.append(k >= len(whole))
        lengths = np.array([len(p) for p in self.points], dtype=np.int64)
        self.step = lengths // ERRORS_PER + 1
        q_of = np.where(lengths >= LONG, 8, 4)
        self.bound = lengths - q_of + 1 - q_of * (lengths // ERRORS_PER)
        self.tables = {}
        for q, of_parts in ((8, False), (4, False), (8, True)):
            chosen = [w for w, p in enumerate(self.points) if part[w] == of_parts and (len(p) >= LONG) == (q == 8)]
            if not chosen:
                continue
            codes = [grams(self.points[w], q) for w in chosen]
            code = np.concatenate(codes)
            window = np.repeat(chosen, [len(c) for c in codes])
            place = np.concatenate([np.arange(len(c)) for c in codes])
            order = np.argsort(code, kind="stable")
            code, window, place = code[order], window[order], place[order]
            seen = np.zeros(1 << TABLE_BITS, dtype=bool)
            seen[_slot(code)] = True
            least = int(self.bound[chosen].min())
            longest = max(len(self.points[w]) for w in chosen)
            code, first, times = np.unique(code, return_index=True, return_counts=True)
            self.tables[q, of_parts] = (seen, code, first, times, window, place, least, longest + longest // ERRORS_PER)

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, first, last, edits) per item found: the span of ``text`` its nearest windows cover."""
        if not text or not self.tables:
            return []
        points, origin = normalise(text)
        found: dict[int, list[tuple[int, int, int]]] = {}
        in_parts: dict[int, list[tuple[int, int, int]]] = {}
        for begin in range(0, len(points), STRETCH):
            end = begin + STRETCH + 4 * WINDOW
            wide = points[begin:end].astype(np.uint64)
            coded: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # two tables have q-grams of 8
            for table in self.tables:
                if table[0] not in coded:
                    codes = grams(wide, table[0])
                    coded[table[0]] = codes, _slot(codes)
                self._stretch(wide, origin[begin:end], table, in_parts if table[1] else found, found, *coded[table[0]])
        out = []
        for item, spans in (in_parts | found).items():
            out.append((item, min(s for s, _, _ in spans), max(e for _, e, _ in spans), min(k for _, _, k in spans)))
        return sorted(out)

    def _stretch(self, points: np.ndarray, origin: np.ndarray, table: tuple[int, bool],
                 found: dict[int, list[tuple[int, int, int]]], whole: dict[int, list[tuple[int, int, int]]],
                 codes: np.ndarray, slots: np.ndarray) -> None:
        q = table[0]
        seen, code, first, repeats, window, place, least, reach = self.tables[table]
        at = np.flatnonzero(seen[slots])
        if len(at) < least:
            return
        # a region within budget has ``least`` shared q-grams inside its length: drop positions without such a run
        dense = np.flatnonzero(at[least - 1:] - at[:len(at) - least + 1] <= reach)
        if not len(dense):
            return
        edge = np.zeros(len(at) + 1, dtype=np.int64)
        edge[dense] += 1
        edge[dense + least] -= 1
        at = at[np.cumsum(edge[:-1]) > 0]
        wanted = codes[at]
        which = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        known = code[which] == wanted
        at, which = at[known], which[known]
        if int(repeats[which].sum()) > MOST_HITS and at[-1] - at[0] > 4 * reach:
            # a repetitive stretch in halves; what lies across the cut lies whole in one of them
            middle = int(at[0] + at[-1]) // 2
            low, high = max(0, middle - reach), min(len(points), middle + reach + q)
            for part in (slice(0, high), slice(low, len(points))):
                own = slice(part.start, max(part.start, part.stop - q + 1))
                self._stretch(points[part], origin[part], table, found, whole, codes[own], slots[own])
            return
        left, times = first[which], repeats[which]
        hit = np.repeat(left - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        self._bands(points, origin, window[hit], np.repeat(at, times) - place[hit], place[hit], found,
                    whole if table[1] else {})

    def _bands(self, points: np.ndarray, origin: np.ndarray, w: np.ndarray, diagonal: np.ndarray, place: np.ndarray,
               found: dict[int, list[tuple[int, int, int]]], settled: dict[int, list[tuple[int, int, int]]]) -> None:
        # a window with fewer shared q-grams in all has too few in every band
        enough = np.bincount(w, minlength=len(self.bound))[w] >= self.bound[w]
        if not enough.any():
            return
        w, diagonal, place = w[enough], diagonal[enough], place[enough]
        band = np.floor_divide(diagonal, self.step[w])  # bands b and b - 1 hold this diagonal
        least = int(band.min()) - 1
        bands = int(band.max()) - least + 1
        # (window, band, place) in one number: a q-gram of the window counts once in a band, however often it recurs
        key = (w * bands + (band - least)) * WINDOW + place
        key = np.sort(np.concatenate((key, key - WINDOW)))
        cell = key[np.concatenate(([True], key[1:] != key[:-1]))] // WINDOW
        new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        counts = np.diff(np.append(new, len(cell)))
        cell = cell[new]
        done = -1
        for c in cell[counts >= self.bound[cell // bands]].tolist():
            if c == done:  # the band before it shares half its diagonals and has settled the window there
                continue
            index, b = c // bands, c % bands + least
            if self.item[index] in settled:
                continue
            n = len(self.points[index])
            k = n // ERRORS_PER
            low, high = b * (k + 1) - k, (b + 2) * (k + 1) - 1 + k  # an alignment leaves the band by at most k
            begin, end = max(0, low), min(len(points), high + n)
            best = nearest(self.points[index], points[begin:end].astype("<u4"), k, low - begin, high - begin)
            if best is not None:
                edits, first, last = best
                done = c + 1
                first, last = max(first, 0) + begin, last + begin
                if last > first:
                    found.setdefault(self.item[index], []).append(
                        (int(origin[first]), int(origin[last - 1]) + 1, edits))


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    block, chars = [], 0
    for row in items.filter("item_id is not null and text is not null").distinct().toLocalIterator():
        if block and chars + len(row["text"]) > block_chars:
            yield block
            block, chars = [], 0
        block.append((row["item_id"], row["text"]))
        chars += len(row["text"])
    if block:
        yield block


def _finder(block: list[tuple[int, str]]):
    """A column function: the items of the block found in a text."""
    schema = pa.list_(pa.struct([(field, pa.int64()) for field in FIELDS]))

    @F.arrow_udf(FOUND)
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = Windows(sorted(block))
        for batch in texts:
            yield pa.array([[dict(zip(FIELDS, f)) for f in windows.search(t.as_py())] for t in batch], type=schema)

    return search


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: the array of (item_id, first, last, edits) found.

    ``first`` and ``last`` bound the span in the document's own characters.
    """
    name = fresh(docs, "leaks")
    parts = [_finder(b)(F.col(text)) for b in _blocks(benchmark, item_id, item_text, block_chars)]
    empty = F.array().cast(FOUND)
    return docs.withColumn(name, reduce(lambda a, b: F.concat(a, b), parts, empty)), name


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options: object) -> DataFrame:
    """(doc_id, item_id, first, last, edits), one row per document and item found in it."""
    marked, name = find_leaks(docs, benchmark, **options)
    found = marked.select(F.col(doc_id).alias("doc_id"), F.explode(name).alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.first", "leak.last", "leak.edits")


def clean(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents in which no item is found, with their own columns."""
    marked, name = find_leaks(docs, benchmark, **options)
    return marked.filter(F.size(name) == 0).drop(name)
