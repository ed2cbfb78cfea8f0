"""Plain-Python models the operators are compared with."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    w = words(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 3000 else None
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(inside) if inside is not None else len(w))


def components(docs: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, int]:
    sets = defaultdict(list)
    for i, text in docs:
        w = words(text, lower=True)
        k = min(width, len(w))
        sets[i].append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set())
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and find(x) != find(y) and any(
                    a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                root[max(find(x), find(y))] = min(find(x), find(y))
    return {i: find(i) for i in ids}


def backoff(train: list[str | None], discount: float) -> "Backoff":
    return Backoff([words(t, lower=True) + [b"\n"] for t in train], discount)


class Backoff:
    def __init__(self, texts: list[list[bytes]], discount: float):
        self.c, self.pairs, self.context, self.after = Counter(), Counter(), Counter(), defaultdict(set)
        for t in texts:
            self.c.update(t)
            for u, w in zip([b" ", *t], t):
                self.pairs[u, w] += 1
                self.context[u] += 1
                self.after[u].add(w)
        self.n, self.v, self.d = sum(self.c.values()), len(self.c), discount
        once, twice = sum(x == 1 for x in self.c.values()), sum(x == 2 for x in self.c.values())
        self.d1 = min(max(once / (once + 2 * twice), 0.1), 0.9) if once + twice else 0.5

    def root(self, w: bytes) -> float:
        return (self.c[w] - self.d1 if self.c[w] else self.d1 * self.v) / self.n

    def arc(self, u: bytes, w: bytes) -> float:
        if not self.context[u]:
            return self.root(w)
        return (max(self.pairs[u, w] - self.d, 0) + self.d * len(self.after[u]) * self.root(w)) / self.context[u]

    def scores(self, text: str | None) -> tuple[int, int, float, float]:
        t = words(text, lower=True) + [b"\n"]
        base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in t)
        return len(t), sum(self.c[w] > 0 for w in t), base, sum(
            math.log10(self.arc(u, w)) for u, w in zip([b" ", *t], t))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def edit_distance_inside(window: str, text: str) -> int:
    """The least edits that turn some substring of ``text`` into ``window``."""
    row = [0] * (len(text) + 1)
    for c in window:
        new = [row[0] + 1]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)
