"""What a search for benchmark items computes, on texts that share words with them and hold none."""

from __future__ import annotations

import random

from sheafwork.llm import decontaminate


def test_each_code_once_and_no_bands_for_stray_grams(monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(60)]
    items = [(1, " ".join(r.choices(words, k=40))), (2, " ".join(r.choices(words, k=9))[:40])]
    windows = decontaminate.Windows(items)
    assert len(windows.tables) == 3
    widths, sorted_ = [], []
    grams, sort = decontaminate.grams, decontaminate.np.sort
    monkeypatch.setattr(decontaminate, "grams", lambda points, q: widths.append(q) or grams(points, q))
    monkeypatch.setattr(decontaminate.np, "sort", lambda x, *a, **b: sorted_.append(len(x)) or sort(x, *a, **b))
    # every second word of the long item: dense shared q-grams of 4, but no window has enough of them
    stray = " ".join(f"{w} zz" for w in items[1][1].split())
    assert windows.search(stray) == []
    assert sorted(widths) == [4, 8] and sorted_ == []
    held = f"{stray} {items[0][1]} {stray} {items[1][1]}"
    assert [(i, k) for i, _, _, k in windows.search(held)] == [(1, 0), (2, 0)] and sorted_
