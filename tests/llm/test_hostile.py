"""Searches against all positions, and texts made to be slow."""

from __future__ import annotations

import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sheafwork.llm import decontaminate, licenses, sharding


def nearest_edits(window, text):
    """Fewest edits between the window and any part of the text: the whole table."""
    row = list(range(len(window) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, w in enumerate(window):
            new.append(min(row[j] + (w != c), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_filter_loses_no_window_within_its_budget():
    r = random.Random(5)
    words = ["red", "stone", "over", "the", "a", "mill", "grew", "quiet", "lamp"]
    items = [(i, " ".join(r.choices(words, k=r.choice([6, 10, 30])))) for i in range(12)]
    windows = decontaminate.Windows(items)
    points = {i: [p.tolist() for p, o in zip(windows.points, windows.item) if o == i] for i, _ in items}
    for _ in range(12):
        item = r.choice(items)[1]
        cut = r.randrange(max(1, len(item) - 60))
        part = list(item[cut:cut + r.choice([30, 60, 100])])
        for _ in range(r.choice([0, 2, 5, 9])):
            at = r.randrange(len(part))
            part[at:at + r.choice([0, 1])] = r.choice(["x", "", "yz"])
        text = " ".join(r.choices(words, k=15)) + " " + "".join(part) + " " + " ".join(r.choices(words, k=15))
        read = decontaminate.normalise(text)[0].tolist()
        want = {i for i in points if any(nearest_edits(w, read) <= len(w) // decontaminate.ERRORS_PER for w in points[i])}
        assert {f[0] for f in windows.search(text)} == want


def test_repetitive_text_is_counted_in_bounded_memory():
    windows = decontaminate.Windows([(1, "ha " * 31 + "the end of it"), (2, "a plain and quiet sentence about the river bank")])
    text = "ha " * 12_000 + "a plain and quiet sentence about the river bank"
    tracemalloc.start()
    found = windows.search(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 2 in {f[0] for f in found} and peak < 600 << 20


def test_many_notices_of_one_text_take_time_in_proportion():
    known = licenses.Templates()
    notice = licenses.TEMPLATES[0][1]
    started = time.time()
    (_, notices), = known.scan(pa.array([(notice + "\n") * 20_000 if len(notice) < 400 else (notice + "\n") * 2_000]))
    assert time.time() - started < 60 and len(notices) >= 2_000


def test_kept_notices_are_those_of_all_comparisons():
    r = random.Random(6)
    for _ in range(60):
        entries = [(r.random() < 0.5, r.choice([0.8, 0.9, 1.0]), n := r.choice([10, 30]), -r.choice([1, 2]), a := r.randrange(120),
                    a + n + r.choice([-4, 0, 5])) for _ in range(r.randrange(25))]
        kept = []
        for e in sorted(entries, key=lambda e: e[:4], reverse=True):
            if not any(e[3] == t and 2 * (min(e[5], z) - max(e[4], a)) > min(e[5] - e[4], z - a) for *_, t, a, z in kept):
                kept.append(e)
        assert licenses.Templates._apart(entries) == kept


def test_interleaving_is_that_of_one_sorted_list(spark):
    """Places by the definition: fractional ranks within a source, sorted, cut into equal parts."""
    r = random.Random(7)
    data = [(i, f"text {r.randrange(900)}", r.choice(["a", "a", "a", "b", None])) for i in range(700)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    rows = df.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id", F.crc32(F.col("text").cast("binary"))).alias("h"),
                     F.pmod(F.xxhash64(F.lit(17), "source"), F.lit(1 << 20)).alias("phase")).collect()
    of = Counter(x["source"] for x in rows)
    placed = []
    for source in of:
        own = sorted((x for x in rows if x["source"] == source), key=lambda x: (np.uint64(x["h"] % 2**64) >> np.uint64(11), x["h"], x["doc_id"]))
        placed += [((rank - x["phase"] / 2**20) / of[source], source is not None, source or "", x["h"], x["doc_id"])
                   for rank, x in enumerate(own, 1)]
    order = [p[-1] for p in sorted(placed)]
    for buckets in (500, 20):
        found = sharding.interleave(df, shards=24, rows_per_bucket=buckets).collect()
        assert [x["doc_id"] for x in sorted(found, key=lambda x: (x["shard"], x["slot"]))] == order
