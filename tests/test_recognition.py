from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import decisions, fusion, layout, linking


@pytest.mark.parametrize("a, ca, b, cb, text, confidence", [
    ("primary", 0.8, "secondary", 0.9, "primary", 0.8),
    ("primary", 0.4, "secondary", 0.7, "secondary", 0.7),
    ("subtotal", 0.55, "Factura 2024-01", 0.56, "Factura 2024-01", 0.56),
    ("", 0.9, "b", 0.1, "b", 0.1),
    (None, None, None, None, "", 0.0),
    ("a b c", 0.5, "abcd", 0.5, "abcd", 0.5),
    ("same", 0.5, "same", 0.5, "same", 0.5),
])
def test_vote(spark, a, ca, b, cb, text, confidence):
    frame = spark.createDataFrame([(a, ca, b, cb)], "a string, ca double, b string, cb double")
    got = frame.select(fusion.fuse_confidence_vote(*[F.col(c) for c in ("a", "ca", "b", "cb")]).alias("f")).first()["f"]
    assert (got["text"], got["confidence"]) == (text, confidence)


def test_fuse_similarity_against_model(spark):
    rng = random.Random(5)
    words = ["", "factura", "factvra", "total 12,3", "totol 12,3", "x", "the quick brown fox", "the quick brawn fox"]
    rows = [(i, rng.choice(words), rng.choice([0.0, 0.4, 0.9]), rng.choice(words), rng.choice([0.0, 0.5]))
            for i in range(300)]
    frame = spark.createDataFrame(rows, "block_id int, text_a string, conf_a double, text_b string, conf_b double")
    got = {r["block_id"]: (r["fused"]["text"], round(r["fused"]["confidence"], 9))
           for r in fusion.fuse_similarity(frame, "one", "two", ("TWO", "one")).collect()}
    for i, a, ca, b, cb in rows:
        if a and not b:
            want = (a, ca)
        elif b and not a:
            want = (b, cb)
        elif not a:
            want = ("", 0.0)
        else:
            ratio = SequenceMatcher(None, a, b).ratio()
            if ratio >= 0.82:
                want = (a if len(a) >= len(b) else b, (ca + cb) / 2 if ca or cb else ratio)
            else:
                want = (b, cb)
        assert got[i] == (want[0], round(want[1], 9))


def test_vendors_against_model(spark):
    rng = random.Random(9)
    table = linking.alias_table(linking.VENDORS)
    letters = "abcdefilmnorstwxyz é."
    names = [*table, "Ikea Iberica", " AMAZON ", "leroy-merlin", "", None]
    for alias in list(table) * 12:
        at = rng.randrange(len(alias) + 1)
        names.append(alias[:at] + rng.choice(letters) + alias[at + rng.randint(0, 1):])

    def model(name):
        if not name:
            return name
        low = name.strip().lower()
        if low in table:
            return table[low]
        best, found = 0.0, None
        for alias, canonical in table.items():
            ratio = SequenceMatcher(None, low, alias).ratio()
            if ratio > best:
                best, found = ratio, canonical
        return found if best > 0.85 else name

    frame = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    for row in frame.select("id", linking.match_vendor_fuzzy(F.col("name")).alias("v")).collect():
        assert row["v"] == model(names[row["id"]]), names[row["id"]]


def test_recheck(spark):
    blocks = spark.createDataFrame([(0, 0.3), (1, 0.9)], "block_id int, confidence double")
    assert [r["block_id"] for r in fusion.recheck_selection(blocks, 0.5).collect()] == [0]
    assert fusion.recheck_selection(blocks, 0.0).count() == 0


def test_table_grid(spark):
    cells = [(1, 0, 0, 1, 1, "A", 0), (1, 0, 1, 1, 1, "B", 1), (1, 1, 0, 1, 1, "1", 2), (1, 1, 1, 1, 1, "2", 3),
             (2, 0, 0, 2, 1, "tall", 0), (2, 0, 0, 1, 2, "wide", 1)]
    frame = spark.createDataFrame(cells, "doc_id int, row_no int, col_no int, row_span int, col_span int, txt string, seq int")
    got = {(r["doc_id"], r["r"], r["c"]): r["text"] for r in layout.rebuild_table_grid(frame, "doc_id").collect()}
    assert [got[1, r, c] for r in (0, 1) for c in (0, 1)] == ["A", "B", "1", "2"]
    assert [got[2, r, c] for r in (0, 1) for c in (0, 1)] == ["tall wide", "wide", "tall", ""]


REQUEST = "native_pdf boolean, confidence double, low_blocks int, legible boolean, handwriting boolean, " \
          "graphics boolean, previous_type string"


@pytest.mark.parametrize("request_row, activate, kind", [
    ((False, 0.95, 0, True, False, False, "factura"), False, None),
    ((False, 0.8, 0, True, True, False, "nota"), True, "manuscrito"),
    ((False, 0.30, 9, False, False, False, "otro"), True, "recuperacion_ruido"),
    ((True, 0.99, 0, True, True, False, "factura"), False, None),
    ((None, None, None, None, None, None, None), False, None),
    ((False, 0.6, 0, True, False, True, "otro"), True, "mixto"),
    ((False, 0.99, 0, True, False, False, "PLANO"), True, "visual_complex"),
])
def test_routing(spark, request_row, activate, kind):
    frame = spark.createDataFrame([request_row], REQUEST)
    got = decisions.route_interpretation(frame).first()["decision"]
    assert (got["activate"], got["kind"]) == (activate, kind)
