from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sheafwork.operators import learning
from sheafwork.functions.tables import register_functions


def corpus(spark, n, start=0):
    words = {"Invoice": "factura importe total pago", "Letter": "estimado saludo carta firma", "Plan": "escala plano cocina"}
    rng = np.random.RandomState(start)
    rows = []
    for i in range(n):
        kind = list(words)[i % 3]
        rows.append((start + i, kind, " ".join(rng.choice(words[kind].split() + ["de", "la", "uno"], 12))))
    return spark.createDataFrame(rows, "id_doc bigint, type string, text string")


def test_classifier_on_held_out_texts(spark):
    model = learning.train_text_classifier(corpus(spark, 60).select("text", "type"))
    held = corpus(spark, 30, 1000).withColumnRenamed("type", "truth")
    got = learning.predict_type(held, model).collect()
    assert np.mean([r["type"] == r["truth"] for r in got]) > 0.9
    assert {r["tag"] for r in got} == {"AI"}


def test_too_few_rows(spark):
    with pytest.raises(ValueError, match="not enough data"):
        learning.train_text_classifier(corpus(spark, 4).select("text", "type"))


def test_prediction_without_model_or_text(spark):
    texts = spark.createDataFrame([(1, "una factura"), (2, None)], "id_doc bigint, text string")
    got = {r["id_doc"]: (r["type"], r["tag"]) for r in learning.predict_type(texts).collect()}
    assert got == {1: ("Invoice", "factura"), 2: ("Unknown", None)}


def test_palette_finds_separate_colours(spark):
    base = {(250, 10, 10): 300, (10, 250, 10): 200, (10, 10, 250): 100}
    rows = [(7, *(np.array(c) + d % 2)) for c, n in base.items() for d in range(n)]
    pixels = spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "r", "g", "b"]))
    for bits in (6, 8):
        got = learning.color_palette(pixels, 3, bits).orderBy("rank").collect()
        assert [r["hex"] for r in got] == ["#fa0a0a", "#0afa0a", "#0a0afa"]
        assert [round(r["share"], 3) for r in got] == [0.5, 0.333, 0.167]
    one = learning.color_palette(pixels.filter("r > 200"), 5, 8).collect()
    assert len(one) == 2


def test_sql_functions(spark):
    register_functions(spark)
    assert spark.sql("select similarity_ratio('abcd', 'abcx') as r").first()["r"] == 0.75
    assert spark.sql("select stem('running') as s").first()["s"] == "run"
    rows = spark.sql("select field, value, raw from extract_fields('ACME\\nFecha: 2024-01-15\\nTotal: 12,50 €')").collect()
    assert {r["field"]: r["value"] for r in rows} == {"date": "2024-01-15", "total": "12.5", "vendor": "ACME"}
    register_functions(spark, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert spark.sql("select embed_text('abc') as e").first()["e"] == [3.0, 1.0]
