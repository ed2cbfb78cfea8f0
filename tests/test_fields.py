from __future__ import annotations

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import fields as fx
from sheafwork.operators import fields as ops

INVOICE = "Factura 2024-001\nCliente: Ejemplo S.A.\nImporte: 123,45 EUR\nFecha: 2024-01-15"


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text")).alias("f")).first()["f"]


def test_invoice_text(spark):
    fields = one(spark, INVOICE, fx.extract_fields)
    assert (fields["date"]["value"], fields["date"]["confidence"]) == ("2024-01-15", 0.8)
    assert (fields["total"]["value"], fields["total"]["currency"]) == (123.45, "EUR")
    assert fields["vendor"]["raw"] == "Factura 2024-001"


@pytest.mark.parametrize("text, value, kind", [
    ("31/02/2026", None, None),
    ("01/25/2026", "2026-01-25", "%m/%d/%Y"),
    ("5/1/2026", "2026-01-05", "%d/%m/%Y"),
    ("05-01-2026", None, None),
    ("el 2 de enero de 2026", "2026-01-02", "es_long"),
    ("el 2 DE Marzo de 2026", "2026-03-02", "es_long"),
    ("2 de brumario de 2026", None, None),
    ("2026-13-01", None, None),
    ("12/12/26", None, None),
    ("", None, None),
])
def test_dates(spark, text, value, kind):
    got = one(spark, text, fx.extract_date)
    assert (got and got["value"], got and got["format"]) == (value, kind)


@pytest.mark.parametrize("text, value, currency", [
    ("1.234,56", 234.56, "EUR"),
    ("1.234,56 €", 1234.56, "EUR"),
    ("€1.234,56", 1234.56, "EUR"),
    ("$1,234.56", 1.23, "USD"),  # the European pattern comes first and takes "$1,23"
    ("1,234.56$", 1234.56, "USD"),
    ("£ 9.50", 9.5, "GBP"),
    ("a 123.45 b", 123.45, "EUR"),
    ("1234", None, None),
])
def test_totals(spark, text, value, currency):
    got = one(spark, text, fx.extract_total)
    assert (got and got["value"], got and got["currency"]) == (value, currency)


def test_null_text_gives_nothing(spark):
    frame = spark.createDataFrame([(None,)], "text string")
    row = frame.select(fx.extract_fields(F.col("text")).alias("f")).first()["f"]
    assert row["date"] is None and row["total"] is None and row["vendor"] is None


def model_date(text: str):
    """The rule in plain Python: best confidence, earliest on ties."""
    best, top = None, 0.0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        for n, (pattern, form) in enumerate([
            (r"\b\d{4}-\d{2}-\d{2}\b", "%Y-%m-%d"), (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b", "%d/%m/%Y"),
            (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "%m/%d/%Y"),
        ]):
            for match in re.findall(pattern, line):
                try:
                    day = datetime.strptime(match, form)
                except ValueError:
                    continue
                sure = 0.5 + 0.3 * any(w in line.lower() for w in ("fecha", "date", "emis", "issued"))
                sure += 0.2 * (i < len(lines) * 0.3)
                if round(sure, 2) > top:
                    best, top = (day.strftime("%Y-%m-%d"), round(sure, 2), match), round(sure, 2)
    return best


def test_dates_against_model(spark):
    rng = random.Random(7)
    pieces = ["fecha", "total", "x", "12/03/2024", "2024-05-06", "13/13/2024", "01/25/2026", "1-2-2024", "99/1/2020",
              "2024-02-30", "31/12/1999", "issued", "7/8/22"]
    texts = ["\n".join(" ".join(rng.choices(pieces, k=rng.randint(0, 4))) for _ in range(rng.randint(1, 9)))
             for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in frame.select("id", fx.extract_date(F.col("text")).alias("f")).collect():
        got = row["f"] and (row["f"]["value"], row["f"]["confidence"], row["f"]["raw"])
        assert got == model_date(texts[row["id"]]), texts[row["id"]]


def model_vendor(text: str):
    lines = text.split("\n")
    top = lines[:max(1, int(len(lines) * 0.2))]
    words = ("proveedor", "vendor", "empresa", "company", "razón social")
    for i, line in enumerate(top):
        line = line.strip()
        if len(line) < 3 or re.match(r"^[\d\s\-./]+$", line):
            continue
        worded = any(w in line.lower() for w in words)
        if line.isupper() or worded or i == 0:
            return line, round(min(0.6 + 0.2 * line.isupper() + 0.2 * worded, 1.0), 2)
    for line in map(str.strip, top):
        if len(line) > 5 and not re.match(r"^[\d\s\-./]+$", line):
            return line, 0.4
    return None


def test_vendors_against_model(spark):
    rng = random.Random(11)
    pieces = ["ACME SL", "12-34", "", "  ", "ab", "La Empresa buena", "vendor X", "hola mundo", "1.2/3", "Ñandú", "ÁRBOL Nº"]
    texts = ["\n".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in frame.select("id", fx.extract_vendor(F.col("text")).alias("f")).collect():
        got = row["f"] and (row["f"]["value"], row["f"]["confidence"])
        assert got == model_vendor(texts[row["id"]]), repr(texts[row["id"]])


@pytest.mark.parametrize("name, clean", [
    ("ACME  S.L.", "Acme"), ("Muebles X, S.A.", "Muebles X,"), ("Foo Ltd.", "Foo"), ("O'NEIL GMBH", "O'Neil"), ("", ""),
])
def test_vendor_names(spark, name, clean):
    assert one(spark, name, ops.normalise_vendor) == clean


def test_amounts_of_one_customer_with_most_rows(spark):
    """A key that owns nearly all rows gives the same codes as statistics over its whole history."""
    from statistics import mean, stdev

    rng = random.Random(3)
    rows = [(i, 1 if i % 10 else i, float(rng.choice([100, 250, 999, 12000, 40, 5000]) + rng.choice([0, 0.5])))
            for i in range(1500)]
    frame = spark.createDataFrame(rows, "n bigint, k bigint, a double")
    got = {r["n"]: r["anomalies"] for r in ops.amount_anomalies(frame, "k", "n", "a", buckets=16).collect()}
    seen: dict[int, list[float]] = {}
    for n, k, a in rows:
        past, codes = seen.setdefault(k, []), []
        if len(past) >= 5:
            if stdev(past) > 0 and abs(a - mean(past)) > 3 * stdev(past):
                codes.append("unusual_amount")
            if a > 10 * mean(past):
                codes.append("very_large_amount")
            if a == round(a, -2) and a >= 1000:
                codes.append("suspicious_round_number")
        assert got[n] == codes
        past.append(a)


def test_equal_and_nearly_equal_amounts(spark):
    """Equal amounts have no deviation, so nothing is unusual; cents on millions still have one."""
    flat = [(i, 1, 9.99) for i in range(300)] + [(300, 1, 10.0)]
    cents = [(1000 + i, 2, 5_000_000.0 + 0.01 * (i % 3)) for i in range(300)] + [(1300, 2, 5_000_000.06)]
    frame = spark.createDataFrame(flat + cents, "n bigint, k bigint, a double")
    got = {r["n"]: r["anomalies"] for r in ops.amount_anomalies(frame, "k", "n", "a", buckets=8).collect()}
    assert got[300] == [] and got[1300] == ["unusual_amount"]
    assert not any(got[i] for i in range(300))


def test_table_function_follows_the_same_rules(spark):
    from sheafwork.functions.tables import register_functions

    register_functions(spark)
    rng = random.Random(13)
    pieces = ["ACME SA", "Fecha: 12/03/2024", "total 1.234,56 €", "", "2 de mayo de 2020", "$9.99", "01/25/2026", "123.45",
              "La Empresa", "2024-02-30", "  x ", "importe 5,00"]
    texts = ["\n".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    frame.createOrReplaceTempView("texts_for_udtf")
    rows = spark.sql("select id, f.* from texts_for_udtf, lateral extract_fields(text) f").collect()
    got = {(r["id"], r["field"]): (r["value"], r["confidence"], r["raw"]) for r in rows}
    want = {}
    for row in frame.select("id", fx.extract_fields(F.col("text")).alias("f")).collect():
        for field in ("date", "total", "vendor"):
            f = row["f"][field]
            if f is not None:
                want[row["id"], field] = (str(f["value"]), f["confidence"], f["raw"])
    assert got == want
