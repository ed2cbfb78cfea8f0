"""Functions for SQL users: string ratio, stems, embeddings and field rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, datetime

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sheafwork.functions import fields as fx
from sheafwork.functions.text import WHITESPACE
from sheafwork.functions.tokens import stem
from sheafwork.operators.fusion import similarity_ratio


def _day(raw: str, kind: int) -> date | None:
    try:
        if kind < 3:
            return datetime.strptime(raw, fx.FORMATS[kind]).date()
        day, month, year = re.fullmatch(fx.SPANISH_LONG, raw).groups()
        return date(int(year), fx.MONTHS.index(month.lower()) + 1, int(day))
    except ValueError:
        return None


def _amount(digits: str, kind: str) -> float:
    if kind == "eu":
        digits = digits.replace(".", "")
    elif kind == "us":
        digits = digits.replace(",", "")
    return float(digits.replace(",", "."))


def _best(lines: list[str], patterns: list[tuple[str, object]], read: Callable, sure: Callable) -> tuple | None:
    """(value, confidence, raw) of the first candidate with the highest confidence."""
    found = [
        (round(sure(line.lower(), i), 2), value, match.group())
        for i, line in enumerate(lines) for pattern, kind in patterns for match in re.finditer(pattern, line)
        if (value := read(match, kind)) is not None
    ]
    if not found:
        return None
    confidence, value, raw = max(found, key=lambda f: f[0])
    return str(value), confidence, raw.strip(WHITESPACE)


class ExtractFields:
    """Rows (field, value, confidence, raw) of one text; the rules of ``extract_fields`` row by row.

    For many texts use the column expression, which stays in the JVM.
    """

    def eval(self, text: str) -> Iterator[tuple]:
        if text is None:
            return
        lines = text.split("\n")
        n = len(lines)
        dates = [(p, k) for k, p in enumerate((fx.ISO_DATE, fx.DAY_FIRST, fx.MONTH_FIRST, fx.SPANISH_LONG))]
        has = lambda line, words: any(w in line for w in words)
        got = {
            "date": _best(lines, dates, lambda m, k: _day(m.group(), k), lambda line, i: 0.5 + 0.3 * has(
                line, fx.DATE_WORDS) + 0.2 * (i < n * 0.3)),
            "total": _best(lines, list(fx.AMOUNT_PATTERNS), lambda m, k: _amount(m.group(1), k), lambda line, i: (
                0.4 + 0.4 * has(line, fx.TOTAL_WORDS) + 0.2 * (i > n * 0.5))),
            "vendor": self.vendor([x.strip(WHITESPACE) for x in lines[:max(1, int(n * 0.2))]], has),
        }
        for field, row in got.items():
            if row:
                yield (field, *row)

    @staticmethod
    def vendor(top: list[str], has: Callable) -> tuple | None:
        rated = []
        for i, line in enumerate(top):
            worded = has(line.lower(), fx.VENDOR_WORDS)
            if not line or re.match(fx.NUMBERS_ONLY, line):
                continue
            if len(line) >= 3 and (line.isupper() or worded or i == 0):
                rated.append((0, i, line, min(round(0.6 + 0.2 * line.isupper() + 0.2 * worded, 2), 1.0)))
            elif len(line) > 5:
                rated.append((1, i, line, 0.4))
        if not rated:
            return None
        _, _, line, confidence = min(rated)
        return line, confidence, line


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable:
    """A column function text → embedding; ``load`` runs once per Python worker and returns the model's encode."""
    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(list(texts.fillna(""))), dtype="float32")), index=texts.index)

    return encode


def register_functions(spark: SparkSession, load_encoder: Callable | None = None) -> None:
    """Make ``similarity_ratio``, ``stem``, ``extract_fields`` and, with a model, ``embed_text`` callable from SQL.

    The encoder is not called ``encode``: Spark has a function of that name.
    """
    spark.udf.register("similarity_ratio", similarity_ratio)
    spark.udf.register("stem", stem)
    table = F.udtf(ExtractFields, returnType="field string, value string, confidence double, raw string",
                   useArrow=True)
    spark.udtf.register("extract_fields", table)
    if load_encoder is not None:
        spark.udf.register("embed_text", encoder(load_encoder))
