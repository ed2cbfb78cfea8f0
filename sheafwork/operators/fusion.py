"""Choosing between the outputs of several recognition engines.

Input is one row per block with both engines' text and confidence side by side; ``pair_engines`` makes such rows from
one row per engine. Every decision is an expression over its own row.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sheafwork.functions.text import bind, strip

MIN_CONFIDENCE = 0.6
MARGIN = 0.05
TIE = 0.05
MIN_SIMILARITY = 0.82
# What makes a text look like part of an invoice.
PATTERNS = (
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?\b",
    r"(?i)\b[A-Z]\d{7}[A-Z]\b",
    r"(?i)\b(?:invoice|factura)[- ]?\d+\b",
)
TEXT_BLOCK_TYPES = ("text", "title", "other")


def pattern_score(text: Column) -> Column:
    """How many of date, amount, tax id and invoice number occur (0–4)."""
    score = F.lit(0)
    for pattern in PATTERNS:
        score = score + text.rlike(pattern).cast("int")
    return score


def alnum_score(text: Column) -> Column:
    """Number of ASCII letters and digits."""
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def pair_engines(results: DataFrame, primary: str, secondary: str, keys: Sequence[str] = ("doc_id", "block_id")
                 ) -> DataFrame:
    """One row per engine → one row per block with text_a, conf_a, text_b, conf_b."""
    def pick(engine: str, column: str) -> Column:
        return F.max(F.when(F.col("engine") == engine, F.col(column)))

    return results.groupBy(*keys).agg(
        pick(primary, "text").alias("text_a"), pick(primary, "confidence").alias("conf_a"),
        pick(secondary, "text").alias("text_b"), pick(secondary, "confidence").alias("conf_b"),
    )


def _result(text: Column, confidence: Column) -> Column:
    return F.struct(text.alias("text"), confidence.alias("confidence"))


def _fuse(text_a: Column, conf_a: Column, text_b: Column, conf_b: Column, both: Column) -> Column:
    """Shared frame: an empty side loses, two empty sides give nothing, otherwise ``both`` decides."""
    return F.when((text_a != "") & (text_b == ""), _result(text_a, conf_a)).when(
        (text_b != "") & (text_a == ""), _result(text_b, conf_b)).when(
        (text_a == "") & (text_b == ""), _result(F.lit(""), F.lit(0.0))).otherwise(both)


def _clean(text_a: Column, conf_a: Column, text_b: Column, conf_b: Column) -> tuple[Column, Column, Column, Column]:
    empty, zero = F.lit(""), F.lit(0.0)
    return (strip(F.coalesce(text_a, empty)), F.coalesce(conf_a.cast("double"), zero),
            strip(F.coalesce(text_b, empty)), F.coalesce(conf_b.cast("double"), zero))


def _higher(a: Column, ca: Column, b: Column, cb: Column) -> Column:
    return F.when(ca >= cb, _result(a, ca)).otherwise(_result(b, cb))


def fuse_confidence_vote(text_a: Column, conf_a: Column, text_b: Column, conf_b: Column,
                         minimum: float = MIN_CONFIDENCE, margin: float = MARGIN) -> Column:
    """struct(text, confidence).

    A confident primary wins; a clearly more confident secondary wins; then the text with more invoice patterns, or,
    for near-equal confidences, with more letters and digits; at last the higher confidence.
    """
    a, ca, b, cb = _clean(text_a, conf_a, text_b, conf_b)

    def decide(s: Column) -> Column:
        more = F.when(s["pa"] != s["pb"], F.when(s["pa"] > s["pb"], 1).otherwise(2)).when(
            (F.abs(ca - cb) <= TIE) & (s["na"] != s["nb"]), F.when(s["na"] > s["nb"], 1).otherwise(2)).otherwise(0)
        top = F.greatest(ca, cb)
        return F.when(more == 1, _result(a, top)).when(more == 2, _result(b, top)).otherwise(_higher(a, ca, b, cb))

    scores = F.struct(pattern_score(a).alias("pa"), pattern_score(b).alias("pb"), alnum_score(a).alias("na"),
                      alnum_score(b).alias("nb"))
    both = F.when(ca >= minimum, _result(a, ca)).when(cb >= ca + margin, _result(b, cb)).otherwise(bind(scores, decide))
    return _fuse(a, ca, b, cb, both)


def fuse_cascade(text_a: Column, conf_a: Column, text_b: Column, conf_b: Column,
                 minimum: float = MIN_CONFIDENCE) -> Column:
    """struct(text, confidence): the primary when confident enough, else the secondary."""
    a, ca, b, cb = _clean(text_a, conf_a, text_b, conf_b)
    return _fuse(a, ca, b, cb, F.when(ca >= minimum, _result(a, ca)).otherwise(_result(b, cb)))


@F.pandas_udf(DoubleType())
def similarity_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-subsequence ratio of two strings, null when either is."""
    def ratio(a: str | None, b: str | None) -> float | None:
        return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()

    return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def bounded_ratio(a: Column, b: Column, minimum: float) -> Column:
    """The ratio where it can reach ``minimum``, else null.

    Equal strings are 1 without Python, and pairs whose lengths or edit distance already rule the minimum out are
    skipped, so only the few undecided pairs cross to a Python worker.
    """
    total = F.length(a) + F.length(b)
    by_length = 2 * F.least(F.length(a), F.length(b)) / total >= minimum
    # the distance is only followed as far as it leaves the minimum within reach; beyond that it is -1
    farthest = F.floor(total * (1 - minimum) + 1e-9).cast("int")
    near = F.call_function("levenshtein", a, b, farthest) >= 0
    reachable = (a != b) & F.when(by_length, near).otherwise(False)
    return F.when(a == b, 1.0).otherwise(similarity_ratio(F.when(reachable, a), F.when(reachable, b)))


def fuse_similarity(blocks: DataFrame, primary: str, secondary: str, priority: Sequence[str],
                    minimum: float = MIN_SIMILARITY) -> DataFrame:
    """Add ``fused``: alike texts give the longer one and the mean confidence, others follow engine priority."""
    a, ca, b, cb = _clean(F.col("text_a"), F.col("conf_a"), F.col("text_b"), F.col("conf_b"))
    cleaned = blocks.withColumns({"_a": a, "_ca": ca, "_b": b, "_cb": cb})
    a, ca, b, cb = (F.col(c) for c in ("_a", "_ca", "_b", "_cb"))
    ratio = bounded_ratio(F.when((a != "") & (b != ""), a), F.when((a != "") & (b != ""), b), minimum)
    rated = cleaned.withColumn("_ratio", ratio)
    mean = F.when((ca != 0) | (cb != 0), (ca + cb) / 2).otherwise(F.col("_ratio"))
    choice = _higher(a, ca, b, cb)
    for engine in reversed([p.lower() for p in priority]):
        if engine == primary.lower():
            choice = _result(a, ca)
        elif engine == secondary.lower():
            choice = _result(b, cb)
    alike = _result(F.when(F.length(a) >= F.length(b), a).otherwise(b), mean)
    both = F.when(F.coalesce(F.col("_ratio") >= minimum, F.lit(False)), alike).otherwise(choice)
    return rated.withColumn("fused", _fuse(a, ca, b, cb, both)).drop("_a", "_ca", "_b", "_cb", "_ratio")


def recheck_selection(blocks: DataFrame, threshold: float) -> DataFrame:
    """Blocks the second engine must read: none when the threshold is 0, else those below it."""
    return blocks.filter((F.lit(threshold) > 0) & (F.col("confidence") < threshold))


def engine_cascade(*texts: Column) -> Column:
    """The first engine's text that is not blank, else the empty string."""
    return F.coalesce(*[F.nullif(strip(t), F.lit("")) for t in texts], F.lit(""))


def page_engine_choice(text_a: Column, conf_a: Column, text_b: Column, conf_b: Column, minimum: float = MIN_CONFIDENCE
                       ) -> Column:
    """struct(text, confidence): the secondary replaces an unsure primary when it has text and is more confident."""
    better = (conf_a < minimum) & (F.coalesce(text_b, F.lit("")) != "") & (conf_b > conf_a)
    return F.when(better, _result(text_b, conf_b)).otherwise(_result(text_a, conf_a))
