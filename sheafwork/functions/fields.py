"""Field extraction: dates, totals and vendors found in a text, as one struct each.

A text stays in its row. Its lines become an array, candidate matches become an array of structs whose leading members
are the ranking key, and ``array_min`` picks the best. No explode and no shuffle, however many lines a text has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafwork.functions.text import bind, contains_any, is_upper, strip

# Date patterns in order of preference, with the format name reported for each.
ISO_DATE = r"\b(\d{4})-(\d{2})-(\d{2})\b"
DAY_FIRST = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"
MONTH_FIRST = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"
SPANISH_LONG = r"(?i)\b(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})\b"
FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "es_long")
# Amount patterns in order of preference.
AMOUNT_PATTERNS = (
    (r"[€$£]\s?(\d{1,3}(?:\.\d{3})*,\d{2})", "eu"),
    (r"(\d{1,3}(?:\.\d{3})*,\d{2})\s?[€$£]", "eu"),
    (r"[€$£]\s?(\d{1,3}(?:,\d{3})*\.\d{2})", "us"),
    (r"(\d{1,3}(?:,\d{3})*\.\d{2})\s?[€$£]", "us"),
    (r"\b(\d+[.,]\d{2})\b", "simple"),
)
# Month names and the context words that raise confidence.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre",
          "noviembre", "diciembre")
DATE_WORDS = ["fecha", "date", "emis", "issued"]
TOTAL_WORDS = ["total", "importe", "amount", "suma", "pagar"]
VENDOR_WORDS = ["proveedor", "vendor", "empresa", "company", "razón social"]
NUMBERS_ONLY = r"^[\d\s\-./]+$"


def _numbered_lines(text: Column) -> tuple[Column, Column]:
    """Lines holding a digit, each with its 0-based number, and the count of all lines."""
    lines = F.split(text, "\n")
    numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    return F.filter(numbered, lambda x: x["line"].rlike(r"\d")), F.size(lines)


def _parse_date(raw: Column, kind: int) -> Column:
    if kind == 0:
        return F.try_to_date(raw, "yyyy-MM-dd")
    if kind == 1:
        return F.try_to_date(raw, "d/M/yyyy")
    if kind == 2:
        return F.try_to_date(raw, "M/d/yyyy")
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, str(i + 1))])
    part = lambda i: F.regexp_extract(raw, SPANISH_LONG, i)
    return F.try_to_date(F.concat_ws("-", part(3), months[F.lower(part(2))], part(1)), "yyyy-M-d")


def date_candidates(text: Column) -> Column:
    """All dates found, as (−confidence, line, pattern, match, value, raw) structs."""
    lines, total = _numbered_lines(text)

    def on_line(x: Column) -> Column:
        line, i = x["line"], x["i"]
        confidence = (
            F.lit(0.5) + F.when(contains_any(F.lower(line), DATE_WORDS), 0.3).otherwise(0.0)
            + F.when(i < total * 0.3, 0.2).otherwise(0.0)
        )

        def found(kind: int, pattern: str) -> Column:
            raws = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
            return F.transform(raws, lambda raw, j: F.struct(
                (-F.round(confidence, 2)).alias("rank"), i.alias("line"), F.lit(kind).alias("pattern"),
                j.alias("match"), _parse_date(raw, kind).alias("value"), raw.alias("raw"),
            ))

        patterns = (ISO_DATE, DAY_FIRST, MONTH_FIRST, SPANISH_LONG)
        return F.concat(*[found(kind, pattern) for kind, pattern in enumerate(patterns)])

    return F.filter(F.flatten(F.transform(lines, on_line)), lambda c: c["value"].isNotNull())


def best_candidate(candidates: Column) -> Column:
    """Highest confidence; ties go to the earliest line, pattern and match."""
    return F.array_min(candidates)


def extract_date(text: Column) -> Column:
    """struct(value, confidence, raw, format), null when the text holds no valid date."""
    return bind(best_candidate(date_candidates(text)), lambda best: F.when(best.isNotNull(), F.struct(
        best["value"].cast("string").alias("value"), (-best["rank"]).alias("confidence"),
        strip(best["raw"]).alias("raw"),
        F.get(F.array(*[F.lit(f) for f in FORMATS]), best["pattern"]).alias("format"),
    )))


def total_candidates(text: Column) -> Column:
    """All amounts found, as (−confidence, line, pattern, match, value, raw) structs."""
    lines, total = _numbered_lines(text)

    def on_line(x: Column) -> Column:
        line, i = x["line"], x["i"]
        confidence = (
            F.lit(0.4) + F.when(contains_any(F.lower(line), TOTAL_WORDS), 0.4).otherwise(0.0)
            + F.when(i > total * 0.5, 0.2).otherwise(0.0)
        )

        def found(order: int, pattern: str, kind: str) -> Column:
            def parsed(raw: Column) -> Column:
                digits = F.regexp_replace(raw, r"[€$£\s]", "")
                if kind == "eu":
                    digits = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
                elif kind == "us":
                    digits = F.replace(digits, F.lit(","), F.lit(""))
                else:
                    digits = F.replace(digits, F.lit(","), F.lit("."))
                return digits.try_cast("double")

            raws = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
            return F.transform(raws, lambda raw, j: F.struct(
                (-F.round(confidence, 2)).alias("rank"), i.alias("line"), F.lit(order).alias("pattern"),
                j.alias("match"), F.round(parsed(raw), 2).alias("value"), raw.alias("raw"),
            ))

        return F.concat(*[found(n, pattern, kind) for n, (pattern, kind) in enumerate(AMOUNT_PATTERNS)])

    return F.filter(F.flatten(F.transform(lines, on_line)), lambda c: c["value"].isNotNull())


def currency_of(raw: Column) -> Column:
    return F.when(raw.contains("€"), "EUR").when(raw.contains("$"), "USD").when(raw.contains("£"), "GBP").otherwise(
        "EUR")


def extract_total(text: Column) -> Column:
    """struct(value, confidence, raw, currency), null when the text holds no amount."""
    return bind(best_candidate(total_candidates(text)), lambda best: F.when(best.isNotNull(), F.struct(
        best["value"].alias("value"), (-best["rank"]).alias("confidence"), strip(best["raw"]).alias("raw"),
        currency_of(best["raw"]).alias("currency"),
    )))


def extract_vendor(text: Column) -> Column:
    """struct(value, confidence, raw) of the most vendor-like line among the first fifth of the text.

    Map ``value`` to a canonical vendor afterwards with ``match_vendor_fuzzy``.
    """
    def top_lines(lines: Column) -> Column:
        top = F.slice(lines, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(lines) * 0.2).cast("int")))
        numbered = F.transform(top, lambda line, i: F.struct(strip(line).alias("line"), i.alias("i")))
        return F.filter(numbered, lambda x: (F.length(x["line"]) > 0) & ~x["line"].rlike(NUMBERS_ONLY))

    def judged(x: Column) -> Column:
        line = x["line"]
        capitals, worded = is_upper(line), contains_any(F.lower(line), VENDOR_WORDS)
        sure = F.round(F.lit(0.6) + F.when(capitals, 0.2).otherwise(0.0) + F.when(worded, 0.2).otherwise(0.0), 2)
        tier = F.when((F.length(line) >= 3) & (capitals | worded | (x["i"] == 0)), 0).when(F.length(line) > 5, 1)
        return F.struct(
            tier.alias("tier"), x["i"].alias("i"), line.alias("value"),
            F.when(tier == 1, 0.4).otherwise(F.least(sure, F.lit(1.0))).alias("confidence"), line.alias("raw"),
        )

    ranked = F.filter(F.transform(bind(F.split(text, "\n"), top_lines), judged), lambda x: x["tier"].isNotNull())
    return bind(F.array_min(ranked), lambda best: F.when(best.isNotNull(), F.struct(
        best["value"].alias("value"), best["confidence"].alias("confidence"), best["raw"].alias("raw"))))


def extract_fields(text: Column, vendors: Mapping[str, Sequence[str]] | None = None) -> Column:
    """struct(date, total, vendor); with a vendor table the vendor's value is made canonical."""
    vendor = extract_vendor(text)
    if vendors:
        from sheafwork.operators.linking import match_vendor_fuzzy

        vendor = F.when(vendor.isNotNull(), vendor.withField("value", match_vendor_fuzzy(vendor["value"], vendors)))
    return F.struct(extract_date(text).alias("date"), extract_total(text).alias("total"), vendor.alias("vendor"))
