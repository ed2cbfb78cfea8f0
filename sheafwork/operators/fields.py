"""Normalising extracted fields and flagging what looks wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions.text import bind, collapse_spaces, is_upper, title_case
from sheafwork.plans.prefix import running_moments

# Company suffixes removed from vendor names, in this order.
LEGAL_SUFFIXES = (r"\bS\.?L\.?", r"\bS\.?A\.?", r"\bLtd\.?", r"\bInc\.?", r"\bCorp\.?", r"\bGmbH", r"\bLLC",
                  r"\bLimited")
MIN_HISTORY = 5
SIGMAS = 3
LARGE_FACTOR = 10
ROUND_STEP = 100
ROUND_FROM = 1000
FUTURE_DAYS = 7
OLD_DAYS = 365 * 5


def normalise_vendor(name: Column) -> Column:
    """Company suffixes removed, white space collapsed, all-capitals turned into title case."""
    for suffix in LEGAL_SUFFIXES:
        name = F.regexp_replace(name, f"(?i){suffix}", "")
    return bind(collapse_spaces(name), lambda clean: F.when(is_upper(clean), title_case(clean)).otherwise(clean))


def normalise_fields(fields: Column) -> Column:
    """The same struct with amounts at two places, a currency always set and vendor names tidied."""
    def tidy(f: Column) -> Column:
        total, vendor = f["total"], f["vendor"]
        amount = F.struct(
            F.round(total["value"], 2).alias("value"), total["confidence"].alias("confidence"),
            total["raw"].alias("raw"), F.coalesce(total["currency"], F.lit("EUR")).alias("currency"))
        name = F.struct(
            normalise_vendor(vendor["value"]).alias("value"), vendor["confidence"].alias("confidence"),
            vendor["raw"].alias("raw"))
        return F.struct(
            f["date"].alias("date"), F.when(total.isNotNull(), amount).alias("total"),
            F.when(vendor.isNotNull(), name).alias("vendor"))

    return bind(fields, tidy)


def is_iso_date(value: Column) -> Column:
    return value.rlike(r"^\d{4}-\d{2}-\d{2}$")


def field_anomalies(fields: Column, as_of: Column) -> Column:
    """Codes for missing fields and suspicious dates, judged on ``as_of`` (a timestamp)."""
    today = as_of.cast("timestamp_ntz")

    def judge(f: Column) -> Column:
        has_date = f["date"].isNotNull()
        moment = F.try_to_timestamp(f["date"]["value"], F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
        return F.array_compact(F.array(
            F.when(~has_date, "missing_date"),
            F.when(f["total"].isNull(), "missing_total"),
            F.when(f["vendor"].isNull(), "missing_vendor"),
            F.when(has_date & (moment > today + F.expr(f"interval {FUTURE_DAYS} days")), "future_date"),
            F.when(has_date & (F.weekday(moment) >= 5), "weekend_date"),
            F.when(has_date & (moment < today - F.expr(f"interval {OLD_DAYS} days")), "very_old_date"),
            F.when(has_date & moment.isNull(), "invalid_date_format"),
        ))

    return bind(fields, judge)


def amount_anomalies(
    amounts: DataFrame, key: str, order: str, amount: str, *, buckets: int | None = None,
    bounds_from: DataFrame | None = None,
) -> DataFrame:
    """Add ``anomalies``: what is odd about each amount against the earlier ones of its key.

    ``order`` is a unique number per row that follows time. At least five earlier amounts are needed; then more than
    three sample deviations from their mean is unusual, more than ten times the mean very large, and a multiple of 100
    from 1000 on suspiciously round. A null amount is invalid, whatever its history; rows without a key share one history. The history is kept in running moments, so no key is gathered in one task. ``amounts`` is read
    twice: store amounts that were extracted from text before they come here.
    """
    value = F.col(amount)
    history = running_moments(amounts, key, order, amount, buckets=buckets, source=bounds_from)
    mean, deviation = F.col("_mean"), F.col("_deviation")
    codes = F.array_compact(F.array(
        F.when((deviation > 0) & (F.abs(value - mean) > SIGMAS * deviation), "unusual_amount"),
        F.when(value > mean * LARGE_FACTOR, "very_large_amount"),
        F.when((value % ROUND_STEP == 0) & (value >= ROUND_FROM), "suspicious_round_number"),
    ))
    none = F.array().cast("array<string>")
    return history.withColumn(
        "anomalies", F.when(value.isNull(), F.array(F.lit("invalid_amount"))).when(F.col("_n") >= MIN_HISTORY, codes)
        .otherwise(none)).drop("_n", "_mean", "_deviation")
