"""Running aggregates that do not put one key, or the whole table, into one task.

A window ordered over a key sends every row of that key to one task. Here the order is cut at quantiles into buckets;
each (key, bucket) is summed with a map-side combine, the few bucket sums of a key are accumulated, and rows only need
their own bucket for the rest. A key that owns a third of the table is spread over as many groups as there are buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_BUCKETS = 64


def order_buckets(df: DataFrame, order: str, name: str, buckets: int | None = None, source: DataFrame | None = None
                  ) -> DataFrame:
    """Add the bucket of the numeric column ``order``, cut at quantiles taken from ``source`` (default ``df``).

    Rows whose order is null have the first bucket to themselves, NaN the last.

    One pass over that column alone finds the cut points; only they reach the driver. By default there are as many
    buckets as shuffle partitions, and never fewer than 64.
    """
    if buckets is None:
        buckets = max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fractions = [i / buckets for i in range(1, buckets)]
    cuts = (source if source is not None else df).approxQuantile(order, fractions, 0.25 / buckets)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    numbered = df.withColumn("_order", F.col(order).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_order", outputCol="_cut", handleInvalid="keep").transform(numbered)
    return cut.withColumn(name, F.when(F.col("_order").isNull(), -1.0).otherwise(F.col("_cut"))).drop("_order", "_cut")


def _with_offsets(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row beside the sums of its (keys, bucket); a null key is a key like others."""
    named = offsets.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(keys)})
    same = [rows[c].eqNullSafe(named[f"_of_{i}"]) for i, c in enumerate(keys)]
    return rows.join(named, reduce(and_, same)).drop(*[f"_of_{i}" for i in range(len(keys))])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    *,
    bucket_by: str,
    inclusive: bool = False,
    buckets: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add, per row, the sum of each expression over the rows of the same key before it (or through it).

    ``order`` must be a total order within the key and start with ``bucket_by``, a numeric column.
    """
    bucketed = order_buckets(df, bucket_by, "_bucket", buckets, source)
    for name, expression in sums.items():
        bucketed = bucketed.withColumn(f"_x_{name}", expression)

    totals = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )

    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = bucketed
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.coalesce(F.sum(f"_x_{name}").over(inside), F.lit(0)))
    joined = _with_offsets(local, offsets, [*keys, "_bucket"])
    return joined.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, bucket_by: str, name: str = "row_no",
    buckets: int | None = None,
) -> DataFrame:
    """1-based position of every row within its key; with no keys, over the whole table."""
    if keys:
        return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, bucket_by=bucket_by, inclusive=True,
                            buckets=buckets)
    return running_sums(
        df.withColumn("_all", F.lit(0)), ["_all"], order, {name: F.lit(1).cast("bigint")},
        bucket_by=bucket_by, inclusive=True, buckets=buckets,
    ).drop("_all")


def running_moments(
    df: DataFrame, key: str, order: str, value: str, *, buckets: int | None = None, source: DataFrame | None = None,
) -> DataFrame:
    """Add ``_n``, ``_mean`` and ``_deviation`` (sample) of the earlier values of the key, in ``order``.

    Moments of the earlier buckets and of the earlier rows in the bucket are merged about nearby means, so large amounts
    that differ by cents keep their deviation, and equal amounts have exactly none. A null key is a key like others, and
    rows with a null order come before all others of their key, by value.
    """
    bucketed = order_buckets(df, order, "_bucket", buckets, source)
    v = F.col(value)
    totals = bucketed.groupBy(key, "_bucket").agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    by_bucket = Window.partitionBy(key).orderBy("_bucket")
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    shifted = totals.withColumn("g", F.first("m").over(by_bucket)).withColumn("d", F.col("m") - F.col("g"))
    before = shifted.select(
        key, "_bucket", "g", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.sum(F.col("n") * F.col("d")).over(earlier).alias("d0"),
        F.sum(F.col("n") * (F.col("d") * F.col("d") + F.col("s"))).over(earlier).alias("q0"),
        F.min("lo").over(earlier).alias("lo0"), F.max("hi").over(earlier).alias("hi0"))

    inside = Window.partitionBy(key, "_bucket").orderBy(order, value).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.withColumns({
        "n1": F.count(v).over(inside), "m1": F.avg(v).over(inside), "s1": F.var_pop(v).over(inside),
        "lo1": F.min(v).over(inside), "hi1": F.max(v).over(inside)})
    both = _with_offsets(local, before, [key, "_bucket"])
    n0, n1 = F.col("n0"), F.col("n1")
    n = n0 + n1
    mean0 = F.when(n0 > 0, F.col("g") + F.col("d0") / F.nullif(n0, F.lit(0))).otherwise(F.col("m1"))
    mean1 = F.coalesce("m1", mean0)
    spread0 = F.when(n0 > 0, F.col("q0") - F.col("d0") * F.col("d0") / F.nullif(n0, F.lit(0))).otherwise(0.0)
    spread1 = F.when(n1 > 0, n1 * F.col("s1")).otherwise(0.0)
    between = (mean1 - mean0) * (mean1 - mean0) * n0 * n1
    some = F.nullif(n, F.lit(0))
    squares = F.greatest(spread0 + spread1 + between / some, F.lit(0.0))
    equal = F.least("lo0", "lo1") == F.greatest("hi0", "hi1")
    return both.select(
        *df.columns, n.alias("_n"), ((mean0 * n0 + mean1 * n1) / some).alias("_mean"),
        F.when(equal, 0.0).otherwise(F.sqrt(squares / F.nullif(n - 1, F.lit(0)))).alias("_deviation"))
