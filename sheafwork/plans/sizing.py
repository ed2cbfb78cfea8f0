"""Size checks that decide between a small-side plan and a distributed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


def rows_if_small(df: DataFrame, limit: int) -> list[Row] | None:
    """The rows of ``df`` when there are at most ``limit``, else None.

    Never moves more than ``limit + 1`` rows to the driver.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def block_count(df: DataFrame, rows_per_block: int) -> int:
    """How many blocks hold ``df`` with about ``rows_per_block`` rows each (one counting pass)."""
    return max(1, -(-df.count() // rows_per_block))


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """A stored table, hash-distributed when its scan has fewer splits than the session has cores.

    A small file with one row group would put costly per-row work on one core. A large table has splits enough and is
    returned as it is. Filters and column selections still pass through to the scan.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, *keys)
