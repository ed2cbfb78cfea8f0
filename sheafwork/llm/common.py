"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return (fixed value).
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def blocks_for(df: DataFrame, text: str, bytes_per_block: int) -> int:
    """How many blocks hold the texts with about ``bytes_per_block`` each: one pass, one number to the driver."""
    total = df.select(F.sum(text_bytes(F.col(text)) + 8).alias("b")).first()["b"] or 0
    return max(1, -(-total // bytes_per_block))
