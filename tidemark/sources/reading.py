"""Bounded reads that say whether they were cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def limited(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order with ``truncated``, which one more row decides."""
    some = df.orderBy(*order).limit(n + 1)  # n + 1 rows from here on
    w = W.orderBy(*order)
    marked = some.withColumn("_r", F.row_number().over(w)).withColumn("truncated", F.count("*").over(W.partitionBy()) > n)
    return marked.where(F.col("_r") <= n).drop("_r")


def peek(df: DataFrame, n: int) -> DataFrame:
    """A bounded look at a table as JSON lines."""
    return df.limit(n).select(F.to_json(F.struct("*")).alias("row"))
