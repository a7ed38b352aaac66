"""Deterministic numbering and sharding without one task for the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordinals(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Global positions from 0 in the given order.

    Range partitions are numbered on their own; each adds the rows of those before it, from a
    table of one row a partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    own = ranged.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    sizes = own.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_p"), before.alias("_before"))
    return own.join(F.broadcast(starts), "_p").withColumn(name, F.col("_before") + F.col("_i") - 1).drop("_p", "_i", "_before")  # a row a partition


def ordered_shards(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Round-robin shards over a total order."""
    return ordinals(df, order, "_o").withColumn("shard", F.col("_o") % shards).drop("_o")
