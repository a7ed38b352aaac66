"""Declared trading calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def declared_days(spark: SparkSession, start: str, stop: str, closed: list[str], special: dict[str, str]) -> DataFrame:
    """(day, status) from weekday hours, closed dates and special sessions, in that order of
    increasing weight."""
    each = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(stop).cast("date")))
    status = F.when(F.dayofweek("day").isin(1, 7), "closed").otherwise("open")
    for day in closed:
        status = F.when(F.col("day") == F.lit(day).cast("date"), "closed").otherwise(status)
    for day, what in special.items():
        status = F.when(F.col("day") == F.lit(day).cast("date"), what).otherwise(status)
    return spark.range(1).select(each.alias("day")).select("day", status.alias("status"))
