"""Incremental chains with Structured Streaming.

The engine's clocks live in the rows, so late data are never dropped: a late correction is a
new revision, appended when it comes and ranked by its own clocks when read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_available(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform=lambda df: df) -> None:
    """Append what is new in ``source`` once and stop. A batch writes below its own id, so a
    batch that is run again after a failure replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicated(stream: DataFrame, keys: list[str], clock: str, within: str) -> DataFrame:
    """Repeated deliveries within the watermark dropped."""
    return stream.withWatermark(clock, within).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, clock: str, width: str, late: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums in event-time windows that stay open for ``late``."""
    return stream.withWatermark(clock, late).groupBy(F.window(clock, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("window.start", *by, "n", "total")


HIGH = "key string, n long, high double, drawdown double"


def running_high(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key the high so far and the last drawdown, folded in arrival order of batches."""

    def fold(who, frames, state: GroupState):
        n, high = state.get if state.exists else (0, float("-inf"))
        last = 0.0
        for pdf in frames:
            for x in pdf.sort_values(order, kind="stable")[value]:
                n, high = n + 1, max(high, float(x))
                last = 1 - float(x) / high if high else 0.0
        state.update((n, high))
        yield pd.DataFrame([(str(who[0]), n, high, last)], columns=["key", "n", "high", "drawdown"])

    return stream.groupBy(key).applyInPandasWithState(fold, HIGH, "n long, high double", "update", GroupStateTimeout.NoTimeout)


def advance(spark: SparkSession, path: str, stream: str, seen: int) -> int:
    """A collection watermark: strictly increasing, kept as one exclusive file a step."""
    from tidemark.sources.storage import create_once, exists

    step = 0
    while exists(spark, f"{path}/{stream}/{step}"):
        step += 1
    if step and int(spark.read.text(f"{path}/{stream}/{step - 1}").first()[0]) >= seen:
        raise ValueError("a watermark only moves forward")
    create_once(spark, f"{path}/{stream}/{step}", str(seen))
    return step
