"""Streaming forms over the events, driven to completion, and their batch equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.inputs import read
from tidemark.plans.registry import query
from tidemark.sources import storage
from tidemark.streaming import appends


def _staged(spark, d):
    """Events as a folder that a stream can read, a file or more a type."""
    path = storage.scratch(spark)
    read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return path, spark.read.parquet(path).schema


@query("j9_available_now", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def j9(spark, d):
    source, schema = _staged(spark, d)
    target = storage.scratch(spark)
    appends.append_available(spark, source, schema, target, storage.scratch(spark))
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("j10_deduplicated_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def j10(spark, d):
    source, schema = _staged(spark, d)
    again = spark.read.parquet(source)
    again.write.mode("append").parquet(source)  # every event delivered twice
    target, check = storage.scratch(spark), storage.scratch(spark)
    stream = appends.deduplicated(spark.readStream.schema(schema).parquet(source), ["event_id"], "ts", "40 days")
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"))


@query("j7_stateful_high", "SELECT event_type AS key, count(*) AS n, max(value) AS high FROM events GROUP BY 1")
def j7(spark, d):
    source, schema = _staged(spark, d)
    target, check = storage.scratch(spark), storage.scratch(spark)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    folded = appends.running_high(spark.readStream.schema(schema).parquet(source), "event_type", "event_id", "value")
    folded.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).groupBy("key").agg(F.max("n").alias("n"), F.max("high").alias("high"))


@query("j5_monthly_buckets", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1")
def j5(spark, d):
    o = read(spark, d, "orders")
    return o.groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last"))


@query("j2_late_rows_kept", "SELECT CAST(count(*) AS BIGINT) AS kept FROM events")
def j2(spark, d):
    source, schema = _staged(spark, d)
    target = storage.scratch(spark)
    appends.append_available(spark, source, schema, target, storage.scratch(spark), lambda df: df.withColumn("known", F.col("ts") + F.expr("INTERVAL 3 DAYS")))
    return spark.read.parquet(target).agg(F.count("known").alias("kept"))
