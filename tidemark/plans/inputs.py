"""Driver tables in the engine's shapes, each with the SQL of the same relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR = 3_600_000_000
CUTOFF = 1_705_708_800_000_000  # 2024-01-20
INGESTED = 1_706_140_800_000_000  # 2024-01-25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (instrument, day, open, high, low, close, volume, n) from line items."""
    key = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("instrument"), F.col("l_shipdate").cast("date").alias("day")).agg(
        F.min_by("l_extendedprice", key).alias("open"),
        F.max("l_extendedprice").alias("high"),
        F.min("l_extendedprice").alias("low"),
        F.max_by("l_extendedprice", key).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.count("*").alias("n"),
    )


BARS = """bars AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS day,
  arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
  arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS close, sum(l_quantity) AS volume, count(*) AS n
  FROM lineitem GROUP BY 1, 2)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision history from events: a record a (user, type), its rows in time order."""
    e = read(spark, sf_dir, "events").withColumn("us", micros("ts"))
    seq = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    k = F.col("event_id")
    return e.select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("record_id"), F.col("user_id").alias("subject"), "event_type", "event_id", "value",
        F.col("ts").cast("date").alias("day"), seq.alias("sequence"),
        F.when(seq == 1, "ASSERT").when(k % 7 == 3, "TOMBSTONE").otherwise("SUPERSEDE").alias("op"),
        F.when(k % 17 != 0, F.col("us") + (k % 5) * HOUR).alias("known"),
        F.when(k % 19 != 0, F.col("us") + (k % 5 + k % 3) * HOUR).alias("available"),
        (F.col("us") + 8 * HOUR).alias("ingested"),
        F.when(k % 23 == 0, "reference").otherwise("primary").alias("role"),
        (k % 2).alias("pin"), (k % 29 == 0).alias("flagged"),
    )


REVISIONS = """revisions AS (SELECT user_id || ':' || event_type AS record_id, user_id AS subject, event_type, event_id, value, CAST(ts AS DATE) AS day,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS sequence,
  CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'ASSERT' WHEN event_id % 7 = 3 THEN 'TOMBSTONE' ELSE 'SUPERSEDE' END AS op,
  CASE WHEN event_id % 17 <> 0 THEN epoch_us(ts) + (event_id % 5) * 3600000000 END AS known,
  CASE WHEN event_id % 19 <> 0 THEN epoch_us(ts) + (event_id % 5 + event_id % 3) * 3600000000 END AS available,
  epoch_us(ts) + 8 * 3600000000 AS ingested, CASE WHEN event_id % 23 = 0 THEN 'reference' ELSE 'primary' END AS role,
  event_id % 2 AS pin, event_id % 29 = 0 AS flagged FROM events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal identity spans (token, target, valid_from, valid_to, known_from, known_to):
    each customer's orders open a span that lasts until the next order day."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("token"), F.col("o_orderdate").cast("date").alias("valid_from")).agg(F.min("o_orderkey").alias("k"))
    after = F.lead("valid_from").over(W.partitionBy("token").orderBy("valid_from"))
    return o.select(
        "token", (F.col("k") % 50).alias("target"), "valid_from", F.when(F.col("k") % 11 != 0, after).alias("valid_to"),
        F.date_add("valid_from", (F.col("k") % 4).cast("int")).alias("known_from"),
        F.when(F.col("k") % 9 == 0, F.date_add("valid_from", 400)).alias("known_to"),
    )


SPANS = """spans AS (SELECT token, k % 50 AS target, valid_from,
  CASE WHEN k % 11 <> 0 THEN lead(valid_from) OVER (PARTITION BY token ORDER BY valid_from) END AS valid_to,
  valid_from + CAST(k % 4 AS INTEGER) AS known_from, CASE WHEN k % 9 = 0 THEN valid_from + 400 END AS known_to
  FROM (SELECT o_custkey AS token, CAST(o_orderdate AS DATE) AS valid_from, min(o_orderkey) AS k FROM orders GROUP BY 1, 2))"""


def fixings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currency fixings (currency, day, rate) from order totals of a customer nation, sparse."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    return o.groupBy(F.col("c_nationkey").alias("currency"), day.alias("day")).agg(F.max("o_totalprice").alias("rate"))


FIXINGS = """fixings AS (SELECT c_nationkey AS currency, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS rate
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-end points (asset, month, as_of, close) of the bars."""
    from tidemark.operators.features import month_end_snap

    return month_end_snap(bars(spark, sf_dir).select(F.col("instrument").alias("asset"), F.col("day").alias("as_of"), "close"))


MONTHS = (
    BARS
    + """, months AS (SELECT instrument AS asset, CAST(date_trunc('month', day) AS DATE) AS month, max(day) AS as_of, arg_max(close, day) AS close FROM bars GROUP BY 1, 2)"""
)
