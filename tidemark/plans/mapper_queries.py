"""Mappers over driver tables in the providers' shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.mappers import apply_mapper
from tidemark.plans.inputs import read
from tidemark.plans.quality_queries import RAW, raw
from tidemark.plans.registry import query


@query("k1_bars_typed", f"WITH {RAW} SELECT CASE WHEN isfinite(volume) THEN 'present' ELSE 'invalid' END AS value_state, count(*) AS n, count(DISTINCT instrument) AS tokens FROM raw GROUP BY 1")
def bars_typed(spark, d):
    m = apply_mapper("bars.typed@1", raw(spark, d).withColumnRenamed("instrument", "token"))
    return m.groupBy("value_state").agg(F.count("*").alias("n"), F.countDistinct("token").alias("tokens"))


@query("k1_bars_quarantined", f"WITH {RAW} SELECT instrument AS token, count(*) AS n FROM raw WHERE isfinite(open) AND open > 0 AND isfinite(close) AND close > 0 AND low > 0 AND high > 0 AND low <= least(open, close) AND high >= greatest(open, close) GROUP BY 1")
def bars_quarantined(spark, d):
    return apply_mapper("bars.quarantined@2", raw(spark, d).withColumnRenamed("instrument", "token")).groupBy("token").agg(F.count("*").alias("n"))


@query("k1_split_ratios", "SELECT p_partkey AS token, CASE WHEN p_size % 5 > 0 THEN round((1 + p_partkey % 3) / (p_size % 5)::DOUBLE, 8) END AS ratio, CASE WHEN p_size % 5 > 0 THEN 'present' ELSE 'invalid' END AS value_state FROM part")
def splits(spark, d):
    text = F.concat((1 + F.col("p_partkey") % 3).cast("string"), F.lit("/"), (F.col("p_size") % 5).cast("string"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("token"), F.lit("2024-01-01").cast("date").alias("day"), text.alias("split"))
    return apply_mapper("splits.ratio_text@1", p).select("token", F.round("ratio", 8).alias("ratio"), "value_state")


@query("k1_capital_steps", "SELECT token, day, round(factor / before, 8) AS ratio FROM (SELECT user_id AS token, event_id AS day, factor, last_value(factor IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN 1 + CAST(event_id % 3 AS DOUBLE) END AS factor FROM events)) WHERE before > 0 AND factor IS NOT NULL AND abs(factor / before - 1) > 1e-6")
def capital(spark, d):
    k = F.col("event_id")
    e = read(spark, d, "events").select(F.col("user_id").alias("token"), k.alias("day"), F.when(k % 4 != 0, 1 + (k % 3).cast("double")).alias("factor"))
    return apply_mapper("capital.factor_steps@1", e).select("token", "day", F.round("ratio", 8).alias("ratio"))


@query("k1_listing_status", "WITH s AS (SELECT o_custkey AS token, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1) SELECT token, 'listed' AS status, first AS day FROM s UNION ALL SELECT token, 'delisted', last + 1 FROM s WHERE last < DATE '2001-01-01'")
def listing(spark, d):
    day = F.col("o_orderdate").cast("date")
    s = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("token")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return apply_mapper("status.listing@1", s.withColumn("gone", F.col("last") < F.lit("2001-01-01").cast("date")))


@query("k1_statement_lines", "WITH x AS (SELECT l_suppkey AS token, year(l_shipdate) AS period, l_returnflag AS line, l_quantity AS term, CASE WHEN l_linenumber > 3 THEN l_extendedprice END AS cumulative FROM lineitem) SELECT span, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT 'term' AS span, term AS value FROM x UNION ALL SELECT 'cumulative', cumulative FROM x WHERE cumulative IS NOT NULL) GROUP BY 1")
def statements(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("token"), F.year("l_shipdate").alias("period"), F.col("l_returnflag").alias("line"), F.col("l_quantity").alias("term"), F.when(F.col("l_linenumber") > 3, F.col("l_extendedprice")).alias("cumulative"))
    return apply_mapper("statements.lines@1", x).groupBy("span").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("k1_classifications", "SELECT p_name AS token, p_type || '/' || p_brand AS path FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_type || '/' || p_brand) AS r FROM part) WHERE r = 1")
def classified(spark, d):
    p = read(spark, d, "part").select(F.col("p_name").alias("token"), F.array("p_type", "p_brand").alias("levels"), F.col("p_size").alias("seen"))
    return apply_mapper("classification.snapshot@2", p).select("token", "path")


@query("k1_macro_points", "SELECT CASE WHEN event_id % 9 = 0 THEN 'missing' WHEN event_id % 5 = 0 THEN 'invalid' ELSE 'present' END AS value_state, count(*) AS n FROM events GROUP BY 1")
def macro_points(spark, d):
    k = F.col("event_id")
    text = F.when(k % 9 == 0, ".").when(k % 5 == 0, "1,5").otherwise("-1.25")
    e = read(spark, d, "events").select(F.col("event_type").alias("token"), F.col("ts").cast("date").alias("day"), text.alias("value"))
    return apply_mapper("macro.vintages@1", e).groupBy("value_state").agg(F.count("*").alias("n"))
