"""Price-quality checks, classifications and audits over bars made from line items."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.operators import changes as C
from tidemark.operators.asof import islands
from tidemark.plans.inputs import BARS, bars, read
from tidemark.plans.registry import query

#: Line items as raw bars whose range is sometimes broken and volume sometimes bad.
RAW = """raw AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS day, l_returnflag AS basis, l_extendedprice AS open,
  l_extendedprice * (1 + l_tax) AS high, l_extendedprice * (1 - l_discount) AS low, l_extendedprice * (1.02 - l_discount) AS close,
  CASE WHEN l_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_orderkey % 89 = 0 THEN -1 ELSE l_quantity END AS volume FROM lineitem)"""


def raw(spark, d):
    k = F.col("l_orderkey")
    price = F.col("l_extendedprice")
    return read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("instrument"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("basis"), price.alias("open"),
        (price * (1 + F.col("l_tax"))).alias("high"), (price * (1 - F.col("l_discount"))).alias("low"), (price * (1.02 - F.col("l_discount"))).alias("close"),
        F.when(k % 97 == 0, F.lit(float("nan"))).when(k % 89 == 0, -1.0).otherwise(F.col("l_quantity")).alias("volume"),
    )


_ANOMALY = "(high < open OR high < close OR high < low OR low > open OR low > close)"
_BAD = "(NOT isfinite(volume) OR volume < 0 OR NOT isfinite(open) OR NOT isfinite(high) OR NOT isfinite(low) OR NOT isfinite(close))"


@query("e1_quality_counts", f"WITH {RAW} SELECT count(*) FILTER (WHERE {_ANOMALY}) AS anomalies, count(*) FILTER (WHERE {_BAD}) AS bad_values, count(*) AS n FROM raw")
def e1(spark, d):
    return raw(spark, d).agg(F.count_if(Q.ohlc_anomaly()).alias("anomalies"), F.count_if(Q.bad_value()).alias("bad_values"), F.count("*").alias("n"))


@query("e2_quality_by_partition", f"WITH {RAW} SELECT basis, CAST(year(day) AS INTEGER) AS year, count(*) FILTER (WHERE {_ANOMALY}) AS anomalies, count(*) FILTER (WHERE {_BAD}) AS bad_values FROM raw GROUP BY 1, 2")
def e2(spark, d):
    return raw(spark, d).groupBy("basis", F.year("day").alias("year")).agg(F.count_if(Q.ohlc_anomaly()).alias("anomalies"), F.count_if(Q.bad_value()).alias("bad_values"))


@query("e2_duplicate_keys", f"WITH {RAW} SELECT basis, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT instrument, day, basis, count(*) AS n FROM raw GROUP BY 1, 2, 3) GROUP BY basis")
def e2_dup(spark, d):
    return Q.duplicate_count(raw(spark, d), ["instrument", "day", "basis"], ["basis"])


@query("e3_basis_parity", f"WITH {RAW} SELECT instrument, day, max(open) FILTER (WHERE basis = 'A') AS a, max(open) FILTER (WHERE basis = 'N') AS n FROM raw GROUP BY 1, 2 HAVING max(open) FILTER (WHERE basis = 'A') > 2 * max(open) FILTER (WHERE basis = 'N')")
def e3(spark, d):
    p = raw(spark, d).groupBy("instrument", "day").agg(F.max(F.when(F.col("basis") == "A", F.col("open"))).alias("a"), F.max(F.when(F.col("basis") == "N", F.col("open"))).alias("n"))
    return p.where(F.col("a") > 2 * F.col("n"))


@query("e5_one_pass_validation", f"WITH {RAW} SELECT bool_or({_ANOMALY}) AS range_broken, bool_or(volume < 0) AS negative, bool_or(isnan(volume)) AS nan, bool_or(open <= 0) AS free FROM raw")
def e5(spark, d):
    return raw(spark, d).agg(F.bool_or(Q.ohlc_anomaly()).alias("range_broken"), F.bool_or(~F.isnan("volume") & (F.col("volume") < 0)).alias("negative"), F.bool_or(F.isnan("volume")).alias("nan"), F.bool_or(F.col("open") <= 0).alias("free"))


@query("c6_row_checks", f"WITH {RAW} SELECT count(*) FILTER (WHERE day < DATE '1995-06-01') AS early, count(*) FILTER (WHERE basis NOT IN ('A', 'N', 'R')) AS odd_basis, count(*) FILTER (WHERE instrument IS NULL) AS no_key, count(*) FILTER (WHERE low <= 0) AS unpriced FROM raw")
def c6(spark, d):
    return raw(spark, d).agg(F.count_if(F.col("day") < F.lit("1995-06-01").cast("date")).alias("early"), F.count_if(~F.col("basis").isin("A", "N", "R")).alias("odd_basis"), F.count_if(F.col("instrument").isNull()).alias("no_key"), F.count_if(F.col("low") <= 0).alias("unpriced"))


@query("c8_nan_guarded", f"WITH {RAW} SELECT count(*) FILTER (WHERE NOT isnan(volume) AND volume > 10) AS above, count(*) FILTER (WHERE NOT isnan(volume) AND volume <= 10) AS below FROM raw")
def c8(spark, d):
    v, ten = F.col("volume"), F.lit(10.0)
    return raw(spark, d).agg(F.count_if(Q.guarded(v, ">", ten)).alias("above"), F.count_if(Q.guarded(v, "<=", ten)).alias("below"))


@query("c9_ohlc_anomalies", f"WITH {RAW} SELECT instrument, count(*) AS n FROM raw WHERE {_ANOMALY} GROUP BY 1")
def c9(spark, d):
    return raw(spark, d).where(Q.ohlc_anomaly()).groupBy("instrument").agg(F.count("*").alias("n"))


@query("c10_time_order", f"WITH {BARS}, x AS (SELECT *, lag(day) OVER (PARTITION BY instrument ORDER BY day) AS before FROM bars) SELECT instrument, count(*) AS n, max(day - before) AS widest FROM x WHERE before IS NOT NULL GROUP BY 1")
def c10(spark, d):
    b = bars(spark, d).withColumn("before", F.lag("day").over(W.partitionBy("instrument").orderBy("day"))).where("before is not null")
    return b.groupBy("instrument").agg(F.count("*").alias("n"), F.max(F.datediff("day", "before")).cast("long").alias("widest"))


_TEXT = "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' WHEN event_id % 7 = 0 THEN '-1.5' WHEN event_id % 5 = 0 THEN '1e3' WHEN event_id % 3 = 0 THEN '12.50' ELSE '12' || chr(10) END"


def texts(spark, d):
    k = F.col("event_id")
    text = F.when(k % 13 == 0, None).when(k % 11 == 0, "").when(k % 7 == 0, "-1.5").when(k % 5 == 0, "1e3").when(k % 3 == 0, "12.50").otherwise("12\n")
    return read(spark, d, "events").withColumn("text", text)


@query("c11_decimal_states", f"SELECT CASE WHEN t IS NULL OR t = '' THEN 'missing' WHEN regexp_full_match(t, '[0-9]+(\\.[0-9]+)?') THEN 'present' ELSE 'invalid' END AS state, count(*) AS n FROM (SELECT {_TEXT} AS t FROM events) GROUP BY 1")
def c11(spark, d):
    return texts(spark, d).select(Q.decimal_state(F.col("text")).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "c12_bar_states",
    """WITH x AS (SELECT CASE WHEN event_id % 6 = 0 THEN 'missing' WHEN event_id % 31 = 0 THEN 'invalid' ELSE 'present' END AS a, CASE WHEN event_id % 4 = 0 THEN 'missing' ELSE 'present' END AS b FROM events)
    SELECT CASE WHEN a = 'invalid' OR b = 'invalid' THEN 'invalid' WHEN a = 'missing' AND b = 'missing' THEN 'missing' WHEN a = 'missing' OR b = 'missing' THEN 'partial' ELSE 'present' END AS state, count(*) AS n FROM x GROUP BY 1""",
)
def c12(spark, d):
    k = F.col("event_id")
    a = F.when(k % 6 == 0, "missing").when(k % 31 == 0, "invalid").otherwise("present")
    b = F.when(k % 4 == 0, "missing").otherwise("present")
    return read(spark, d, "events").select(Q.bar_state([a, b]).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("c13_admitted_bars", f"WITH {RAW} SELECT basis, count(*) AS n FROM raw WHERE isfinite(open) AND open > 0 AND isfinite(close) AND close > 0 AND low > 0 AND high > 0 AND low <= least(open, close) AND high >= greatest(open, close) GROUP BY 1")
def c13(spark, d):
    return raw(spark, d).where(Q.admitted()).groupBy("basis").agg(F.count("*").alias("n"))


@query("c15_staleness", "SELECT CASE WHEN day > DATE '2000-01-01' THEN 'post_cutoff' WHEN DATE '2000-01-01' - day > 400 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders) GROUP BY 1")
def c15(spark, d):
    state = Q.staleness(F.col("o_orderdate").cast("date"), F.lit("2000-01-01").cast("date"), 400)
    return read(spark, d, "orders").select(F.coalesce(state, F.lit("fresh")).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "c21_frame_kinds",
    """SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'instant' WHEN s BETWEEN 60 AND 120 THEN 'quarter' WHEN s BETWEEN 330 AND 380 THEN 'annual' ELSE 'other' END AS kind, count(*) AS n
    FROM (SELECT o_orderkey, CAST(o_orderkey % 400 AS INTEGER) AS s FROM orders) GROUP BY 1""",
)
def c21(spark, d):
    stop = F.col("o_orderdate").cast("date")
    start = F.when(F.col("o_orderkey") % 10 != 0, F.date_sub(stop, (F.col("o_orderkey") % 400).cast("int")))
    return read(spark, d, "orders").select(Q.frame_kind(start, stop).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("c22_universe_shards", "SELECT CAST((row_number() OVER (ORDER BY p_name, p_partkey) - 1) % 8 AS BIGINT) AS shard, p_partkey FROM part")
def c22(spark, d):
    from tidemark.sources.sharding import ordered_shards

    return ordered_shards(read(spark, d, "part"), ["p_name", "p_partkey"], 8).select("shard", "p_partkey")


@query("e7_status_histogram", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def e7(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("e9_flag_details", "SELECT s_nationkey, concat_ws('|', CASE WHEN min(s_acctbal) < 0 THEN 'debt' END, CASE WHEN count(*) > 3 THEN 'many' END, CASE WHEN max(s_acctbal) > 9000 THEN 'rich' END) AS flags FROM supplier GROUP BY 1")
def e9(spark, d):
    a = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"), F.count("*").alias("n"))
    return a.select("s_nationkey", F.concat_ws("|", F.when(F.col("lo") < 0, "debt"), F.when(F.col("n") > 3, "many"), F.when(F.col("hi") > 9000, "rich")).alias("flags"))


@query("e17_usage_window", "SELECT user_id, event_type, round(sum(value), 4) AS used, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2")
def e17(spark, d):
    e = read(spark, d, "events").where((F.col("ts") >= F.expr("timestamp_ntz'2024-01-05 00:00:00'")) & (F.col("ts") < F.expr("timestamp_ntz'2024-01-12 00:00:00'")))
    return e.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("used"), F.count("*").alias("n"))


@query("e18_unanswered", "SELECT user_id, count(*) AS n, max(event_id) AS latest FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'purchase' AND a.user_id = e.user_id AND a.ts > e.ts) GROUP BY 1")
def e18(spark, d):
    e = read(spark, d, "events")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("answered"))
    j = e.where("event_type = 'click'").join(last, "user_id", "left").where(F.col("answered").isNull() | (F.col("answered") <= F.col("ts")))
    return j.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("latest"))


@query("e20_nearest_rank", "SELECT c_mktsegment, quantile_disc(c_acctbal, 0.5) AS p50, quantile_disc(c_acctbal, 0.9) AS p90, quantile_disc(c_acctbal, 0.99) AS p99, count(*) AS n FROM customer GROUP BY 1")
def e20(spark, d):
    return Q.nearest_rank(read(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", (50, 90, 99))


@query("e23_vintage_bounds", f"WITH {BARS} SELECT instrument, min(day) AS first, max(day) AS last, count(*) FILTER (WHERE n > 1) AS multi FROM bars GROUP BY 1")
def e23(spark, d):
    return bars(spark, d).groupBy("instrument").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count_if(F.col("n") > 1).alias("multi"))


@query("e27_repeated_flag_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def e27(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("f21_data_gaps", f"WITH {BARS}, cal AS (SELECT DISTINCT day FROM bars), grid AS (SELECT i.instrument, cal.day, row_number() OVER (PARTITION BY i.instrument ORDER BY cal.day) AS k FROM (SELECT instrument, min(day) AS f FROM bars GROUP BY 1) i JOIN cal ON cal.day >= i.f), miss AS (SELECT grid.*, k - row_number() OVER (PARTITION BY instrument ORDER BY day) AS run FROM grid ANTI JOIN bars USING (instrument, day)) SELECT instrument, min(day) AS first, max(day) AS last, count(*) AS n FROM miss GROUP BY instrument, run HAVING count(*) >= 20")
def f21(spark, d):
    b = bars(spark, d)
    return Q.session_gaps(b, b, ["instrument"], "day").where("n >= 20")


@query("f25_duplicate_audit", "SELECT count(*) AS repeated_keys, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def f25(spark, d):
    return read(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_keys"), F.sum("n").alias("rows"))


@query("i21_partition_check", "WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, day, n, reference FROM (SELECT *, max(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 31 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS reference FROM c) WHERE n < 0.7 * reference")
def i21(spark, d):
    c = read(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return C.partition_check(c, "event_type", 0.7)


@query("j6_gap_islands", "WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type FROM events), y AS (SELECT user_id, day, max(event_type) AS kind FROM x GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - row_number() OVER (PARTITION BY user_id, kind ORDER BY day) AS g FROM y) SELECT user_id, kind, min(day) AS first, max(day) AS last, count(*) AS n FROM z GROUP BY user_id, kind, g")
def j6(spark, d):
    y = read(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max("event_type").alias("kind"))
    return islands(y, ["user_id"], "day", "kind")


@query("g3_truncated_read", "SELECT o_orderkey, count(*) OVER () > 500 AS truncated FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey LIMIT 501) QUALIFY row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= 500")
def g3(spark, d):
    from tidemark.sources.reading import limited

    return limited(read(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), ["o_orderdate", "o_orderkey"], 500).select("o_orderkey", "truncated")
