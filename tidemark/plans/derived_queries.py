"""Derived reads: FX as-of conversion, adjusted prices, source selection, seams, proxies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.operators import accounting as ACC
from tidemark.operators import adjustment
from tidemark.operators import asof as A
from tidemark.operators import risk as R
from tidemark.plans.inputs import BARS, FIXINGS, bars, fixings, read
from tidemark.plans.registry import query

_SUNDAY = "f AS (SELECT * FROM fixings WHERE dayofweek(day) = 0)"
_ORDERS = "o AS (SELECT o_orderkey, c_nationkey AS currency, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey)"


def amounts(spark, d):
    j = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", F.col("c_nationkey").alias("currency"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("amount"))


def sparse(spark, d):
    return fixings(spark, d).where(F.dayofweek("day") == 1)


@query("d12_fx_as_of", f"WITH {FIXINGS}, {_SUNDAY}, {_ORDERS} SELECT o_orderkey, CASE WHEN o.day - f.day <= 10 THEN f.day END AS as_of, CASE WHEN o.day - f.day <= 10 THEN rate END AS rate FROM o ASOF LEFT JOIN f ON o.currency = f.currency AND o.day >= f.day")
def d12(spark, d):
    return A.asof_backward(amounts(spark, d), sparse(spark, d), "currency", "day", "day", ["rate"], 10).select("o_orderkey", "as_of", "rate")


@query("l10_fx_conversion", f"WITH {FIXINGS}, {_SUNDAY}, {_ORDERS} SELECT o.currency, count(*) FILTER (WHERE o.day - f.day <= 10) AS converted, count(*) AS n, round(sum(CASE WHEN o.day - f.day <= 10 THEN amount / rate END), 2) AS total FROM o ASOF LEFT JOIN f ON o.currency = f.currency AND o.day >= f.day GROUP BY 1")
def l10(spark, d):
    j = A.asof_backward(amounts(spark, d), sparse(spark, d), "currency", "day", "day", ["rate"], 10)
    return j.groupBy("currency").agg(F.count("rate").alias("converted"), F.count("*").alias("n"), F.round(F.sum(F.col("amount") / F.col("rate")), 2).alias("total"))


@query("d13_known_fixings", f"WITH {FIXINGS} SELECT currency, count(*) AS n, max(day) AS latest FROM fixings WHERE day BETWEEN DATE '1999-01-01' - 10 AND DATE '1999-06-30' GROUP BY 1")
def d13(spark, d):
    lo, hi = F.date_sub(F.lit("1999-01-01").cast("date"), 10), F.lit("1999-06-30").cast("date")
    return fixings(spark, d).where(F.col("day").between(lo, hi)).groupBy("currency").agg(F.count("*").alias("n"), F.max("day").alias("latest"))


#: Two witnesses of a bar: the day's rows with even and with odd order keys.
_WITNESS = """w AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) FILTER (WHERE l_orderkey % 2 = 0) AS a, max(l_extendedprice) FILTER (WHERE l_orderkey % 2 = 1) AS b FROM lineitem GROUP BY 1, 2)"""


def witnesses(spark, d):
    even = F.col("l_orderkey") % 2 == 0
    g = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("instrument"), F.col("l_shipdate").cast("date").alias("day"))
    return g.agg(F.max(F.when(even, F.col("l_extendedprice"))).alias("a"), F.max(F.when(~even, F.col("l_extendedprice"))).alias("b"))


@query("d15_witness_flags", f"WITH {_WITNESS} SELECT instrument, count(*) FILTER (WHERE b IS NULL) AS unwitnessed, count(*) FILTER (WHERE abs(a - b) > 0.5 * abs(b)) AS disputed FROM w WHERE a IS NOT NULL GROUP BY 1")
def d15(spark, d):
    w = witnesses(spark, d).where("a is not null")
    return w.groupBy("instrument").agg(F.count_if(F.col("b").isNull()).alias("unwitnessed"), F.count_if(F.abs(F.col("a") - F.col("b")) > 0.5 * F.abs("b")).alias("disputed"))


@query("d16_overlap_differences", f"WITH {_WITNESS}, x AS (SELECT instrument, round(abs(a - b) / abs(b), 6) AS diff FROM w WHERE a IS NOT NULL AND b IS NOT NULL) SELECT instrument, quantile_disc(diff, 0.5) AS p50, quantile_disc(diff, 0.9) AS p90, quantile_disc(diff, 0.99) AS p99, count(diff) AS n FROM x GROUP BY 1")
def d16(spark, d):
    from tidemark.operators.quality import nearest_rank

    x = witnesses(spark, d).where("a is not null and b is not null").withColumn("diff", F.round(F.abs(F.col("a") - F.col("b")) / F.abs("b"), 6))
    return nearest_rank(x, ["instrument"], "diff", (50, 90, 99))


@query("d8_cross_provider_mismatch", f"WITH {_WITNESS} SELECT instrument, day FROM w WHERE a IS NOT NULL AND EXISTS (SELECT 1 FROM w r WHERE r.instrument = w.instrument AND r.day = w.day AND abs(w.a - r.b) > 0.8 * abs(r.b))")
def d8(spark, d):
    from tidemark.operators.changes import mismatches

    w = witnesses(spark, d)
    own = w.where("a is not null").select("instrument", "day", F.col("a").alias("close"))
    other = w.where("b is not null").select("instrument", "day", F.col("b").alias("close"))
    return mismatches(own, other, ["instrument", "day"], "close", 0.8).select("instrument", "day")


@query("i14_selected_source", f"WITH {_WITNESS} SELECT instrument, CASE WHEN day < DATE '1999-01-01' THEN 'a' ELSE 'b' END AS source, count(*) AS n, round(sum(CASE WHEN day < DATE '1999-01-01' THEN a ELSE b END), 2) AS total FROM w WHERE CASE WHEN day < DATE '1999-01-01' THEN a ELSE b END IS NOT NULL GROUP BY 1, 2")
def i14(spark, d):
    early = F.col("day") < F.lit("1999-01-01").cast("date")
    s = witnesses(spark, d).select("instrument", F.when(early, "a").otherwise("b").alias("source"), F.when(early, F.col("a")).otherwise(F.col("b")).alias("close"))
    return s.where("close is not null").groupBy("instrument", "source").agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("total"))


@query("d32_seam_rows", f"WITH {BARS} SELECT instrument, max(day) FILTER (WHERE day < DATE '1998-07-01') AS before, min(day) FILTER (WHERE day >= DATE '1998-07-01') AS after, arg_max(close, day) FILTER (WHERE day < DATE '1998-07-01') AS c0, arg_min(close, day) FILTER (WHERE day >= DATE '1998-07-01') AS c1 FROM bars GROUP BY 1")
def d32(spark, d):
    seam = F.lit("1998-07-01").cast("date")
    old = F.col("day") < seam
    day = lambda c: F.when(c, F.col("day"))
    return bars(spark, d).groupBy("instrument").agg(F.max(day(old)).alias("before"), F.min(day(~old)).alias("after"), F.max_by("close", day(old)).alias("c0"), F.min_by("close", day(~old)).alias("c1"))


@query("d30_proxy_switch", f"WITH {BARS} SELECT CASE WHEN day < DATE '1998-01-01' THEN instrument % 2 ELSE instrument END AS used, count(*) AS n FROM bars GROUP BY 1")
def d30(spark, d):
    used = F.when(F.col("day") < F.lit("1998-01-01").cast("date"), F.col("instrument") % 2).otherwise(F.col("instrument"))
    return bars(spark, d).groupBy(used.alias("used")).agg(F.count("*").alias("n"))


@query("d14_price_grid", f"WITH {BARS}, s AS (SELECT DISTINCT day FROM bars WHERE day BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'), i AS (SELECT DISTINCT instrument FROM bars) SELECT i.instrument, count(*) AS cells, count(close) AS present, count(*) - count(close) AS missing FROM i CROSS JOIN s LEFT JOIN bars ON bars.instrument = i.instrument AND bars.day = s.day GROUP BY 1")
def d14(spark, d):
    b = bars(spark, d)
    march = b.select("day").distinct().where(F.col("day").between(F.lit("1998-03-01").cast("date"), F.lit("1998-03-31").cast("date")))
    grid = b.select("instrument").distinct().crossJoin(F.broadcast(march))  # at most 31 days
    j = grid.join(b.select("instrument", "day", "close"), ["instrument", "day"], "left")
    return j.groupBy("instrument").agg(F.count("*").alias("cells"), F.count("close").alias("present"), (F.count("*") - F.count("close")).alias("missing"))


#: Splits: bars whose first order key divides by 41 halve the earlier prices.
@query(
    "f15_adjusted_prices",
    f"""WITH {BARS}, act AS (SELECT instrument, close, count(*) FILTER (WHERE n >= 2 AND CAST(volume AS BIGINT) % 5 = 0) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS k FROM bars)
    SELECT instrument, count(*) AS n, CAST(min(k) AS BIGINT) AS low, CAST(max(k) AS BIGINT) AS high, round(sum(close / pow(2, k)), 4) AS total FROM act GROUP BY 1""",
)
def f15(spark, d):
    b = bars(spark, d)
    act = b.where((F.col("n") >= 2) & (F.col("volume").cast("long") % 5 == 0)).select("instrument", "day", F.lit("ratio").alias("kind"), F.lit("2").cast("decimal(38,12)").alias("ratio"), F.lit(None).cast("decimal(38,12)").alias("amount"))
    own = b.select("instrument", "day", exact.shortest_decimal(F.col("close")).alias("close"), exact.shortest_decimal(F.col("volume")).alias("volume"))
    out = adjustment.adjusted(own, act)
    k = F.round(-F.log2(F.col("factor").cast("double"))).cast("long")
    return out.groupBy("instrument").agg(F.count("*").alias("n"), F.min(k).alias("low"), F.max(k).alias("high"), F.round(F.sum(F.col("close").cast("double")), 4).alias("total"))


@query("i13_total_return")
def i13(spark, d):
    """Total-return prices with dividends of one percent of the close on every multi-row day."""
    b = bars(spark, d)
    act = b.where("n >= 3").select("instrument", "day", F.lit("cash").alias("kind"), F.lit(None).cast("decimal(38,12)").alias("ratio"), exact.shortest_decimal(F.round(F.col("close") * 0.01, 2)).alias("amount"))
    own = b.select("instrument", "day", exact.shortest_decimal(F.col("close")).alias("close"), exact.shortest_decimal(F.col("volume")).alias("volume"))
    return adjustment.adjusted(own, act, "total_return").select("instrument", "day", F.col("close").cast("double").alias("close"), "factor", "state")


_DRAW = f"WITH {BARS}, h AS (SELECT instrument AS series, day, close, max(close) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS high FROM bars), g AS (SELECT *, close > high * (1 - 0.3) AS invested FROM h)"


@query("f16_drawdown_guard", _DRAW + " SELECT series, count(*) FILTER (WHERE invested) AS inside, count(*) AS n, count(*) FILTER (WHERE invested AND NOT before) AS reentries, round(max(1 - close / high), 8) AS deepest FROM (SELECT *, coalesce(lag(invested) OVER (PARTITION BY series ORDER BY day), TRUE) AS before FROM g) GROUP BY 1")
def f16(spark, d):
    path = bars(spark, d).select(F.col("instrument").cast("string").alias("series"), "day", "close")
    g = ACC.drawdown_guard(path, 0.3, 20)
    return g.groupBy(F.col("series").cast("long").alias("series")).agg(F.count_if("invested").alias("inside"), F.count("*").alias("n"), F.count_if("reentered").alias("reentries"), F.round(F.max("drawdown"), 8).alias("deepest"))


@query("f16_drawdown_reset")
def f16_reset(spark, d):
    """The guard with a reset at re-entry, which needs an ordered fold."""
    path = bars(spark, d).select(F.col("instrument").cast("string").alias("series"), "day", "close")
    return ACC.drawdown_guard(path, 0.3, None, reset=True).groupBy("series").agg(F.count_if("invested").alias("inside"), F.count_if("reentered").alias("reentries"))


_RET = f"WITH {BARS}, r AS (SELECT instrument, day, close / lag(close) OVER (PARTITION BY instrument ORDER BY day) - 1 AS ret FROM bars)"


@query("f22_period_returns", _RET + " SELECT instrument, count(ret) AS n, round(avg(ret), 8) AS mean, round(min(ret), 8) AS low FROM r WHERE ret IS NOT NULL GROUP BY 1")
def f22(spark, d):
    return R.period_returns(bars(spark, d), "instrument", "day", "close").groupBy("instrument").agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 8).alias("mean"), F.round(F.min("ret"), 8).alias("low"))


_SMALL = _RET + ", s AS (SELECT instrument, date_trunc('month', day)::DATE AS day, avg(ret) AS ret FROM r WHERE ret IS NOT NULL GROUP BY 1, 2)"


def monthly_returns(spark, d):
    r = R.period_returns(bars(spark, d), "instrument", "day", "close")
    return r.groupBy("instrument", F.trunc("day", "MM").alias("day")).agg(F.avg("ret").alias("ret"))


@query("e14_sample_covariance", _SMALL + " SELECT a.instrument AS a, b.instrument AS b, round(covar_samp(a.ret, b.ret), 6) AS cov, count(*) AS n FROM s a JOIN s b ON a.day = b.day AND a.instrument <= b.instrument GROUP BY 1, 2")
def e14(spark, d):
    return R.covariance(monthly_returns(spark, d), "instrument", "day").withColumn("cov", F.round("cov", 6))


@query("l9_annualized_volatility", _SMALL + " SELECT instrument, round(stddev_samp(ret) * sqrt(12.0), 6) AS vol, round(least(2.0, 0.15 / (stddev_samp(ret) * sqrt(12.0))), 6) AS scale FROM s GROUP BY 1")
def l9_vol(spark, d):
    v = R.annualized(monthly_returns(spark, d), "instrument", 12)
    return v.select("instrument", F.round("vol", 6).alias("vol"), F.round(R.vol_scale(F.col("vol"), 0.15, 2.0), 6).alias("scale"))


@query("l9_inverse_volatility", _SMALL + ", v AS (SELECT instrument, var_samp(ret) AS var FROM s GROUP BY 1) SELECT instrument, round((1 / sqrt(var)) / sum(1 / sqrt(var)) OVER (), 8) AS weight FROM v")
def l9_inv(spark, d):
    v = monthly_returns(spark, d).groupBy("instrument").agg(F.var_samp("ret").alias("var"))
    return R.inverse_volatility(v, "instrument").withColumn("weight", F.round("weight", 8))


@query("l9_minimum_variance", _SMALL + ", c AS (SELECT a.instrument AS a, b.instrument AS b, var_samp(a.ret) AS va, var_samp(b.ret) AS vb, covar_samp(a.ret, b.ret) AS cv FROM s a JOIN s b ON a.day = b.day AND a.instrument < b.instrument GROUP BY 1, 2) SELECT a, b, round(least(greatest((vb - cv) / (va + vb - 2 * cv), 0.1), 0.9), 6) AS weight FROM c")
def l9_min(spark, d):
    c = R.pair_moments(monthly_returns(spark, d), "instrument", "day").where("a < b")
    return c.select("a", "b", F.round(R.min_variance(F.col("va"), F.col("vb"), F.col("cov"), 0.1, 0.9), 6).alias("weight"))


_STEP = "CASE WHEN instrument % 2 = 1 THEN 0.01 ELSE -0.005 END * (CAST(volume AS BIGINT) % 3)"


def steps(spark, d):
    """Small synthetic returns over the bars' days; instruments 2k and 2k + 1 make a pair."""
    b = bars(spark, d)
    ret = F.when(F.col("instrument") % 2 == 1, 0.01).otherwise(-0.005) * (F.col("volume").cast("long") % 3)
    return b.select(F.floor(F.col("instrument") / 2).alias("series"), "instrument", "day", ret.alias("ret"))


@query("f17_proxy_returns", f"WITH {BARS}, r AS (SELECT instrument // 2 AS series, instrument, day, {_STEP} AS ret, day - lag(day) OVER (PARTITION BY instrument ORDER BY day) AS span FROM bars), p AS (SELECT series, day, (1 + ret) * pow(0.99, coalesce(span, 1) / 365.25) - 1 AS ret, 'donor' AS kind FROM r WHERE instrument % 2 = 1 AND day <= DATE '1998-06-30' UNION ALL SELECT series, day, ret, 'target' FROM r WHERE instrument % 2 = 0 AND day > DATE '1998-06-30') SELECT series, day, kind, round(100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY series ORDER BY day)), 6) AS level FROM p")
def f17(spark, d):
    s = steps(spark, d)
    p = ACC.proxy_returns(s.where("instrument % 2 = 1").drop("instrument"), s.where("instrument % 2 = 0").drop("instrument"), "1998-06-30", 0.01)
    return p.select("series", "day", "kind", F.round("level", 6).alias("level"))


@query("f18_reset_returns", f"WITH {BARS}, r AS (SELECT instrument, day, 2 * ({_STEP}) - 0.0001 + 0.00005 - 0.00002 AS ret FROM bars) SELECT instrument, day, round(100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY instrument ORDER BY day)), 5) AS level FROM r")
def f18(spark, d):
    s = steps(spark, d).withColumn("series", F.col("instrument")).withColumns({"financing": F.lit(0.0001), "collateral": F.lit(0.00005), "expense": F.lit(0.00002)})
    return ACC.reset_returns(s, 2.0).select("instrument", "day", F.round("level", 5).alias("level"))


@query("l6_next_open_nav")
def l6(spark, d):
    """Net asset values of runs of four instruments that rebalance at the open after each month end."""
    return nav(spark, d, F.lit(None).cast("double"))


@query("l7_cashflow_nav")
def l7(spark, d):
    """The same runs with a deposit every hundredth session."""
    return nav(spark, d, F.when(F.col("i") % 100 == 50, 500.0))


def nav(spark, d, flow):
    """A run over each four instruments 4r..4r+3, on the months that have all four."""
    from tidemark.plans.inputs import month_ends

    m = month_ends(spark, d)
    w = W.partitionBy("run", "symbol").orderBy("day")
    p = m.select(F.floor(F.col("asset") / 4).cast("string").alias("run"), F.col("month").alias("day"), F.col("asset").cast("string").alias("symbol"), F.col("close"))
    whole = p.withColumn("n", F.count("*").over(W.partitionBy("run", "day"))).where("n = 4")
    rows = whole.withColumn("i", F.row_number().over(w)).withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    target = F.when(F.col("i") % 3 == 1, F.lit(0.2) + 0.05 * (F.col("symbol").cast("int") % 2))
    out = ACC.next_open(rows.select("run", "day", "symbol", "open", "close", target.alias("target"), flow.alias("flow")), 10_000.0, 0.001)
    return out.select("run", "day", F.round("equity", 6).alias("equity"), F.round("fee", 8).alias("fee"), F.round("unit_value", 8).alias("unit_value"))


@query("e21_run_metrics", f"WITH {BARS} SELECT instrument, arg_max(close, day) AS final, round(arg_max(close, day) / arg_min(close, day) - 1, 8) AS total_return FROM bars GROUP BY 1")
def e21(spark, d):
    g = bars(spark, d).groupBy("instrument").agg(F.max_by("close", "day").alias("final"), F.min_by("close", "day").alias("first"))
    return g.select("instrument", "final", F.round(F.col("final") / F.col("first") - 1, 8).alias("total_return"))


@query("d17_later_actions", f"WITH {BARS}, act AS (SELECT instrument, day FROM bars WHERE n >= 3) SELECT instrument, day, count(act_day) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM (SELECT b.instrument, b.day, a.day AS act_day FROM bars b LEFT JOIN act a ON a.instrument = b.instrument AND a.day = b.day)")
def d17(spark, d):
    w = W.partitionBy("instrument").orderBy("day").rowsBetween(1, W.unboundedFollowing)
    return bars(spark, d).select("instrument", "day", F.count(F.when(F.col("n") >= 3, 1)).over(w).alias("later"))
