"""Strategy research: features, signals, allocation, ensembles, schedules, trials."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import risk as R
from tidemark.plans.inputs import BARS, MONTHS, bars, month_ends, read
from tidemark.plans.registry import query


@query("f11_month_end_snap", f"WITH {MONTHS} SELECT asset, month, as_of, close FROM months")
def f11(spark, d):
    return month_ends(spark, d).select("asset", "month", "as_of", "close")


@query("f11_history_window", f"WITH {MONTHS}, r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY month DESC) AS rank FROM months WHERE month < DATE '1999-05-01') SELECT asset, month, close, rank FROM r WHERE rank <= 13")
def f11_window(spark, d):
    return X.history_window(month_ends(spark, d), F.lit("1999-05-17").cast("date"), 13).select("asset", "month", "close", F.col("rank").cast("long").alias("rank"))


@query("f13_contiguous_months", f"WITH {MONTHS}, g AS (SELECT asset, (year(month) * 12 + month(month)) - lag(year(month) * 12 + month(month)) OVER (PARTITION BY asset ORDER BY month) AS gap FROM months) SELECT asset, CAST(sum(CASE WHEN gap <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM g GROUP BY 1")
def f13(spark, d):
    return X.contiguous(month_ends(spark, d))


_FEATURES = f"""WITH {MONTHS}, f AS (SELECT asset, month, close, lag(close, 1) OVER w AS c1, lag(close, 3) OVER w AS c3, lag(close, 6) OVER w AS c6,
  avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a5, count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n5 FROM months WINDOW w AS (PARTITION BY asset ORDER BY month)),
  long AS (SELECT asset, month, 'return' AS kind, 1 AS horizon, close / c1 - 1 AS value FROM f WHERE c1 IS NOT NULL UNION ALL SELECT asset, month, 'return', 3, close / c3 - 1 FROM f WHERE c3 IS NOT NULL
  UNION ALL SELECT asset, month, 'return', 6, close / c6 - 1 FROM f WHERE c6 IS NOT NULL UNION ALL SELECT asset, month, 'average', 5, close / a5 FROM f WHERE n5 = 5)"""


def feats(spark, d):
    return X.feature_matrix(month_ends(spark, d), (1, 3, 6), (5,))


@query("l1_feature_matrix", _FEATURES + " SELECT asset, month, kind, horizon, round(value, 8) AS value FROM long")
def l1(spark, d):
    return feats(spark, d).withColumn("value", F.round("value", 8))


_SCORE = _FEATURES + ", score AS (SELECT asset, month, sum(value * CASE horizon WHEN 1 THEN 12 WHEN 3 THEN 4 ELSE 2 END) / 18 AS score FROM long WHERE kind = 'return' GROUP BY 1, 2 HAVING count(*) = 3)"


def scores(spark, d):
    return X.momentum(feats(spark, d), {1: 12.0, 3: 4.0, 6: 2.0}, 18.0)


@query("f12_momentum", _SCORE + " SELECT asset, month, round(score, 8) AS score FROM score")
def f12(spark, d):
    return scores(spark, d).withColumn("score", F.round("score", 8))


@query("g1_top_assets", _SCORE + " SELECT month, asset, rank FROM (SELECT month, asset, row_number() OVER (PARTITION BY month ORDER BY score DESC, asset) AS rank FROM score) WHERE rank <= 5")
def g1(spark, d):
    r = F.row_number().over(W.partitionBy("month").orderBy(F.desc("score"), "asset"))
    return scores(spark, d).withColumn("rank", r.cast("long")).where("rank <= 5").select("month", "asset", "rank")


def _alloc_sql(select: str, defensive: int = 0) -> str:
    used = _SCORE + f", picked AS ({select}), used AS (SELECT m.month, coalesce(sum(weight), 0) AS u FROM (SELECT DISTINCT month FROM score) m LEFT JOIN picked USING (month) GROUP BY 1)"
    rest = "SELECT month, 'cash' AS asset, 1 - u AS weight FROM used" if not defensive else " UNION ALL ".join(f"SELECT month, 'defensive:{i}' AS asset, (1 - u) / {defensive} AS weight FROM used" for i in range(1, defensive + 1))
    return used + f" SELECT month, asset, round(weight, 8) AS weight FROM (SELECT month, CAST(asset AS VARCHAR) AS asset, weight FROM picked UNION ALL {rest}) WHERE weight > 0.000001"


_ALLOC = {
    "equal_weight": ("SELECT month, asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY month) AS weight FROM score", 0),
    "relative": ("SELECT month, asset, 1.0::DOUBLE / least(4, n) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY month) AS n, row_number() OVER (PARTITION BY month ORDER BY score DESC, asset) AS r FROM score) WHERE r <= 4", 0),
    "absolute": ("SELECT month, asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY month) AS weight FROM score WHERE score >= 0.1", 0),
    "absolute_defensive": ("SELECT month, asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY month) AS weight FROM score WHERE score >= 0.1", 2),
    "relative_absolute": ("SELECT month, asset, 0.25 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, asset) AS r FROM score WHERE score >= 0.9) WHERE r <= 4", 0),
    "relative_absolute_defensive": ("SELECT month, asset, 0.25 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, asset) AS r FROM score WHERE score >= 0.9) WHERE r <= 4", 2),
    "relative_absolute_cash": ("SELECT month, asset, 0.25 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, asset) AS r FROM score WHERE score >= 0.9) WHERE r <= 4 AND month < DATE '1998-01-01'", 0),
}


def _allocation(kind: str):
    _, defensive = _ALLOC[kind]

    def run(spark, d):
        floor = F.lit(0.9 if kind.startswith("relative_absolute") else 0.1)
        switch = F.col("month") >= F.lit("1998-01-01").cast("date") if kind == "relative_absolute_cash" else None
        out = X.allocate(scores(spark, d), kind, top_n=4, floor=floor, switch=switch, defensive=defensive)
        return out.withColumn("weight", F.round("weight", 8)).where("weight > 0.000001")

    return run


for _kind in _ALLOC:
    query(f"l4_allocate_{_kind}", _alloc_sql(*_ALLOC[_kind]))(_allocation(_kind))


@query(
    "e12_combine_ensemble",
    _SCORE
    + """, a AS (SELECT month, 'eq' AS strategy, CAST(asset AS VARCHAR) AS asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY month) AS weight FROM score
    UNION ALL SELECT month, 'rel', CAST(asset AS VARCHAR), 1.0::DOUBLE / least(4, n) FROM (SELECT *, count(*) OVER (PARTITION BY month) AS n, row_number() OVER (PARTITION BY month ORDER BY score DESC, asset) AS r FROM score) WHERE r <= 4),
    w AS (SELECT month, asset, sum(weight * CASE strategy WHEN 'eq' THEN 0.25 ELSE 0.75 END) AS w FROM a GROUP BY 1, 2) SELECT month, asset, round(w / sum(w) OVER (PARTITION BY month), 8) AS weight FROM w""",
)
def e12(spark, d):
    s = scores(spark, d)
    both = X.allocate(s, "equal_weight", top_n=4, floor=F.lit(0.0)).withColumn("strategy", F.lit("eq")).unionByName(X.allocate(s, "relative", top_n=4, floor=F.lit(0.0)).withColumn("strategy", F.lit("rel"))).where("weight > 0.000001")
    members = spark.createDataFrame([("eq", 1.0), ("rel", 3.0), ("off", 0.0)], "strategy string, member_weight double")
    return X.combine(both, members).withColumn("weight", F.round("weight", 8))


@query("l2_negative_momentum", _SCORE + " SELECT month, sum(CASE WHEN score < 0 THEN 1 ELSE 0 END) >= 10 AS signal FROM score GROUP BY 1")
def l2_neg(spark, d):
    return X.negative_count(scores(spark, d), 10)


@query("l2_canary", _SCORE + " SELECT month, bool_and(score < 0) AS every, bool_or(score < 0) AS some FROM score GROUP BY 1")
def l2_canary(spark, d):
    s = scores(spark, d)
    a = X.canary(s, "AND").withColumnRenamed("signal", "every")
    return a.join(X.canary(s, "OR").withColumnRenamed("signal", "some"), "month")


_MACRO = "macro AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS as_of, round(avg(o_totalprice), 2) AS value FROM orders WHERE month(o_orderdate) % 4 <> 0 GROUP BY 1)"


def macro(spark, d):
    o = read(spark, d, "orders").where(F.month("o_orderdate") % 4 != 0)
    return o.groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("as_of")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))


def month_list(spark, d):
    return read(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("signal_date")).distinct()


@query("l2_lagged_macro", f"WITH {_MACRO}, d AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS signal_date FROM orders), k AS (SELECT signal_date, last_day(CAST(signal_date - to_months(lag) AS DATE)) AS bucket FROM d, (VALUES (1), (2)) l(lag)) SELECT signal_date, bool_or(value < 249000) AS signal, count(value) AS n_buckets FROM k LEFT JOIN macro ON as_of = bucket GROUP BY 1")
def l2_macro(spark, d):
    return X.lagged_signal(macro(spark, d), month_list(spark, d), (1, 2), F.col("value") < 249_000)


@query("l3_trailing_ratio", f"WITH {MONTHS}, o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS flow FROM orders GROUP BY 1), t AS (SELECT month, sum(flow) OVER (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS trail, count(*) OVER (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS n FROM o) SELECT asset, month, round(trail / close, 4) AS ratio FROM months JOIN t USING (month) WHERE n = 12")
def l3(spark, d):
    flow = read(spark, d, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")).agg(F.sum("o_totalprice").alias("flow"))
    w = W.orderBy("month").rowsBetween(-11, 0)  # one row a month
    t = flow.select("month", F.sum("flow").over(w).alias("trail"), F.count("*").over(w).alias("n")).where("n = 12")
    return month_ends(spark, d).join(F.broadcast(t), "month").select("asset", "month", F.round(F.col("trail") / F.col("close"), 4).alias("ratio"))  # one row a month


@query("f19_decision_slots", f"WITH {BARS}, s AS (SELECT instrument AS venue, day AS session, lead(day) OVER (PARTITION BY instrument ORDER BY day) AS fill FROM bars) SELECT venue, session AS decision, fill FROM s WHERE fill IS NOT NULL AND date_trunc('month', fill) > date_trunc('month', session)")
def f19(spark, d):
    return X.decision_slots(bars(spark, d).select(F.col("instrument").alias("venue"), F.col("day").alias("session")))


@query("l15_warmup", f"WITH {MONTHS} SELECT asset, count(DISTINCT month) AS months, count(DISTINCT month) >= 13 AS enough FROM months WHERE month < DATE '1996-06-01' GROUP BY 1")
def l15(spark, d):
    m = month_ends(spark, d).where(F.col("month") < F.lit("1996-06-01").cast("date"))
    return m.groupBy("asset").agg(F.countDistinct("month").alias("months")).withColumn("enough", F.col("months") >= 13)


@query("l11_compare_profiles", "WITH p AS (SELECT p_brand AS grp, p_partkey AS id, p_retailprice AS fee, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 100) / 100.0 END AS tracking FROM part), c AS (SELECT grp, min(fee) AS f0 FROM p GROUP BY 1), r AS (SELECT p.*, CASE WHEN tracking IS NULL THEN 'no_tracking' WHEN size < 10 THEN 'too_small' WHEN fee > f0 + 80 THEN 'too_dear' END AS reason FROM p JOIN c USING (grp)) SELECT id, reason, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY grp, reason IS NULL ORDER BY fee, tracking, id) END AS rank FROM r")
def l11(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("fee"), F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") % 100) / 100.0).alias("tracking"))
    current = p.groupBy("group").agg(F.min("fee").alias("fee"))
    return R.compare_profiles(current, p, 80.0, 10.0).select("id", "reason", F.col("rank").cast("long").alias("rank"))


@query("g15_trial_grid", "SELECT lookback, top_n, count(*) AS n FROM (VALUES (3), (6), (12)) a(lookback), (VALUES (1), (2), (3), (4)) b(top_n), (VALUES ('x'), ('y')) c(mode) GROUP BY 1, 2")
def g15(spark, d):
    axis = lambda name, kind, values: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    grid = R.trial_grid({"lookback": axis("lookback", "int", [3, 6, 12]), "top_n": axis("top_n", "int", [1, 2, 3, 4]), "mode": axis("mode", "string", ["x", "y"])})
    return grid.groupBy("lookback", "top_n").agg(F.count("*").alias("n"))


@query("e25_trial_winner", "SELECT study, winner, score FROM (SELECT p_brand AS study, p_partkey AS winner, round(p_retailprice, 2) AS score, row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice, 2) DESC, p_partkey) AS r FROM part WHERE p_size > 10) WHERE r = 1")
def e25(spark, d):
    t = read(spark, d, "part").select(F.col("p_brand").alias("study"), F.col("p_partkey").alias("trial"), F.when(F.col("p_size") > 10, F.round("p_retailprice", 2)).alias("score"))
    return R.winner(t, "study", "score", "trial")


@query("l12_holdout_contamination", "WITH t AS (SELECT p_brand AS study, p_partkey AS trial, p_type AS parent FROM part), h AS (SELECT DISTINCT parent FROM t WHERE trial < 100) SELECT study, count(*) AS trials, count(*) FILTER (WHERE parent IN (SELECT parent FROM h)) AS contaminated FROM t WHERE trial >= 100 GROUP BY 1")
def l12(spark, d):
    t = read(spark, d, "part").select(F.col("p_brand").alias("study"), F.col("p_partkey").alias("trial"), F.col("p_type").alias("parent"))
    used = t.where("trial < 100").select("parent").distinct().withColumn("_u", F.lit(True))
    j = t.where("trial >= 100").join(used, "parent", "left")
    return j.groupBy("study").agg(F.count("*").alias("trials"), F.count("_u").alias("contaminated"))


@query("e13_compose_portfolio", "WITH b AS (SELECT s_nationkey AS module, s_suppkey AS asset, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY s_nationkey) AS weight FROM supplier WHERE s_nationkey < 4) SELECT CAST(asset AS VARCHAR) AS asset, round(sum(0.2 * weight), 8) AS weight FROM b GROUP BY 1 UNION ALL SELECT 'cash', round(1 - 0.2 * (SELECT count(DISTINCT module) FROM b), 8)")
def e13(spark, d):
    s = read(spark, d, "supplier").where("s_nationkey < 4")
    b = s.select(F.col("s_nationkey").alias("module"), F.col("s_suppkey").cast("string").alias("asset"), (F.lit(0.2) / F.count("*").over(W.partitionBy("s_nationkey"))).alias("weight"))
    held = b.groupBy("asset").agg(F.round(F.sum("weight"), 8).alias("weight"))
    cash = b.agg(F.round(1 - F.lit(0.2) * F.countDistinct("module"), 8).alias("weight")).select(F.lit("cash").alias("asset"), "weight")
    return held.unionByName(cash)


@query("e16_trailing_window", f"WITH {BARS} SELECT instrument, day, round(sum(volume) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW), 2) AS trail FROM bars")
def e16(spark, d):
    w = W.partitionBy("instrument").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long")).rangeBetween(-30, 0)
    return bars(spark, d).select("instrument", "day", F.round(F.sum("volume").over(w), 2).alias("trail"))


@query("f14_latest_complete_month", f"WITH {MONTHS} SELECT asset, max(month) AS month, arg_max(close, month) AS close FROM months WHERE month < DATE '2000-03-01' GROUP BY 1")
def f14(spark, d):
    m = month_ends(spark, d).where(F.col("month") < F.lit("2000-03-01").cast("date"))
    return m.groupBy("asset").agg(F.max("month").alias("month"), F.max_by("close", "month").alias("close"))


@query("l5_replay_positions", _SCORE + ", p AS (SELECT month, asset, row_number() OVER (PARTITION BY month ORDER BY score DESC, asset) AS r FROM score), n AS (SELECT p.month, p.asset, m.close / b.close - 1 AS next FROM p JOIN months b ON b.asset = p.asset AND b.month = p.month JOIN months m ON m.asset = p.asset AND m.month = CAST(p.month + INTERVAL 1 MONTH AS DATE) WHERE r <= 4) SELECT month, round(sum(next) / 4, 8) AS ret, count(*) AS held FROM n GROUP BY 1")
def l5(spark, d):
    m = month_ends(spark, d)
    pick = scores(spark, d).withColumn("r", F.row_number().over(W.partitionBy("month").orderBy(F.desc("score"), "asset"))).where("r <= 4")
    now = pick.join(m.select("asset", "month", "close"), ["asset", "month"])
    after = m.select("asset", F.add_months("month", -1).alias("month"), F.col("close").alias("later"))
    return now.join(after, ["asset", "month"]).groupBy("month").agg(F.round(F.sum(F.col("later") / F.col("close") - 1) / 4, 8).alias("ret"), F.count("*").alias("held"))
