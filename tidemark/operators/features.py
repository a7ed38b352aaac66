"""Month-end features, signals, allocation, ensembles and schedules as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def month_end_snap(points: DataFrame) -> DataFrame:
    """The last point of each asset's calendar month: (asset, month, as_of, close)."""
    return points.groupBy("asset", F.trunc("as_of", "MM").alias("month")).agg(F.max("as_of").alias("as_of"), F.max_by("close", "as_of").alias("close"))


def history_window(points: DataFrame, as_of: Column, length: int) -> DataFrame:
    """The last ``length`` month ends before the month of ``as_of``, newest ranked 1."""
    rank = F.row_number().over(W.partitionBy("asset").orderBy(F.desc("month")))
    return points.where(F.col("month") < F.trunc(as_of, "MM")).withColumn("rank", rank).where(F.col("rank") <= length)


def contiguous(points: DataFrame) -> DataFrame:
    """(asset, gaps): pairs of neighbouring points that aren't one month apart."""
    index = F.year("month") * 12 + F.month("month")
    gap = index - F.lag(index).over(W.partitionBy("asset").orderBy("month"))
    return points.withColumn("_gap", gap).groupBy("asset").agg(F.sum(F.when(F.col("_gap") != 1, 1).otherwise(0)).alias("gaps"))


def feature_matrix(points: DataFrame, returns: tuple[int, ...], averages: tuple[int, ...], *, current: bool = True) -> DataFrame:
    """Long features (asset, month, kind, horizon, value) at every month with enough history."""
    w = W.partitionBy("asset").orderBy("month")
    out = points
    cols = []
    for n in returns:
        base = F.lag("close", n).over(w)
        cols.append(F.struct(F.lit("return").alias("kind"), F.lit(n).alias("horizon"), F.when(base != 0, F.col("close") / base - 1).alias("value")))
    for n in averages:
        frame = w.rowsBetween(-(n - 1), 0) if current else w.rowsBetween(-n, -1)
        enough = F.count("close").over(frame) == n
        cols.append(F.struct(F.lit("average").alias("kind"), F.lit(n).alias("horizon"), F.when(enough & (F.min("close").over(frame) > 0), F.col("close") / F.avg("close").over(frame)).alias("value")))
    return out.withColumn("_all", F.array(*cols)).select("asset", "month", F.explode("_all").alias("f")).select("asset", "month", "f.kind", "f.horizon", "f.value").where("value is not null")


def momentum(features: DataFrame, weights: dict[int, float], divisor: float) -> DataFrame:
    """Weighted returns over a divisor, where all horizons are present."""
    weight = F.lit(None).cast("double")
    for horizon, w in weights.items():
        weight = F.when(F.col("horizon") == horizon, float(w)).otherwise(weight)
    own = features.where((F.col("kind") == "return") & F.col("horizon").isin(list(weights)))
    score = own.withColumn("_w", weight).groupBy("asset", "month").agg(F.sum(F.col("value") * F.col("_w")).alias("s"), F.count("*").alias("n"))
    return score.where(F.col("n") == len(weights)).select("asset", "month", (F.col("s") / divisor).alias("score"))


def allocate(scores: DataFrame, kind: str, *, top_n: int, floor: Column, switch: Column | None = None, defensive: int = 0, per: str = "month") -> DataFrame:
    """Weights (per, asset, weight) for one of the seven strategy kinds.

    ``floor`` is the reference asset's score in the period. Assets are ranked by score, ties
    by id. ``switch`` moves the selected weight to ``defensive`` equal shares (named
    defensive:i), or, for the cash kind, to cash; what is unused goes to the defensive assets
    if none is held yet, else to cash.
    """
    order = W.partitionBy(per).orderBy(F.desc("score"), "asset")
    every = W.partitionBy(per)
    ranked = scores.withColumn("_ok", F.col("score") >= floor).withColumn("_n", F.count("*").over(every)).withColumn("_rank", F.row_number().over(order))
    best = ranked.withColumn("_okrank", F.sum(F.col("_ok").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_nok", F.sum(F.col("_ok").cast("int")).over(every))
    weight = {
        "equal_weight": 1.0 / F.col("_n"),
        "relative": F.when(F.col("_rank") <= top_n, 1.0 / F.least(F.lit(top_n), F.col("_n"))),
        "absolute": F.when(F.col("_ok"), 1.0 / F.col("_nok")),
        "absolute_defensive": F.when(F.col("_ok"), 1.0 / F.col("_nok")),
    }.get(kind, F.when(F.col("_ok") & (F.col("_okrank") <= top_n), F.lit(1.0 / top_n)))
    picked = best.select(per, F.col("asset").cast("string").alias("asset"), weight.alias("weight"), (F.lit(False) if switch is None else switch).alias("_on"))
    held = picked.where("weight > 0 and not _on").select(per, "asset", "weight")
    total = picked.groupBy(per).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("used"), F.max("_on").alias("_on"))
    moved = F.when(F.col("_on") & F.lit(kind != "relative_absolute_cash" and defensive > 0), F.col("used")).otherwise(0.0)
    left = F.greatest(F.lit(0.0), 1.0 - F.when(F.col("_on") & (moved == 0), 0.0).otherwise(F.col("used")))
    rest = total.withColumn("_moved", moved).withColumn("_left", left)
    shares = F.transform(F.sequence(F.lit(1), F.lit(max(defensive, 1))), lambda i: F.struct(F.concat(F.lit("defensive:"), i.cast("string")).alias("asset"), (F.when(F.col("_moved") > 0, F.col("_moved")).otherwise(F.col("_left")) / max(defensive, 1)).alias("weight")))
    to_defensive = rest.where(F.lit(defensive > 0)).select(per, F.explode(shares).alias("x")).select(per, "x.asset", "x.weight")
    cash = F.when(F.lit(defensive > 0) & (F.col("_moved") == 0), 0.0).otherwise(F.col("_left"))
    to_cash = rest.select(per, F.lit("cash").alias("asset"), cash.alias("weight"))
    return held.unionByName(to_defensive).unionByName(to_cash).where("weight > 0")


def combine(allocations: DataFrame, members: DataFrame, per: str = "month") -> DataFrame:
    """Allocations (per, strategy, asset, weight) under member weights, normalised to one."""
    scale = members.where("member_weight > 0").select("strategy", (F.col("member_weight") / F.sum("member_weight").over(W.partitionBy())).alias("share"))
    summed = allocations.join(F.broadcast(scale), "strategy").groupBy(per, "asset").agg(F.sum(F.col("weight") * F.col("share")).alias("w"))
    total = F.sum("w").over(W.partitionBy(per))
    return summed.where("w > 0").withColumn("weight", F.col("w") / total).drop("w")


def decision_slots(sessions: DataFrame) -> DataFrame:
    """Month-end decisions: the last session of each month and the session after it."""
    w = W.partitionBy("venue").orderBy("session")
    after = sessions.withColumn("fill", F.lead("session").over(w))
    return after.where(F.col("fill").isNotNull() & (F.trunc("fill", "MM") > F.trunc("session", "MM"))).select("venue", F.col("session").alias("decision"), "fill")


def lagged_signal(points: DataFrame, dates: DataFrame, lags: tuple[int, ...], compare: Column) -> DataFrame:
    """OR over lag buckets: true if any present bucket's value passes ``compare``; dates with
    no bucket at all are blocked (null)."""
    lag = dates.crossJoin(F.broadcast(dates.sparkSession.createDataFrame([(n,) for n in lags], "lag int")))
    keyed = lag.withColumn("bucket", F.last_day(F.add_months(F.trunc("signal_date", "MM"), -F.col("lag"))))
    hit = keyed.join(points.withColumnRenamed("as_of", "bucket"), "bucket", "left")
    return hit.groupBy("signal_date").agg(F.bool_or(compare).alias("signal"), F.count("value").alias("n_buckets"))


def negative_count(scores: DataFrame, threshold: int, per: str = "month") -> DataFrame:
    """Whether at least ``threshold`` assets have a bad (negative) score."""
    return scores.groupBy(per).agg((F.sum((F.col("score") < 0).cast("int")) >= threshold).alias("signal"))


def canary(scores: DataFrame, mode: str, per: str = "month") -> DataFrame:
    """All or any of the watched assets bad."""
    return scores.groupBy(per).agg((F.bool_and if mode == "AND" else F.bool_or)(F.col("score") < 0).alias("signal"))
