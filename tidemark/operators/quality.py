"""Predicates and audits of price rows; comparisons that keep NaN out, as SQL engines differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OHLC = (("high", "<", "open"), ("high", "<", "close"), ("high", "<", "low"), ("low", ">", "open"), ("low", ">", "close"))


def finite(x: Column) -> Column:
    """Neither NaN nor infinite nor null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def guarded(left: Column, op: str, right: Column) -> Column:
    """A comparison that no NaN passes; infinities compare as numbers."""
    tests = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, "=": left == right, "<>": left != right}
    return ~F.isnan(left) & ~F.isnan(right) & tests[op]


def ohlc_anomaly() -> Column:
    """A bar whose range doesn't hold its prices."""
    out = F.lit(False)
    for a, op, b in OHLC:
        out = out | F.coalesce(guarded(F.col(a), op, F.col(b)), F.lit(False))
    return out


def bad_value() -> Column:
    """A non-finite price or a negative or non-finite volume."""
    return ~(finite(F.col("open")) & finite(F.col("high")) & finite(F.col("low")) & finite(F.col("close")) & finite(F.col("volume")) & (F.col("volume") >= 0))


def duplicate_count(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows beyond the first of their key, by partition."""
    return rows.groupBy(*dict.fromkeys([*keys, *by])).agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum(F.col("n") - 1).alias("duplicates"))


def decimal_state(text: Column, signed: bool = False) -> Column:
    """present, missing or invalid for decimal text; anchored at both ends of the text."""
    shape = r"\A" + ("-?" if signed else "") + r"[0-9]+(\.[0-9]+)?\z"
    return F.when(text.isNull() | (text == ""), "missing").when(text.rlike(shape), "present").otherwise("invalid")


def bar_state(states: list[Column]) -> Column:
    """A bar is invalid if any part is, missing if all are, partial if some are."""
    bad = sum(((s == "invalid").cast("int") for s in states), F.lit(0))
    none = sum(((s == "missing").cast("int") for s in states), F.lit(0))
    return F.when(bad > 0, "invalid").when(none == len(states), "missing").when(none > 0, "partial").otherwise("present")


def admitted() -> Column:
    """A clean bar: finite positive prices within their range."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    good = F.lit(True)
    for p in prices:
        good = good & finite(p) & (p > 0)
    return good & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))


def staleness(observed: Column, as_of: Column, limit: int) -> Column:
    """Why a reading can't be used: after the cutoff, too old, or null if it can."""
    return F.when(observed.isNull(), "unknown").when(observed > as_of, "post_cutoff").when(F.datediff(as_of, observed) > limit, "stale")


def frame_kind(start: Column, stop: Column) -> Column:
    """A reported period by its day span: instant, quarter, annual or other."""
    span = F.datediff(stop, start)
    return F.when(start.isNull(), "instant").when(span.between(60, 120), "quarter").when(span.between(330, 380), "annual").otherwise("other")


def nearest_rank(rows: DataFrame, by: list[str], value: str, percents: tuple[int, ...], cells: int = 64) -> DataFrame:
    """Exact percentiles by nearest rank, ceil(n p / 100); null values don't count.

    Approximate quantiles cut each group's values into cells, whose counts tell which cell holds
    each rank; only that cell's distinct values are ranked. So no group is gathered in one task.
    """
    from pyspark.sql import Window as W

    own = rows.select(*by, F.col(value).alias("_v"))
    bounds = own.groupBy(*by).agg(F.percentile_approx("_v", [i / cells for i in range(1, cells)], F.lit(100 * cells)).alias("_q"), F.count("_v").alias("n"))
    same = lambda a, b, names: F.expr(" AND ".join(f"{a}.`{c}` <=> {b}.`{c}`" for c in names))
    celled = own.where(F.col("_v").isNotNull()).alias("a").join(bounds.alias("b"), same("a", "b", by))
    celled = celled.select(*[F.col(f"a.{c}") for c in by], "_v", F.size(F.filter("_q", lambda q: q < F.col("_v"))).alias("_c"))
    counts = celled.groupBy(*by, "_c").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(W.partitionBy(*by).orderBy("_c"))
    asked = F.explode(F.array(*[F.lit(p) for p in percents])).alias("_p")
    ranks = bounds.select(*by, "n", asked).withColumn("_r", F.ceil(F.col("n") * F.col("_p") / 100))
    spans = counts.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("_m"))
    hit = ranks.alias("r").join(spans.alias("s"), same("r", "s", by) & (F.col("_r") > F.col("_lo")) & (F.col("_r") <= F.col("_hi")))
    hit = hit.select(*[F.col(f"r.{c}") for c in by], "_p", "_c", (F.col("_r") - F.col("_lo")).alias("_k"))
    near = celled.alias("a").join(hit.select(*by, "_c").distinct().alias("h"), same("a", "h", [*by, "_c"])).select(*[F.col(f"a.{c}") for c in by], "a._c", "_v")
    values = near.groupBy(*by, "_c", "_v").agg(F.count("*").alias("_m"))
    stop = F.sum("_m").over(W.partitionBy(*by, "_c").orderBy("_v"))
    values = values.withColumn("_hi", stop).withColumn("_lo", F.col("_hi") - F.col("_m"))
    found = hit.alias("h").join(values.alias("v"), same("h", "v", [*by, "_c"]) & (F.col("_k") > F.col("_lo")) & (F.col("_k") <= F.col("_hi")))
    found = found.groupBy(*[F.col(f"h.{c}") for c in by]).agg(*[F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{p}") for p in percents])
    out = bounds.alias("b").join(found.alias("f"), same("b", "f", by), "left")
    return out.select(*[F.col(f"b.{c}") for c in by], *[f"p{p}" for p in percents], "n")


def session_gaps(held: DataFrame, sessions: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of sessions without a held row since each key's first: (keys, first, last, n).

    Held days take their session's number, and a gap is a step of more than one between a day
    and the next, or the last and the calendar's end. Days off the calendar are ignored.
    """
    from pyspark.sql import Window as W

    number = F.row_number().over(W.orderBy(day)).cast("long")  # one row a session
    calendar = F.broadcast(sessions.select(day).distinct().withColumn("_i", number))
    own = held.select(*keys, day).distinct().join(calendar, day).select(*keys, "_i")
    after = F.lead("_i").over(W.partitionBy(*keys).orderBy("_i"))
    end = F.broadcast(calendar.agg((F.max("_i") + 1).alias("_end")))
    steps = own.withColumn("_to", after).join(end, F.lit(True)).withColumn("_to", F.coalesce("_to", "_end")).where("_to > _i + 1")
    first, last = (calendar.select(F.col("_i").alias(f"_{n}"), F.col(day).alias(n)) for n in ("first", "last"))
    dated = steps.join(F.broadcast(first), F.col("_first") == F.col("_i") + 1).join(F.broadcast(last), F.col("_last") == F.col("_to") - 1)
    return dated.select(*keys, "first", "last", (F.col("_to") - F.col("_i") - 1).alias("n"))


def gaps(grid: DataFrame, held: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive grid days without a held row: (keys, first, last, n)."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(*keys).orderBy(day))
    missing = grid.withColumn("_i", place).join(held.select(*keys, day).distinct(), [*keys, day], "left_anti")
    run = F.col("_i") - F.row_number().over(W.partitionBy(*keys).orderBy(day))
    return missing.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n")).drop("_run")
