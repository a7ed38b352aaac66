"""Path-dependent folds: one ordered pass per run, many runs in parallel.

Each is an ``applyInPandas`` over a run or series key. A group is one account's or one
index's daily path, bounded by its calendar, not by the data.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS = 64
SLACK = 1e-9


def rebalanced(cash: float, units: dict, prices: dict, weights: dict, cost: float) -> tuple[float, dict, float]:
    """Cash, units and fee after trading to the weights at the prices.

    The fee is proportional to traded notional and paid from the portfolio, so the value after
    trading solves ``v + fee(v) = value before``, found by bisection.
    """
    names = sorted(set(units) | {s for s, w in weights.items() if w > 0})
    worth = {s: units.get(s, 0.0) * prices[s] for s in names}
    before = cash + math.fsum(worth.values())
    if not math.isfinite(before) or before <= 0:
        raise ArithmeticError("the portfolio has no positive value")
    if all(abs(weights.get(s, 0.0) * before - worth[s]) <= SLACK * max(1.0, before) for s in names):
        return cash, dict(units), 0.0
    fee_at = lambda v: cost * math.fsum(abs(weights.get(s, 0.0) * v - worth[s]) for s in names)
    lo, hi = 0.0, before
    for _ in range(STEPS):
        mid = 0.5 * (lo + hi)
        lo, hi = (lo, mid) if mid + fee_at(mid) > before else (mid, hi)
    value = 0.5 * (lo + hi)
    fee = fee_at(value)
    bought = {s: weights.get(s, 0.0) * value for s in names}
    return max(0.0, before - math.fsum(bought.values()) - fee), {s: x / prices[s] for s, x in bought.items() if x > 0}, fee


NAV = "run string, day date, equity double, cash double, fee double, unit_value double, fund_units double, flow double"


def next_open(days: DataFrame, initial: float, cost: float) -> DataFrame:
    """Net asset values of runs whose close decisions fill at the next session's open.

    ``days`` has a row a run, day and symbol: run, day, symbol, open, close, target (the
    weight decided at that day's close, null if none was) and flow (cash moved at the open,
    the same on all of the day's rows). A day has a decision if any of its targets isn't null.
    A price needed but absent is an error.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        cash, units, shares, rows = initial, {}, initial, []
        pending: dict | None = None
        for i, (day, own) in enumerate(pdf.sort_values(["day", "symbol"], kind="stable").groupby("day", sort=True)):
            opens = {s: p for s, p in zip(own.symbol, own.open, strict=True) if p == p}
            closes = {s: p for s, p in zip(own.symbol, own.close, strict=True) if p == p}
            fee, flow = 0.0, float(own.flow.fillna(0.0).iloc[0])
            if i:
                if flow:
                    worth = cash + math.fsum(q * opens[s] for s, q in units.items())
                    if -flow > cash:
                        raise ValueError("a withdrawal exceeds the cash there is")
                    shares += flow / (worth / shares)
                    cash += flow
                if pending is not None:
                    cash, units, fee = rebalanced(cash, units, opens, pending, cost)
            equity = cash + math.fsum(q * closes[s] for s, q in units.items())
            rows.append((own.run.iloc[0], day, equity, cash, fee, equity / shares, shares, flow if i else 0.0))
            chosen = own[own.target.notna()]
            pending = dict(zip(chosen.symbol, chosen.target, strict=True)) if len(chosen) else None
        return pd.DataFrame(rows, columns=[f.split()[0] for f in NAV.split(", ")])

    return days.groupBy("run").applyInPandas(fold, NAV)


GUARD = "series string, day date, close double, high double, drawdown double, invested boolean, reentered boolean"


def drawdown_guard(path: DataFrame, threshold: float, lookback: int | None = None, reset: bool = False) -> DataFrame:
    """Exit when the close falls to (1 - threshold) of the high, re-enter above it.

    ``lookback`` bounds the high's window; ``reset`` starts it anew at a re-entry. Without a
    reset the flags are plain window functions: invested is whether the close is above the line.
    """
    if not reset:
        w = W.partitionBy("series").orderBy("day")
        frame = w.rowsBetween(W.unboundedPreceding if lookback is None else -(lookback - 1), 0)
        high = path.withColumn("high", F.max("close").over(frame))
        line = high.withColumn("invested", F.col("close") > F.col("high") * (1 - F.lit(threshold)))
        was = F.coalesce(F.lag("invested").over(w), F.lit(True))
        return line.select("series", "day", "close", "high", (1 - F.col("close") / F.col("high")).alias("drawdown"), "invested", (~was & F.col("invested")).alias("reentered"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("day", kind="stable")
        rows, inside, since = [], True, 0
        falling: deque[tuple[int, float]] = deque()  # what may yet be the high, largest first
        for i, (day, close) in enumerate(zip(own.day, own.close.tolist(), strict=True)):
            first = max(since, 0 if lookback is None else i - lookback + 1)
            while falling and falling[-1][1] <= close:
                falling.pop()
            falling.append((i, close))
            while falling[0][0] < first:
                falling.popleft()
            high = falling[0][1]
            above = close > high * (1 - threshold)
            back = above and not inside
            inside = above
            if back:
                since = i
                falling = deque([(i, close)])
            rows.append((own.series.iloc[0], day, close, high, 1 - close / high, inside, back))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in GUARD.split(", ")])

    return path.groupBy("series").applyInPandas(fold, GUARD)


def compounded(returns: DataFrame, base: float = 100.0) -> DataFrame:
    """Index levels from period returns (series, day, ret, ...): base times the running product.

    One ordered pass a series, so equal inputs give equal bits on any cluster. A series is one
    index's path, bounded by its calendar; a null return or a fall to zero or below stays as it
    is from there on.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("day", kind="stable")
        return own.assign(level=base * (1.0 + own.ret).cumprod(skipna=False))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in returns.schema.fields)
    return returns.groupBy("series").applyInPandas(fold, f"{schema}, level double")


def proxy_returns(donor: DataFrame, target: DataFrame, switch: str, annual_fee: float = 0.0) -> DataFrame:
    """Donor returns up to the switch, with a fee drag by calendar days, then the target's."""
    day = F.lit(switch).cast("date")
    span = F.datediff("day", F.lag("day").over(W.partitionBy("series").orderBy("day")))
    drag = F.pow(F.lit(1 - annual_fee), F.coalesce(span, F.lit(1)) / 365.25)
    early = donor.withColumn("ret", (1 + F.col("ret")) * drag - 1).where(F.col("day") <= day).withColumn("kind", F.lit("donor"))
    late = target.where(F.col("day") > day).withColumn("kind", F.lit("target"))
    return compounded(early.unionByName(late))


def reset_returns(rows: DataFrame, multiplier: float) -> DataFrame:
    """Leveraged periods: multiplier * ret - financing + collateral - expense, compounded."""
    ret = F.lit(multiplier) * F.col("ret") - F.col("financing") + F.col("collateral") - F.col("expense")
    return compounded(rows.withColumn("ret", ret))
