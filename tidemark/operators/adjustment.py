"""Split- and dividend-adjusted prices with exact decimals.

Bars and actions of one instrument meet in a co-grouped pandas step; a group is one
instrument's history. Factors multiply at 50 digits and results round half to even.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions.exact import SCALE, scaled

OUT = "instrument long, day date, close decimal(38,12), volume decimal(38,12), factor string, state string"


def adjusted(bars: DataFrame, actions: DataFrame, basis: str = "split") -> DataFrame:
    """``bars`` (instrument, day, close, volume) under ``actions`` (instrument, day, kind,
    ratio, amount) with later ex-dates.

    A ratio action divides earlier prices and multiplies earlier volumes; with the
    total-return basis a cash amount D scales earlier prices by (C - D) / C, C being the last
    close before the ex-date. An action that can't be applied makes all earlier bars invalid.
    """

    names = ["instrument", "day", "kind", "ratio", "amount"]
    apart = actions.select(*[actions[c].alias(f"action_{c}") for c in names])

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.set_axis(names, axis=1)
        if left.empty:
            return pd.DataFrame(columns=[f.split()[0] for f in OUT.split(", ")])
        own = left.sort_values("day", kind="stable")
        days, closes = own.day.tolist(), own.close.tolist()
        steps = []
        with localcontext() as ctx:
            ctx.prec = 50
            for a in right.sort_values("day", kind="stable").itertuples():
                if not days[0] < a.day <= days[-1]:
                    continue
                if a.kind == "ratio":
                    good = a.ratio is not None and a.ratio > 0
                    steps.append((a.day, 1 / a.ratio if good else None, a.ratio if good else Decimal(1)))
                elif a.kind == "cash" and basis == "total_return":
                    c = next(c for d, c in zip(reversed(days), reversed(closes), strict=True) if d < a.day)
                    good = c is not None and a.amount is not None and 0 < a.amount < c
                    steps.append((a.day, (c - a.amount) / c if good else None, Decimal(1)))
                elif a.kind != "cash":
                    steps.append((a.day, None, Decimal(1)))
            steps.sort(key=lambda s: s[0])
            price, volume, rows = Decimal(1), Decimal(1), []
            for bar in own.iloc[::-1].itertuples():
                while steps and steps[-1][0] > bar.day:
                    _, p, v = steps.pop()
                    price = None if price is None or p is None else price * p
                    volume *= v
                ok = price is not None
                rows.append((bar.instrument, bar.day, scaled(bar.close, price), scaled(bar.volume, volume) if ok else None, str(price.quantize(SCALE)) if ok else None, "present" if ok else "invalid"))
        return pd.DataFrame(rows[::-1], columns=[f.split()[0] for f in OUT.split(", ")])

    return bars.groupBy("instrument").cogroup(apart.groupBy("action_instrument")).applyInPandas(one, OUT)
