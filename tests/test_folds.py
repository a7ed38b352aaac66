"""Path-dependent queries in full against plain loops over the same bars."""

import datetime as dt
import json
import math
import os
from collections import defaultdict
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import hashing
from tidemark.operators import asof, planning, quality, requests
from tidemark.plans.inputs import BARS, MONTHS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def series(duck, columns):
    out = defaultdict(list)
    for key, *rest in duck.execute(f"WITH {BARS} SELECT instrument, {columns} FROM bars ORDER BY instrument, day").fetchall():
        out[key].append(rest)
    return out


def test_drawdown_with_reset(spark, duck):
    got = {int(x["series"]): (x["inside"], x["reentries"]) for x in entry.queries()["f16_drawdown_reset"](spark, SF).collect()}
    want = {}
    for key, rows in series(duck, "day, close").items():
        high, inside, held, back = 0.0, True, 0, 0
        for _, close in rows:
            high = max(high, close)
            above = close > high * 0.7
            if above and not inside:
                back, high = back + 1, close
            inside = above
            held += inside
        want[key] = (held, back)
    assert got == want and any(b for _, b in want.values())


def test_total_return_prices(spark, duck):
    got = {(x["instrument"], x["day"]): (x["close"], x["factor"], x["state"]) for x in entry.queries()["i13_total_return"](spark, SF).collect()}
    want = {}
    twelve = Decimal("0.000000000001")
    with localcontext() as ctx:
        ctx.prec = 50
        for key, rows in series(duck, "day, close, n, CAST(round(close * 0.01, 2) AS VARCHAR)").items():
            factor = Decimal(1)
            for i in range(len(rows) - 1, -1, -1):
                day, close, n, cash = rows[i]
                own = Decimal(repr(close))
                want[key, day] = (float((own * factor).quantize(twelve, ROUND_HALF_EVEN)), str(factor.quantize(twelve)), "present")
                if n >= 3 and i:
                    before = Decimal(repr(rows[i - 1][1]))
                    factor *= (before - Decimal(cash)) / before
    assert len(got) == len(want)
    for k, (close, factor, state) in want.items():
        assert got[k][0] == pytest.approx(close, abs=1e-9) and Decimal(got[k][1]) == pytest.approx(Decimal(factor), abs=Decimal("1e-11")) and got[k][2] == state, k


@pytest.mark.parametrize("name", ["l6_next_open_nav", "l7_cashflow_nav"])
def test_net_asset_values(spark, duck, name):
    flows = name.startswith("l7")
    runs = defaultdict(lambda: defaultdict(dict))
    for asset, month, close in duck.execute(f"WITH {MONTHS} SELECT asset, month, close FROM months").fetchall():
        runs[asset // 4][month][asset] = close
    want = {}
    for run, months in runs.items():
        days = [m for m in sorted(months) if len(months[m]) == 4]
        cash, units, shares, pending, last = 10_000.0, dict.fromkeys(range(4 * run, 4 * run + 4), 0.0), 10_000.0, None, None
        for i, day in enumerate(days):
            close, fee = months[day], 0.0
            opens = close if last is None else last
            if i and flows and (i + 1) % 100 == 50:
                shares += 500.0 / ((cash + sum(units[a] * opens[a] for a in units)) / shares)
                cash += 500.0
            if i and pending:
                worth = {a: units[a] * opens[a] for a in units}
                before = value = cash + sum(worth.values())
                for _ in range(300):  # the fee's own fixed point instead of a bisection
                    value = before - 0.001 * math.fsum(abs(pending[a] * value - worth[a]) for a in units)
                fee = before - value
                if all(abs(pending[a] * before - worth[a]) <= 1e-9 * max(1.0, before) for a in units):
                    fee = 0.0
                else:
                    units = {a: pending[a] * value / opens[a] for a in units}
                    cash = value - sum(pending[a] * value for a in units)
            equity = cash + sum(units[a] * close[a] for a in units)
            want[str(run), day] = (equity, fee, equity / shares)
            pending = {a: 0.2 + 0.05 * (a % 2) for a in units} if (i + 1) % 3 == 1 else None
            last = close
    got = {(x["run"], x["day"]): (x["equity"], x["fee"], x["unit_value"]) for x in entry.queries()[name](spark, SF).collect()}
    assert got.keys() == want.keys() and got
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-5), k


def test_quoted_text_is_json(spark):
    texts = ["".join(map(chr, range(1, 40))), 'a"b\\c', "\x1f", "é\U0001f600", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.quoted(F.col("t")).alias("q")).collect()
    assert all(json.loads(r["q"]) == r["t"] for r in rows)


def test_as_of_across_buckets_and_null_keys(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    left = spark.createDataFrame([("a", day(0)), ("a", day(500)), ("a", day(9)), (None, day(300)), ("b", day(5))], "k string, d date")
    right = spark.createDataFrame([("a", day(1), 1.0), ("a", day(9), 2.0), (None, day(2), 3.0), ("b", day(6), 4.0)], "k string, d date, v double")
    got = {(x["k"], x["d"]): x["v"] for x in asof.asof_backward(left, right, "k", "d", "d", ["v"]).collect()}
    assert got == {("a", day(0)): None, ("a", day(500)): 2.0, ("a", day(9)): 2.0, (None, day(300)): 3.0, ("b", day(5)): None}


def test_nearest_rank_of_ties_and_nulls(spark):
    rows = [("x", float(v)) for v in [5] * 300 + list(range(100))] + [("y", None), ("z", 1.0), (None, 7.0), (None, 3.0)]
    got = {x["g"]: (x["p50"], x["p99"], x["n"]) for x in quality.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (50, 99)).collect()}
    ranked = sorted(v for g, v in rows if g == "x")
    assert got == {"x": (ranked[199], ranked[395], 400), "y": (None, None, 0), "z": (1.0, 1.0, 1), None: (3.0, 7.0, 2)}


def test_windows_halve_until_one_day(spark):
    w = spark.createDataFrame([(1, dt.date(2020, 1, 1), dt.date(2020, 1, 4), 9), (2, dt.date(2020, 1, 1), dt.date(2020, 1, 1), 9)], "k int, first date, last date, n int")
    got = sorted((x["k"], x["first"].day, x["last"].day) for x in planning.halved(w, F.col("n"), 5).collect())
    assert got == [(1, 1, 2), (1, 3, 4), (2, 1, 1)]


def test_receipts_tell_nulls_and_repeats(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), ("b", ""), ("b", ""), ("c", "")], "g string, v string")
    got = {x["g"]: (x["n"], x["checksum"]) for x in requests.receipts(rows, ["v"], ["g"]).collect()}
    assert got["b"][1] == 2 * got["c"][1] and got["a"][1] != got["b"][1]
