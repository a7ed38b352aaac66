"""Operators against small folds written from their definitions."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions import identifiers as ID
from tidemark.operators import accounting, adjustment, asof, temporal
from tidemark.sources import formats, storage


def fold(rows, cutoff, ingestion):
    heads = {}
    for r in sorted(rows, key=lambda r: r["sequence"]):
        if ingestion is not None and r["ingested"] > ingestion:
            continue
        if cutoff is not None:
            if r["known"] is None or r["known"] > cutoff:
                continue
            if r["available"] is None or r["available"] > cutoff:
                if r["op"] != "ASSERT":
                    heads.pop(r["record_id"], None)
                continue
            if r["role"] == "reference":
                continue
        heads[r["record_id"]] = r
    return sorted((k, v["sequence"]) for k, v in heads.items() if v["op"] != "TOMBSTONE")


@pytest.mark.parametrize("seed", range(4))
def test_heads_match_the_fold(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(300):
        clock = lambda: None if r.random() < 0.15 else r.randrange(100)
        rows.append({"record_id": f"r{r.randrange(25)}", "sequence": i, "op": r.choice(["ASSERT", "SUPERSEDE", "SUPERSEDE", "TOMBSTONE"]), "known": clock(), "available": clock(), "ingested": r.randrange(140), "role": r.choice(["primary", "primary", "reference"])})
    df = spark.createDataFrame(rows, "record_id string, sequence long, op string, known long, available long, ingested long, role string")
    for cutoff, ingestion in [(None, None), (None, 60), (50, None), (80, 70), (1000, 1000)]:
        got = sorted((x["record_id"], x["sequence"]) for x in temporal.project_heads(df, cutoff, ingestion).collect())
        assert got == fold(rows, cutoff, ingestion)
    cuts = [(i, c) for i, c in enumerate((10, 50, 90))]
    many = temporal.project_revisions(df, cuts).collect()
    for i, c in cuts:
        assert sorted((x["record_id"], x["sequence"]) for x in many if x["cutoff_id"] == i) == fold(rows, c, None)


def test_heads_rank_in_one_shuffle(spark):
    df = spark.range(10).selectExpr("cast(id as string) record_id", "id sequence", "'ASSERT' op", "id known", "id available", "id ingested", "'primary' role")
    plan = temporal.project_heads(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan


def test_asof_is_backward_with_tolerance(spark):
    day = lambda n: dt.date(2024, 1, n)
    left = spark.createDataFrame([("a", day(5)), ("a", day(20)), ("b", day(5)), ("a", day(3))], "k string, d date")
    right = spark.createDataFrame([("a", day(3), 1.0), ("a", day(4), 2.0), ("c", day(1), 9.0)], "k string, f date, v double")
    got = {(r["k"], r["d"].day): r["v"] for r in asof.asof_backward(left, right, "k", "d", "f", ["v"], 10).collect()}
    assert got == {("a", 5): 2.0, ("a", 20): None, ("b", 5): None, ("a", 3): 1.0}


def test_rebalance_finances_itself():
    cash, units, fee = accounting.rebalanced(1000.0, {}, {"x": 10.0, "y": 20.0}, {"x": 0.6, "y": 0.4}, 0.01)
    assert cash + sum(units[s] * p for s, p in (("x", 10.0), ("y", 20.0))) + fee == pytest.approx(1000.0)
    assert fee == pytest.approx(0.01 * (units["x"] * 10 + units["y"] * 20))


def test_next_open_holds_and_fails_on_missing_prices(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("r", day(1), "x", 10.0, 10.0, 1.0, None), ("r", day(2), "x", 10.0, 11.0, None, None), ("r", day(3), "x", 12.0, 12.0, None, None)]
    df = spark.createDataFrame(rows, "run string, day date, symbol string, open double, close double, target double, flow double")
    got = [r["equity"] for r in accounting.next_open(df, 100.0, 0.0).orderBy("day").collect()]
    assert got == pytest.approx([100.0, 110.0, 120.0])
    gap = df.withColumn("close", F.when(F.dayofmonth("day") == 3, None).otherwise(F.col("close")))
    with pytest.raises(Exception, match="x"):
        accounting.next_open(gap, 100.0, 0.0).collect()


def test_split_and_dividend_factors(spark):
    day = lambda n: dt.date(2024, 1, n)
    d = Decimal
    bars = spark.createDataFrame([(1, day(i), d("10"), d("100")) for i in (2, 3, 4)], "instrument long, day date, close decimal(38,12), volume decimal(38,12)")
    acts = spark.createDataFrame([(1, day(3), "ratio", d(3), None), (1, day(4), "cash", None, d("1"))], "instrument long, day date, kind string, ratio decimal(38,12), amount decimal(38,12)")
    got = {r["day"].day: (r["close"], r["volume"]) for r in adjustment.adjusted(bars, acts, "total_return").collect()}
    assert got[4] == (d("10"), d("100")) and got[3] == (d("9"), d("100"))
    assert got[2] == (d("3.000000000000"), d("300"))
    odd = acts.where("kind = 'ratio'").withColumn("ratio", F.lit(0).cast("decimal(38,12)"))
    assert {r["day"].day: r["state"] for r in adjustment.adjusted(bars, odd).collect()} == {2: "invalid", 3: "present", 4: "present"}


def test_exact_decimals():
    assert exact.exact("1.50") == Decimal("1.5") and exact.exact("1e3") == 1000
    assert exact.exact("0.0000000000001") is None and exact.exact("1e27") is None and exact.exact("x") is None
    assert exact.shortest(0.1) == Decimal("0.1")


def test_check_digits(spark):
    row = spark.range(1).select(
        ID.isin_valid(F.lit("US0378331005")).alias("a"), ID.isin_valid(F.lit("US0378331006")).alias("b"), ID.cusip_valid(F.lit("037833100")).alias("c"),
        ID.figi_valid(F.lit("BBG000B9XRY4")).alias("d"), ID.lei_valid(F.lit("HWUPKR0MPOU8FGXBT394")).alias("e"), ID.lei_valid(F.lit("HWUPKR0MPOU8FGXBT395")).alias("f"),
    ).first()
    assert tuple(row) == (True, False, True, True, True, False)


def test_chain_compares_and_sets(spark):
    chain = storage.Chain(spark, storage.scratch(spark))
    rows = spark.range(3)
    assert chain.publish(rows, 0) == 1
    with pytest.raises(ValueError):
        chain.publish(rows, 0)
    assert chain.publish(rows, 1) == 2 and chain.read().count() == 6 and chain.read(1).count() == 3


def test_raw_store_is_content_addressed(spark):
    root = storage.scratch(spark)
    digest = storage.put_raw(spark, root, b"\0abc")
    assert storage.put_raw(spark, root, b"\0abc") == digest and storage.get_raw(spark, root, digest) == b"\0abc"


def test_csv_with_another_header_fails(spark):
    path = storage.scratch(spark)
    spark.createDataFrame([("1", "2")], "a string, b string").write.option("header", True).csv(path)
    assert formats.text_csv(spark, path, ["a", "b"]).count() == 1
    with pytest.raises(Exception):
        formats.text_csv(spark, path, ["a", "c"]).collect()


def test_drawdown_reset(spark):
    values = [100.0, 70.0, 60.0, 95.0, 90.0]
    df = spark.createDataFrame([("s", dt.date(2024, 1, i + 1), v) for i, v in enumerate(values)], "series string, day date, close double")
    got = accounting.drawdown_guard(df, 0.2, None, reset=True).orderBy("day").collect()
    assert [r["invested"] for r in got] == [True, False, False, True, True] and got[4]["high"] == 95.0


def test_publication_happens_once(spark, tmp_path):
    from tidemark.sources.journal import Journal, payload_of, publish_once, recover
    from tidemark.sources.storage import Chain

    chain, journal = Chain(spark, f"{tmp_path}/chain"), Journal(spark, f"{tmp_path}/journal")
    one, two = spark.range(3), spark.range(5)
    assert [publish_once(chain, journal, "a", one, ["id"], 0) for _ in range(2)] == [1, 1]
    assert chain.read().count() == 3
    with pytest.raises(ValueError, match="another request"):
        publish_once(chain, journal, "a", two, ["id"], 0)
    with pytest.raises(ValueError, match="superseded"):
        publish_once(chain, journal, "b", two, ["id"], 0)
    journal.prepare("c", {"parent": 1, "payload": payload_of(two, ["id"])})
    assert recover(chain, journal) == {"c": "pending"}
    chain.publish(two, 1, payload_of(two, ["id"]))
    assert recover(chain, journal) == {"c": "published"} and recover(chain, journal) == {}
    assert publish_once(chain, journal, "c", two, ["id"], 1) == 2 and chain.read().count() == 8


def test_exact_decimal_equals_python(spark):
    from tidemark.functions.exact import exact, exact_decimal

    texts = ["1", "-0.5", "1e3", "12.3456789012345", "9" * 26, "9" * 27, "", "x", "NaN", "1.", ".5", "+7.250000000000", "1" * 20 + ".123456789012", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", exact_decimal(df["t"]).alias("v")).collect()}
    assert got == {i: exact(t) for i, t in enumerate(texts)}


def test_mappers_refuse_and_keep(spark):
    from tidemark.operators import provider_mappers  # noqa: F401
    from tidemark.operators.mappers import apply_mapper

    held = spark.createDataFrame([("partial_response", '{"code":"A","exchange":"US","date":"2024-01-02","close":"7"}'), ("partial_response", None), (None, "[]")], "reason string, row_json string")
    rows = apply_mapper("bars.bulk_held@1", held).collect()
    assert len(rows) == 3 and {r["value_state"] for r in rows} == {"invalid", "missing"} and sum(r["day"] is not None for r in rows) == 1
    days = spark.createDataFrame([("x", "a", "2024-01-01"), ("x", "b", "2024-01-01"), ("x", "a", "2024-01-02"), ("y", "c", "2024-01-01")], "market string, token string, seen string")
    lists = days.withColumn("seen", days["seen"].cast("date"))
    bars = spark.createDataFrame([("b", "2023-12-29")], "token string, day string")
    gone = apply_mapper("status.absent@1", lists, bars=bars.withColumn("day", bars["day"].cast("date"))).collect()
    assert [(r["token"], str(r["day"]), r["unverified"]) for r in gone] == [("b", "2023-12-30", False)]  # market y has no list that day
    assert apply_mapper("status.absent@1", lists.limit(0), bars=bars.withColumn("day", bars["day"].cast("date"))).count() == 0
    with pytest.raises(ValueError, match="needs"):
        apply_mapper("bars.bulk_held@1", held.drop("reason"))


def test_shortest_decimal_equals_python(spark):
    from tidemark.functions.exact import shortest, shortest_decimal

    rng = random.Random(7)
    values = [0.0, -0.0, 0.1, 1 / 3, 2e-3, 1e-5, 123456.7891, 9999999999.9999, 1e10, 1e25, 1e26, -4.35, 0.00005, float("nan"), float("inf"), None]
    values += [round(rng.uniform(-1e6, 1e6), rng.randrange(8)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r["i"]: r["d"] for r in df.select("i", shortest_decimal(df["v"]).alias("d")).collect()}
    assert got == {i: shortest(v) for i, v in enumerate(values)}


def test_lineage_beyond_a_million_steps(spark, tmp_path):
    from tidemark.plans import catalog

    keys = spark.range(150_000).union(spark.createDataFrame([(2**63 - 1,), (-5,), (None,)], "id long"))
    keys.withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.child: r.depth for r in catalog.QUERIES["g12_lineage_cycles"](spark, str(tmp_path)).collect()}
    assert got == {k: max(1, k.bit_length()) for k in range(150_000)} | {2**63 - 1: 63, -5: 1, None: 1}


def test_pair_moments_shuffle_no_pairs(spark, monkeypatch):
    import itertools
    import statistics

    from tidemark.operators import risk

    monkeypatch.setattr(risk, "KEYS_A_BLOCK", 7)
    monkeypatch.setattr(risk, "PAIRS_AT_ONCE", 16)
    r = random.Random(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(9)]
    rets = {(f"k{k}", d): r.uniform(-1, 1) + (k == 3) * 1e6 for k in range(30) for d in days if r.random() < 0.5 or k < 4}
    rets |= {("one", days[0]): 0.5, ("flat", days[0]): 0.1, ("flat", days[1]): 0.1, ("flat", days[2]): 0.1}
    rows = [(k, d, v) for (k, d), v in rets.items()] + [(None, days[0], 1.0), ("k1", None, 1.0), ("one", days[1], None)]
    df = spark.createDataFrame(rows, "asset string, day date, ret double")
    out = risk.covariance(df, "asset", "day")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for a, b in itertools.combinations_with_replacement(sorted({k for k, _ in rets}), 2):
        if common := [d for d in days if (a, d) in rets and (b, d) in rets]:
            x, y = ([rets[k, d] for d in common] for k in (a, b))
            more = len(common) > 1
            want[a, b] = (*(pytest.approx(v, abs=1e-6) if more else None for v in ((statistics.variance(x), statistics.variance(y), statistics.covariance(x, y)) if more else (0, 0, 0))), len(common))
    got = {(m.a, m.b): (m.va, m.vb, m.cov, m.n) for m in risk.pair_moments(df, "asset", "day").collect()}
    assert got == want and out.count() == len(want)
    assert risk.covariance(df.where("asset = 'no'"), "asset", "day").count() == 0


@pytest.mark.parametrize(("n", "width", "empty"), [(1, 9, 0), (300, 40, 0), (2000, 400, 0), (400, 3000, 0), (200, 30, 1)])
def test_overlap_sums_match_all_pairs(n, width, empty):
    import numpy as np

    r = np.random.default_rng(n)
    f, g = r.integers(0, width, n), r.integers(0, width, n)
    t = np.where(r.random(n) < 0.2, asof.OPEN_DAY, f + r.integers(1 - empty, width, n))
    u = np.where(r.random(n) < 0.2, asof.OPEN_DAY, g + r.integers(1, width, n))
    ident = r.permutation(np.arange(10 * n))[:n]
    i, j = np.triu_indices(n, 1)
    hit = (f[i] < t[j]) & (f[j] < t[i]) & (g[i] < u[j]) & (g[j] < u[i])
    want = int(hit.sum()), int(((ident[i] + ident[j]) % 997)[hit].sum())
    assert asof.overlap_sums(f, t, g, u, ident, 997) == want == asof.overlap_sums(f, t, g, u, ident, 997, 7)
