"""Risk measures over dated returns and selection among scored trials."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS_A_BLOCK = 4096
CELLS_A_BLOCK = 1 << 20
PAIRS_AT_ONCE = 1 << 18


def period_returns(points: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Simple returns between neighbouring points of a key."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(day))
    return points.withColumn("ret", F.col(value) / before - 1).where("ret is not null")


def _sums(block: dict, days: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per key and day: rows, sum and sum of squares about the key's own level, rows not finite."""
    n = block["n"]
    at = np.repeat(np.arange(len(n)), n) * len(days) + np.searchsorted(days, block["days"])
    ret = block["rets"]
    odd = ~np.isfinite(ret)
    ret = np.where(odd, 0.0, ret)
    edges = np.cumsum(np.append(0, n[:-1]))
    low, high = np.minimum.reduceat(ret, edges), np.maximum.reduceat(ret, edges)
    level = np.where(low == high, low, np.add.reduceat(ret, edges) / n)
    ret = np.where(odd, 0.0, ret - np.repeat(level, n))
    grid = lambda w: np.bincount(at, w, len(n) * len(days)).reshape(len(n), -1)
    return grid(None).astype(float), grid(ret), grid(ret * ret), grid(odd.astype(float))


def _moments(a: dict, b: dict, same: bool) -> Iterator[pa.RecordBatch]:
    """Moments of all pairs of a key of block a and a key of block b, the smaller key first."""
    days = np.union1d(a["days"], b["days"])
    ka, kb = a["key"], b["key"]
    keys = pa.concat_arrays([ka, kb])
    rank = np.empty(len(keys), np.int64)
    rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    (ca, sa, qa, oa), (cb, sb, qb, ob) = _sums(a, days), _sums(b, days)
    odd = oa.any() or ob.any()
    step = max(1, PAIRS_AT_ONCE // len(kb))
    for lo in range(0, len(ka), step):
        c, s, q = ca[lo : lo + step], sa[lo : lo + step], qa[lo : lo + step]
        n, x, y = c @ cb.T, s @ cb.T, c @ sb.T
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb, cov = ((m - u * v / n) / (n - 1) for m, u, v in ((q @ cb.T, x, x), (c @ qb.T, y, y), (s @ sb.T, x, y)))
        if odd:
            none_a, none_b = oa[lo : lo + step] @ cb.T > 0, c @ ob.T > 0
            va[none_a], vb[none_b], cov[none_a | none_b] = np.nan, np.nan, np.nan
        i, j = np.nonzero(n)
        if same:
            i, j = (z[rank[lo + i] <= rank[j]] for z in (i, j))
        turned = rank[lo + i] > rank[len(ka) + j] if not same else np.zeros(len(i), bool)
        first, second = np.where(turned, len(ka) + j, lo + i), np.where(turned, lo + i, len(ka) + j)
        one = n[i, j] < 2
        cells = [np.where(turned, vb[i, j], va[i, j]), np.where(turned, va[i, j], vb[i, j]), cov[i, j]]
        values = [pa.array(v, mask=one) for v in cells]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(first)), keys.take(pa.array(second)), *values, pa.array(n[i, j].astype(np.int64))], ["a", "b", "va", "vb", "cov", "n"])


def pair_moments(returns: DataFrame, key: str, day: str) -> DataFrame:
    """``(a, b, va, vb, cov, n)`` of all pairs of keys a <= b over their common days.

    Sample variances and covariance, null over one day; null keys, days and returns meet nothing.
    Keys are dealt into blocks of KEYS_A_BLOCK or CELLS_A_BLOCK keys times days, and every two blocks meet, so what is shuffled
    is each key's returns once a block; no pair is, and a task holds two blocks and a slice of
    their pairs. There are key count squared rows all the same.
    """
    kind = returns.schema[key].dataType.simpleString()
    plain = returns.select(F.col(key).alias("key"), F.unix_date(F.col(day).cast("date")).alias("day"), F.col("ret").cast("double").alias("ret")).dropna()
    lines = plain.groupBy("key").agg(F.collect_list(F.struct("day", "ret")).alias("p")).select("key", F.col("p.day").alias("days"), F.col("p.ret").alias("rets"))
    n_keys, n_days = plain.agg(F.countDistinct("key"), F.countDistinct("day")).first()
    most = max(1, min(KEYS_A_BLOCK, CELLS_A_BLOCK // max(n_days, 1)))
    blocks = max(-(-n_keys // most), min(6, -(-n_keys // 64)), 1)  # a few at least, so that small tables use several cores
    lines = lines.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = lines.withColumn("other", other).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "days", "rets")

    def met_blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        sides = []
        for own in (i, j):
            t = rows.filter(pc.equal(rows.column("own"), own))
            sides.append({"key": t.column("key").combine_chunks(), "n": pc.list_value_length(t.column("days")).to_numpy(), "days": pc.list_flatten(t.column("days")).to_numpy(), "rets": pc.list_flatten(t.column("rets")).to_numpy()})
        if len(sides[0]["key"]) and len(sides[1]["key"]):
            yield from _moments(*sides, i == j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            pair = b.column("i").to_numpy().astype(np.int64) * blocks + b.column("j").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and lo < hi and pair[lo] != now:
                    yield from met_blocks(held)
                    held = []
                if hi > lo:
                    now = pair[lo]
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from met_blocks(held)

    return met.repartition(blocks * (blocks + 1) // 2, "i", "j").sortWithinPartitions("i", "j").mapInArrow(run, f"a {kind}, b {kind}, va double, vb double, cov double, n long")


def covariance(returns: DataFrame, key: str, day: str) -> DataFrame:
    """Sample covariances of all pairs of keys over their common days (key count squared rows)."""
    return pair_moments(returns, key, day).select("a", "b", "cov", "n")


def annualized(returns: DataFrame, key: str, periods: int) -> DataFrame:
    """Annualised volatility."""
    return returns.groupBy(key).agg((F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("vol"))


def inverse_volatility(variances: DataFrame, key: str) -> DataFrame:
    """Weights proportional to 1 / sqrt(variance)."""
    inv = 1 / F.sqrt("var")
    return variances.select(key, (inv / F.sum(inv).over(W.partitionBy())).alias("weight"))


def vol_scale(realized: Column, target: float, ceiling: float) -> Column:
    """Leverage that meets a target volatility, at most the ceiling."""
    return F.least(F.lit(ceiling), F.lit(target) / realized)


def min_variance(va: Column, vb: Column, cov: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    """First weight of the two-asset minimum-variance mix, clamped; null if degenerate."""
    spread = va + vb - 2 * cov
    good = (va * vb - cov * cov > 0) & (spread > 0)
    return F.when(good, F.least(F.greatest((vb - cov) / spread, F.lit(lower)), F.lit(upper)))


def winner(trials: DataFrame, by: str, score: str, ident: str, *, maximize: bool = True) -> DataFrame:
    """The best complete trial of each study; ties go to the smaller id."""
    key = -F.col(score) if maximize else F.col(score)
    return trials.where(F.col(score).isNotNull()).groupBy(by).agg(F.min(F.struct(key.alias("k"), F.col(ident).alias("id"))).alias("m")).select(by, F.col("m.id").alias("winner"), (-F.col("m.k") if maximize else F.col("m.k")).alias("score"))


def trial_grid(axes: dict[str, DataFrame], by: DataFrame | None = None) -> DataFrame:
    """All combinations of a few declared parameter values, de-duplicated by content hash."""
    names = list(axes)
    grid = axes[names[0]]
    for n in names[1:]:
        grid = grid.crossJoin(F.broadcast(axes[n]))
    hashed = grid.withColumn("trial_id", F.sha2(F.to_json(F.struct(*sorted(names))).cast("binary"), 256))
    return hashed.dropDuplicates(["trial_id"])


def compare_profiles(current: DataFrame, candidates: DataFrame, max_fee_gap: float, min_size: float) -> DataFrame:
    """Candidates (group, id, fee, size, tracking) against the group's current holding: why one
    is out, and the rank of the rest by fee, tracking and id."""
    j = candidates.join(current.select("group", F.col("fee").alias("_fee")), "group")
    reason = F.when(F.col("tracking").isNull(), "no_tracking").when(F.col("size") < min_size, "too_small").when(F.col("fee") > F.col("_fee") + max_fee_gap, "too_dear")
    marked = j.withColumn("reason", reason)
    rank = F.row_number().over(W.partitionBy("group", F.col("reason").isNull()).orderBy("fee", "tracking", "id"))
    return marked.withColumn("rank", F.when(F.col("reason").isNull(), rank)).drop("_fee")
