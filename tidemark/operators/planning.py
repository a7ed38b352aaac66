"""Plans of collection and publication: windows, watermarks, steps, candidates, parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window_chunks(spans: DataFrame, start: str, stop: str, days: int) -> DataFrame:
    """Closed spans cut into consecutive windows of at most ``days`` days: (..., first, last)."""
    firsts = F.sequence(F.col(start), F.col(stop), F.expr(f"INTERVAL {days} DAYS"))
    each = spans.withColumn("first", F.explode(firsts))
    return each.withColumn("last", F.least(F.date_add("first", days - 1), F.col(stop))).drop(start, stop)


def halved(windows: DataFrame, counts: Column, cap: int) -> DataFrame:
    """Windows whose answer may be cut off (``cap`` rows or more) in halves; one-day windows
    can't be split and come back as they are."""
    full = (counts >= cap) & (F.col("last") > F.col("first"))
    middle = F.date_add("first", F.floor(F.datediff("last", "first") / 2).cast("int"))
    whole = F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("z")))
    two = F.array(F.struct(F.col("first").alias("a"), middle.alias("z")), F.struct(F.date_add(middle, 1).alias("a"), F.col("last").alias("z")))
    keep = [c for c in windows.columns if c not in ("first", "last")]
    return windows.withColumn("_w", F.explode(F.when(full, two).otherwise(whole))).select(*keep, F.col("_w.a").alias("first"), F.col("_w.z").alias("last"))


def advances(attempts: DataFrame, stream: str, order: list[str], mark: str, succeeded: Column) -> DataFrame:
    """Which attempts move a stream's collection watermark: successful ones beyond all before.

    ``watermark`` is where it stands afterwards. Data behind it are kept; it isn't Spark's.
    """
    w = W.partitionBy(stream).orderBy(*order)
    done = F.when(succeeded, F.col(mark))
    before = F.max(done).over(w.rowsBetween(W.unboundedPreceding, -1))
    moved = succeeded & (before.isNull() | (F.col(mark) > before))
    return attempts.withColumn("advanced", F.coalesce(moved, F.lit(False))).withColumn("watermark", F.max(done).over(w.rowsBetween(W.unboundedPreceding, 0)))


def revalidated(days: DataFrame, key: str, day: str, back: int = 5) -> DataFrame:
    """The last ``back`` collected days of each key, which the next run reads again."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(day)))
    return days.select(key, day).distinct().withColumn("_r", rank).where(F.col("_r") <= back).groupBy(key).agg(F.min(day).alias("from_day"), F.max(day).alias("watermark"), F.count("*").alias("n"))


def backfill_steps(rows: DataFrame, lineage: str, part: str) -> DataFrame:
    """Partitions in publication order within a lineage, with the rows published before each."""
    sizes = rows.groupBy(lineage, part).agg(F.count("*").alias("n"))
    w = W.partitionBy(lineage).orderBy(part)
    return sizes.withColumn("step", F.row_number().over(w).cast("long")).withColumn("published", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def candidates(tables: DataFrame, key: str, fits: Column, done: Column) -> DataFrame:
    """What a promotion route may take: tables whose rows all fit and that aren't done yet."""
    counted = tables.groupBy(key).agg(F.count("*").alias("n"), F.count_if(fits).alias("n_fit"), F.bool_or(done).alias("done"))
    state = F.when(F.col("done"), "done").when(F.col("n_fit") == 0, "empty").when(F.col("n_fit") < F.col("n"), "mixed").otherwise("candidate")
    return counted.withColumn("state", state)


def byte_parts(members: DataFrame, document: str, order: list[str], size: Column, most: int) -> DataFrame:
    """Members of a document in parts of at most about ``most`` bytes, in order: a part begins
    at the member in which the running size passes its multiple."""
    w = W.partitionBy(document).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return members.withColumn("_size", size).withColumn("part", F.floor((F.sum("_size").over(w) - F.col("_size")) / most))


def seam_checks(seams: DataFrame, tolerance: float) -> DataFrame:
    """Whether the factor on both sides of a seam agrees: ratio of the prices across it within
    the tolerance of one; a side without a row is unknown."""
    ratio = F.col("after") / F.col("before")
    verdict = F.when(F.col("before").isNull() | F.col("after").isNull() | (F.col("before") == 0), "unknown").when(F.abs(ratio - 1) <= tolerance, "continuous").otherwise("broken")
    return seams.withColumn("ratio", ratio).withColumn("verdict", verdict)


def pages(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Keyset pages over a total order: (page, first, last, n); the next page begins after
    ``last``, so pages hold under concurrent inserts elsewhere."""
    from tidemark.sources.sharding import ordinals

    key = F.struct(*order)
    paged = ordinals(rows.select(*order), order, "_o").withColumn("page", F.floor(F.col("_o") / size))
    return paged.groupBy("page").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))


def admitted(sizes: DataFrame, by: list[str], size: Column, budget: int) -> DataFrame:
    """Bytes of each part and whether they fit the budget of one reader."""
    return sizes.groupBy(*by).agg(F.sum(size).alias("bytes"), F.max(size).alias("largest")).withColumn("admitted", F.col("bytes") <= budget)


def evaluate_trials(trials: DataFrame, evaluate: Callable[[dict], dict], schema: str) -> DataFrame:
    """Any evaluator of a trial, over the cluster: the trials' columns go in as a dict, the
    outcome's come out. Batches stream, so a task holds one at a time."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame([evaluate(t) for t in b.to_dict("records")], columns=names)

    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return trials.mapInPandas(run, schema)
