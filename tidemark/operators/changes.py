"""From mapped rows to a delta: compare with heads, tombstones, flags, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(values: list[str], left: str = "n", right: str = "h") -> Column:
    """All values equal, nulls included."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{v}").eqNullSafe(F.col(f"{right}.{v}")) for v in values], F.lit(True))


def diff(new: DataFrame, heads: DataFrame, key: str, values: list[str], clock: str | None = None) -> DataFrame:
    """New rows with op ASSERT, SUPERSEDE or SKIP against the heads (which may be tombstones).

    With a ``clock``, a superseding row whose clock would move back is STALE instead.
    """
    joined = new.alias("n").join(heads.alias("h"), F.col(f"n.{key}") == F.col(f"h.{key}"), "left")
    there = F.col(f"h.{key}").isNotNull()
    stale = F.lit(False) if clock is None else F.coalesce(F.col(f"n.{clock}") < F.col(f"h.{clock}"), F.lit(False))
    op = F.when(~there, "ASSERT").when((F.col("h.op") != "TOMBSTONE") & same(values), "SKIP").when(stale, "STALE").otherwise("SUPERSEDE")
    return joined.select("n.*", op.alias("op"), F.col("h.revision_id").alias("supersedes"))


def tombstones(heads: DataFrame, snapshot: DataFrame, key: str, scope: Column | None = None) -> DataFrame:
    """Live heads in scope that a full snapshot doesn't have."""
    live = heads.where(F.col("op") != "TOMBSTONE")
    live = live if scope is None else live.where(scope)
    return live.join(snapshot.select(key).distinct(), key, "left_anti").withColumn("supersedes", F.col("revision_id")).withColumn("op", F.lit("TOMBSTONE"))


def delta(changed: DataFrame, removed: DataFrame) -> DataFrame:
    """What a generation appends: changed rows and tombstones."""
    return changed.where(F.col("op").isin("ASSERT", "SUPERSEDE")).unionByName(removed, allowMissingColumns=True)


def mismatches(rows: DataFrame, reference: DataFrame, on: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows that some reference row of the same key contradicts beyond a relative tolerance."""
    other = reference.select(*on, F.col(value).alias("_ref"))
    theta = F.abs(F.col(value) - F.col("_ref")) > tolerance * F.abs("_ref")
    cond = reduce(lambda a, b: a & b, [rows[c] == other[c] for c in on]) & theta
    return rows.join(other, cond, "left_semi")


def row_status(required: Column, matches: Column, number: Column, held: Column) -> Column:
    """The first reason a mapped row is refused, or ok."""
    return F.when(~required, "refused_required").when(matches == 0, "unresolved").when(matches > 1, "ambiguous").when(~number, "refused_number").when(held, "held").otherwise("ok")


def partition_check(counts: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Days with far fewer rows than the fullest of the 31 days before."""
    from pyspark.sql import Window as W

    day = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long")
    top = F.max("n").over(W.partitionBy(key).orderBy(day).rangeBetween(-31, -1))
    return counts.withColumn("reference", top).where(F.col("n") < share * F.col("reference"))


def revision_faults(prior: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a delta that don't fit the chain: a repeated id, an assert of a live record, or
    a predecessor that isn't the record's head."""
    heads = prior.groupBy("record_id").agg(F.max_by(F.struct("revision_id", "op"), "sequence").alias("head"))
    j = rows.alias("r").join(heads.alias("h"), "record_id", "left")
    known = prior.select(F.col("revision_id").alias("_known")).distinct()
    j = j.join(known, F.col("revision_id") == F.col("_known"), "left")
    live = F.col("h.head").isNotNull() & (F.col("h.head.op") != "TOMBSTONE")
    fault = (
        F.when(F.col("_known").isNotNull(), "repeated_revision")
        .when((F.col("r.op") == "ASSERT") & live, "assert_of_live")
        .when((F.col("r.op") != "ASSERT") & ~F.coalesce(F.col("r.supersedes") == F.col("h.head.revision_id"), F.lit(False)), "wrong_predecessor")
    )
    return j.select("record_id", "revision_id", fault.alias("fault")).where("fault is not null")


def both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference in both directions, with its side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def counts_against(markers: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Markers and stored rows that disagree, either side possibly absent."""
    stored = rows.groupBy(key).agg(F.count("*").alias("stored"))
    j = markers.select(key, F.col("row_count").alias("claimed")).join(stored, key, "full")
    return j.where(~F.col("claimed").eqNullSafe(F.col("stored")))
