"""Heads of revision chains "as known at" a cutoff, and what is read around them.

A chain row has record_id, sequence, op and three clocks in microseconds: known, available
(both may be null) and ingested. All projections are one shuffle on the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def event(cutoff: Column | int | None, ingestion: int | None = None, excluded: Column | None = None, role: str | None = "role") -> Column:
    """What a row does to its record: 'set', 'pop' or null.

    Strict reading (with a cutoff): rows ingested later, or known later or never, do nothing;
    known rows that aren't available yet, or are excluded, pop unless they assert; reference
    rows do nothing; the rest set. Without a cutoff every ingested row sets.
    """
    seen = F.lit(True) if ingestion is None else F.col("ingested") <= ingestion
    if cutoff is None:
        return F.when(seen, "set")
    at = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    known = F.coalesce(F.col("known") <= at, F.lit(False)) & seen
    held = ~F.coalesce(F.col("available") <= at, F.lit(False))
    if excluded is not None:
        held = held | F.coalesce(excluded, F.lit(False))
    plain = F.lit(False) if role is None else F.col(role) == "reference"
    return F.when(known & held & (F.col("op") != "ASSERT"), "pop").when(known & ~held & ~plain, "set")


def project_heads(rows: DataFrame, cutoff: int | None = None, ingestion: int | None = None, *, keys: tuple[str, ...] = ("record_id",), excluded: Column | None = None, role: str | None = "role") -> DataFrame:
    """The rows that are heads: a record's last event if it sets, unless a tombstone."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("sequence")))
    last = rows.withColumn("_event", event(cutoff, ingestion, excluded, role)).where("_event is not null").withColumn("_r", rank).where("_r = 1")
    return last.where((F.col("_event") == "set") & (F.col("op") != "TOMBSTONE")).drop("_event", "_r")


def project_revisions(rows: DataFrame, cutoffs: list[tuple[int, int]], *, keys: tuple[str, ...] = ("record_id",), role: str | None = "role") -> DataFrame:
    """Heads at each of a run's cutoffs (cutoff_id, cutoff), from one scan and one shuffle.

    The rows meet once a record; there the last event at every cutoff is found side by side, and
    only heads are listed a cutoff.
    """
    record = W.partitionBy(*keys)
    judged = rows.withColumns({f"_e{i}": event(F.lit(cutoff), role=role) for i, (_, cutoff) in enumerate(cutoffs)})
    last = judged.withColumns({f"_s{i}": F.max(F.when(F.col(f"_e{i}").isNotNull(), F.col("sequence"))).over(record) for i in range(len(cutoffs))})
    held = [F.when((F.col(f"_e{i}") == "set") & (F.col(f"_s{i}") == F.col("sequence")), F.lit(name).cast("long")) for i, (name, _) in enumerate(cutoffs)]
    heads = last.where(F.col("op") != "TOMBSTONE").withColumn("cutoff_id", F.explode(F.array_compact(F.array(*held))))
    return heads.drop(*(f"_{c}{i}" for c in "es" for i in range(len(cutoffs))))


def read_heads(rows: DataFrame, cutoff: int, ingestion: int | None = None, *, subjects: Column | None = None, days: Column | None = None, ceiling: int | None = None, granted: dict[int, bool] | None = None, excluded: Column | None = None) -> DataFrame:
    """A head read: natural-key filters go below the ranking, projected-value filters above.

    ``granted`` maps a pin to whether its availability rule is granted; a pin that isn't has
    unknown availability. ``ceiling`` bounds the known clock where there is one.
    """
    own = rows if subjects is None else rows.where(subjects)
    if ceiling is not None:
        own = own.where(F.col("known").isNull() | (F.col("known") <= ceiling))
    if granted is not None:
        allowed = [pin for pin, ok in granted.items() if ok]
        own = own.withColumn("available", F.when(F.col("pin").isin(allowed), F.col("available")))
    heads = project_heads(own, cutoff, ingestion, keys=("pin", "record_id"), excluded=excluded)
    return heads if days is None else heads.where(days)


def held_back(rows: DataFrame, cutoff: int, ingestion: int | None = None, *, keys: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """Records some of whose rows are withheld at the cutoff for an unknown or later clock."""
    seen = F.lit(True) if ingestion is None else F.col("ingested") <= ingestion
    unknown = F.col("known").isNull() | F.col("available").isNull()
    late = (F.col("known") > cutoff) | (F.col("available") > cutoff)
    return rows.where(seen).groupBy(*keys).agg(
        F.sum(unknown.cast("long")).alias("n_unknown"), F.sum(F.coalesce(late, F.lit(False)).cast("long")).alias("n_late"), F.count("*").alias("n_rows"),
    ).where("n_unknown + n_late > 0")


def coverage(grid: DataFrame, heads: DataFrame, on: list[str], checks: dict[str, Column]) -> DataFrame:
    """Each grid cell with its reason codes; a cell without reasons is present."""
    marked = heads.withColumn("_found", F.lit(True))
    joined = grid.join(marked, on, "left")
    absent = F.when(F.col("_found").isNull(), "missing_row")
    codes = F.array_compact(F.array(absent, *[F.when(F.col("_found") & c, name) for name, c in checks.items()]))
    return joined.select(*on, F.array_distinct(codes).alias("reasons"))


def generation_chain(generations: DataFrame, head: str) -> DataFrame:
    """The markers from a dataset's head down: sequences up to the head's in its dataset."""
    top = generations.where(F.col("generation_id") == head).select(F.col("dataset_id").alias("_d"), F.col("sequence").alias("_s"))
    return generations.join(F.broadcast(top), (F.col("dataset_id") == F.col("_d")) & (F.col("sequence") <= F.col("_s"))).drop("_d", "_s")


def broken_links(chain: DataFrame) -> DataFrame:
    """Markers whose parent isn't the marker before, or whose sequence leaves a gap."""
    w = W.partitionBy("dataset_id").orderBy("sequence")
    before, prior = F.lag("generation_id").over(w), F.lag("sequence").over(w)
    bad = ~F.col("parent_id").eqNullSafe(before) | (F.col("sequence") != F.coalesce(prior + 1, F.lit(1)))
    return chain.withColumn("_bad", bad).where("_bad").drop("_bad")


def generation_verdicts(markers: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each marker's claims replayed: its parent, its row count and the checksum of its rows.

    ``markers`` hold (sequence, parent, n, checksum), ``rows`` their sequence; the replay is one
    grouped aggregate over the rows.
    """
    from tidemark.operators.requests import receipts

    held = receipts(rows, columns, ["sequence"]).select("sequence", F.col("n").alias("_n"), F.col("checksum").alias("_c"))
    linked = F.coalesce(F.col("parent") == F.lag("sequence").over(W.orderBy("sequence")), F.col("parent").isNull() & (F.col("sequence") == 1))
    chained = markers.withColumn("link_ok", linked)  # a row a generation
    return chained.join(held, "sequence", "left").select("sequence", "link_ok", F.col("n").eqNullSafe(F.col("_n")).alias("rows_ok"), F.col("checksum").eqNullSafe(F.col("_c")).alias("digest_ok"))


def bounded(value: Column, base: Column, ingested: Column) -> tuple[Column, Column]:
    """The late and early data rule: a clock after ingestion is clamped to it, one before its
    physical base is held (null). Returns the clock and what was done."""
    done = F.when(value.isNull(), "unknown").when(value < base, "held").when(value > ingested, "clamped").otherwise("kept")
    return F.when(value < base, None).otherwise(F.least(value, ingested)), done
