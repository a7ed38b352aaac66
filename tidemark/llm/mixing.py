"""Mixing sources to target weights by Sainte-Lague apportionment (operator 4).

All sizes are words.  Targets share the whole corpus by weight, stop at ``cap`` times their
source and reshare the excess.  The mix is made of equal blocks of ``block`` words:
highest quotients ``votes / (2 s + 1)`` give each source, and then each of its shards, an
integer quota of blocks.  A shard lines its documents up in a seeded order and its quota
takes that many blocks of the resulting word stream, in whole passes and then a part.

The number of shards follows the square root of the row count, so that both the cells of a
source with a third of all rows and the list of a source's cells stay small.  DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

# The weights repeat over the sources in code point order.
WEIGHTS = (1, 2, 3)
BLOCK = 16


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``.

    With caps in the order cap / weight, the level after k capped sources is what is left
    over the weights left; the first source that its level doesn't exceed ends the capping.
    The windows hold one row a source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    base = sizes.withColumn("weight", pick).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_cap = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = base.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least("most", F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def apportioned(parties: DataFrame, group: str, votes: str, seats: str, key: str) -> DataFrame:
    """Integer quotas by highest quotients within each ``group``.

    Rounding ``votes / divisor`` at the natural divisor is the rule's own result for some
    nearby number of seats.  The seats still missing go to the highest next quotients, those
    too many leave by the lowest held ones; a party's share bounds how many can be at issue,
    so the quotients listed stay linear in the number of parties.  Ties go to the smaller key.
    """
    own = W.partitionBy(group)
    total = F.sum(votes).over(own)
    first = F.when(total > 0, F.floor(F.col(votes) * F.col(seats) / total + 0.5)).otherwise(0).cast("long")
    begun = parties.withColumn("_first", first).withColumn("_share", F.when(total > 0, F.col(votes) / total).otherwise(0.0)).withColumn("_n", F.count("*").over(own))
    begun = begun.withColumn("_short", F.when(total > 0, F.col(seats) - F.sum("_first").over(own)).otherwise(0))
    reach = (F.ceil(F.col("_share") * (F.abs("_short") + F.col("_n"))) + 1).cast("long")
    turns = F.when(F.col("_short") > 0, F.sequence(F.lit(0).cast("long"), reach)).when(
        F.col("_short") < 0, F.when(F.col("_first") > 0, F.sequence(F.lit(1).cast("long"), F.least(reach, F.col("_first")))).otherwise(F.array().cast("array<bigint>"))
    )
    at = begun.where(F.col("_short") != 0).select(group, key, votes, "_first", "_short", F.explode(turns).alias("_t"))
    quotient = F.col(votes) / F.when(F.col("_short") > 0, 2 * (F.col("_first") + F.col("_t")) + 1).otherwise(2 * (F.col("_first") - F.col("_t")) + 1)
    signed = F.when(F.col("_short") > 0, -quotient).otherwise(quotient)
    rank = F.row_number().over(W.partitionBy(group).orderBy(signed, F.col(key).asc_nulls_last(), "_t"))
    moved = at.withColumn("_rank", rank).where(F.col("_rank") <= F.abs("_short")).groupBy(group, key).agg(F.sum(F.signum("_short")).cast("long").alias("_move"))
    joined = begun.alias("p").join(moved.alias("m"), F.col(f"p.{group}").eqNullSafe(F.col(f"m.{group}")) & F.col(f"p.{key}").eqNullSafe(F.col(f"m.{key}")), "left")
    return joined.select(*[F.col(f"p.{c}") for c in parties.columns], (F.col("p._first") + F.coalesce("m._move", F.lit(0))).alias("quota"))


def mixed(sized: DataFrame, block: int = BLOCK, cap: float = 3.0, seed: int = 7, measured: DataFrame | None = None) -> DataFrame:
    """``(doc_id, source, size, ...)`` to the same with ``source_size, target, taken``.

    ``measured`` may hold the same rows without further columns, for the counting.

    A null source is a source of its own, the last; rows of size 0 take nothing; repeated
    rows count as often as they occur. The same rows give the same result in any order.
    """
    measured = sized if measured is None else measured
    shards = max(1, int(measured.count() ** 0.5) // 2)
    shard = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)).cast("long")
    celled = sized.withColumn("shard", shard)
    cells = stored(measured.withColumn("shard", shard).groupBy("source", "shard").agg(F.sum("size").alias("cell_size")))
    goals = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), cap)
    parties = goals.withColumn("house", F.lit(0)).withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long"))
    sources = apportioned(parties, "house", "target", "seats", "source").select("source", "source_size", "target", F.col("quota").alias("blocks"))
    both = cells.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
    shares = both.select("c.source", "c.shard", "c.cell_size", "s.source_size", "s.target", "s.blocks").withColumn("votes", F.col("cell_size").cast("double"))
    quotas = stored(apportioned(shares, "source", "votes", "blocks", "shard"))
    most = (F.col("cell_size") * F.lit(cap)).cast("long")
    own = W.partitionBy("source")
    clipped = quotas.withColumn("_clip", F.least(F.col("quota") * block, most)).withColumn("_room", most - F.col("_clip"))
    short = F.col("blocks") * block - F.sum("_clip").over(own)  # what cells at their cap leave over goes to the next with room
    used = F.coalesce(F.sum("_room").over(own.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    take = F.col("_clip") + F.least(F.greatest(short - used, F.lit(0)), F.col("_room"))
    plan = clipped.select("source", "shard", "cell_size", "source_size", "target", take.alias("take"))
    line = W.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    placed = celled.withColumn("stop", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)))
    joined = placed.alias("d").join(plan.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")))
    passes = F.when(F.col("cell_size") > 0, F.floor(F.col("take") / F.col("cell_size"))).otherwise(0).cast("long")
    rest = F.col("take") - passes * F.col("cell_size")
    part = F.least(F.greatest(rest - (F.col("stop") - F.col("size")), F.lit(0)), F.col("size"))
    taken = (passes * F.col("size") + part).cast("long").alias("taken")
    return joined.select(*[F.col(f"d.{c}") for c in sized.columns], "q.source_size", "q.target", taken)


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)`` of documents."""
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size")))


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.concat_ws("", F.slice(runs, F.lit(1), n.cast("int")))


def mixture(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row for each whole pass and one for a part."""
    measured = sized(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    out = mixed(rows, measured=measured).where("taken > 0")
    turns = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    each = out.select("row", "size", "taken", F.explode(turns).alias("turn"))
    rest = F.col("taken") - (F.col("turn") - 1) * F.col("size")
    text = F.when(rest >= F.col("size"), F.col("row.text")).otherwise(first_words(F.col("row.text"), rest))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return each.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def op4_mix_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixed(sized(table(spark, sf_dir, "documents"))).drop("source")
