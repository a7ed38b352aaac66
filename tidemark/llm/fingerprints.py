"""Document fingerprints by SimHash (operator 9), in DataFrame expressions only.

Terms are pairs of adjacent lower-cased words (a lone word is its own term); a term's weight
is how often it occurs. Each occurrence's 64-bit hash votes +1 or -1 on every bit, counted
eight bits to a long over runs of 127 terms and widened afterwards, so a document costs no
shuffle, whatever its length.

Search: the fingerprint is cut into ``radius + 2`` blocks; two fingerprints within the radius
agree on at least two of them, so one table a pair of blocks, keyed by their bits, meets every
neighbour. A pair counts only in the first table that both share, which spares a distinct.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import parts, stored, table

LANES = 0x0101010101010101
RUN = 127  # so that the top lane stays below the sign bit
ROWS_A_BUCKET = 20_000
RANGES = 4096


def term_hashes(text: Column) -> Column:
    """One 64-bit hash an occurrence of a term."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(ws: Column) -> Column:
        pairs = F.zip_with(ws, F.slice(ws, F.lit(2), F.size(ws)), lambda a, b: F.xxhash64(a, b))
        return F.when(F.size(ws) < 2, F.transform(ws, lambda a: F.xxhash64(a))).otherwise(F.slice(pairs, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(1))))

    return of(words)


def simhash(hashes: Column) -> Column:
    """The majority bits of an array of hashes as a signed long; 0 for an empty array."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"l{k}") for k in range(8)])
    lanes = lambda acc, h: F.struct(*[(acc[f"l{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))).alias(f"l{k}") for k in range(8)])
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0)), F.lit(RUN))
    return F.transform(starts, lambda s: F.aggregate(F.slice(hashes, s + 1, F.lit(RUN)), zero, lanes))


def majority(runs: Column, n: Column) -> Column:
    """Bits set in over half of n votes, from the runs' packed counts."""

    def votes(bit: int) -> Column:
        lane, shift = f"l{bit % 8}", 8 * (bit // 8)
        return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + F.shiftrightunsigned(r[lane], shift).bitwiseAND(F.lit(255)))

    out = F.lit(0).cast("long")
    for bit in range(64):
        count = votes(bit)
        out = out.bitwiseOR(F.when(2 * count > n, F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return out


def fingerprinted(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with a fingerprint column for each text column named (null text: empty)."""
    for text, name in columns.items():
        df = df.withColumn(f"_h_{name}", term_hashes(F.coalesce(F.col(text), F.lit(""))))
        df = df.withColumn(f"_n_{name}", F.size(f"_h_{name}")).withColumn(f"_r_{name}", simhash(F.col(f"_h_{name}"))).drop(f"_h_{name}")
    for name in columns.values():
        df = df.withColumn(name, majority(F.col(f"_r_{name}"), F.col(f"_n_{name}"))).drop(f"_r_{name}", f"_n_{name}")
    return df


def _quantiles(df: DataFrame, key: str, ranges: int) -> list[int]:
    """At most ranges - 1 bounds that halve the rows ever further; a frequent key repeats."""
    at = [(i + 1) / ranges for i in range(ranges - 1)]
    found = df.agg(F.percentile_approx(key, at, F.lit(20 * ranges))).first()[0] if at else None
    return sorted(found or [])


def _ranged(key: Column, bounds: list[int], spread: Column) -> Column:
    """The number of the range of a key, by two levels of bounds. A key that is itself a bound,
    perhaps several times, is spread over the ranges beside it by ``spread`` from 0 up to 1."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(x) for x in bounds[::step]]) if bounds else F.array().cast("array<bigint>")
    fine = F.array(*[F.array(*[F.lit(x) for x in bounds[i : i + step]]) for i in range(0, len(bounds), step)]) if bounds else None

    def upto(test) -> Column:
        if fine is None:
            return F.lit(0)
        block = F.size(F.filter(coarse, test))
        return F.when(block == 0, 0).otherwise((block - 1) * step + F.size(F.filter(F.element_at(fine, F.greatest(block, F.lit(1))), test)))

    below = upto(lambda b: b < key)
    return below + F.floor(spread * (upto(lambda b: b <= key) - below + 1)).cast("int")


def following(df: DataFrame, key: str, carry: str, tie: str) -> DataFrame:
    """``df`` with ``next_<carry>`` of the row that follows by key, ties by the long ``tie``;
    after the last, the first. Null keys come first.

    Ranges between quantiles of the key (at most RANGES, so many longs reach the driver) are
    windows of their own, and rows of one key, however many, spread over several by ``tie``;
    each range gets the first row of the next as a guest, so no window spans the table.
    """
    spark = df.sparkSession
    n = df.count()
    ranges = max(1, min(RANGES, max(4 * parts(spark), n // ROWS_A_BUCKET)))
    own = F.coalesce(F.col(key), F.lit(-(2**63)))
    spread = (F.col(tie) / F.lit(2.0**64) + 0.5) * (1 - 1e-9)
    bounds = _quantiles(df.select(own.alias("k")), "k", ranges)
    ranged = df.withColumn("_key", own).withColumn("_tie", F.col(tie)).withColumn("_range", _ranged(own, bounds, spread))
    firsts = ranged.groupBy("_range").agg(F.min(F.struct("_key", "_tie")).alias("_first"))
    start = F.first("_first").over(W.orderBy("_range"))
    heads = firsts.select((F.coalesce(F.lead("_first").over(W.orderBy("_range")), start)).alias("_first"), F.col("_range").alias("_to"))  # a row a range
    met = ranged.select("_key", "_tie", carry).join(F.broadcast(heads), F.struct("_key", "_tie") == F.col("_first"))  # 24 bytes a range
    guests = met.groupBy("_to").agg(F.min(carry).alias(carry)).withColumnRenamed("_to", "_range")
    both = ranged.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)), allowMissingColumns=True)
    line = W.partitionBy("_range").orderBy("_guest", "_key", "_tie", carry)
    return both.withColumn(f"next_{carry}", F.lead(carry).over(line)).where("_guest = 0").drop("_guest", "_range", "_key", "_tie")


def near_counts(fps: DataFrame, queries: Column, radius: int = 3) -> DataFrame:
    """``(doc_id, fp)`` to ``(fp, n_near)`` for the query rows' fingerprints: how many
    documents, itself included, have a fingerprint within the radius."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    block = lambda col, i: F.shiftrightunsigned(col, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    tables = list(combinations(range(radius + 2), 2))
    keys = lambda col: F.array(*[F.xxhash64(F.lit(t), block(col, i), block(col, j)) for t, (i, j) in enumerate(tables)])
    classes = stored(fps.groupBy("fp").agg(F.count("*").alias("copies"), F.max(queries.cast("int")).alias("asked")))
    rows = classes.select("fp", "copies", F.posexplode(keys(F.col("fp"))).alias("t", "key"))
    asked = classes.where("asked = 1").select(F.col("fp").alias("q"), F.posexplode(keys(F.col("fp"))).alias("qt", "key"))
    same = F.array(*[(block(F.col("fp"), i) == block(F.col("q"), i)) & (block(F.col("fp"), j) == block(F.col("q"), j)) for i, j in tables])
    hit = rows.join(asked, "key").where(F.col("t") == F.col("qt")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("q"))) <= radius)
    first = hit.where(F.array_position(same, True) == F.col("t") + 1)
    return first.groupBy(F.col("q").alias("fp")).agg(F.sum("copies").alias("n_near"))


def _hex(col: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def _alike(a: str, b: str) -> Column:
    return 1.0 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64.0


def op9_simhash_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    Null text counts as empty and fingerprints as 0; rows that share an id follow each other
    by their text's hash, null ids first, so repeated rows follow one another; texts of any
    length count whole; other columns are ignored; an empty table gives none. ``n_near`` is given
    for ids divisible by 50.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = following(docs.withColumn("tie", F.xxhash64("text")), "doc_id", "text", "tie")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    both = paired.select("doc_id", "tie", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    prints = stored(fingerprinted(both, {"text": "fp", "edited": "efp"}).drop("text", "edited"))
    lined = following(prints, "doc_id", "fp", "tie")
    near = near_counts(prints.select("doc_id", "fp"), F.col("doc_id") % 50 == 0)
    out = lined.join(near, "fp", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", _hex("fp").alias("fingerprint"), _hex("efp").alias("edited_fingerprint"),
        _alike("fp", "efp").alias("near_edited"), _alike("fp", "next_fp").alias("near_next"),
        F.when(F.col("doc_id") % 50 == 0, F.col("n_near")).alias("n_near"),
    )
