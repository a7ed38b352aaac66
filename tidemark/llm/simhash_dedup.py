"""SimHash near-duplicates by vantage-point trees (operator 8).

A text is lower-cased (A-Z), cut into words at ASCII white space, and every run of
``size`` words votes with its XXH64 on 64 bits.  Equal fingerprints are one class; all
further work is on classes.  Links need at most ``radius`` differing bits.

Shards overlap at every boundary: fingerprints are cut into ``radius + take`` bit blocks, a pair
within ``radius`` agrees on at least ``take`` of them, and each class goes to one shard a choice
of ``take`` blocks, so every link lies whole in some shard. ``take`` grows with the number of
classes, so that a shard of unrelated classes stays small; a shard that is large all the same is
dealt once more by the blocks of its remaining bits. Inside a shard a vantage-point tree splits
by Hamming distance to the median; whoever asks for its neighbours within ``radius`` skips a side
that the triangle inequality rules out. A shard returns a spanning forest of its links, fewer
than it has members, never all pairs, and star contraction joins the forests.

The pipeline's stage links texts whose sets of 5-word runs have a Jaccard similarity of 0.8
or more. Their 64-bit fingerprints go through the trees above, and each component found is a
shard of candidates. Texts at 0.8 differ in about 10 of 64 bits, often in more, where blocks and
Hamming balls no longer tell them from chance; so BANDS tables of ROWS minima of the runs'
hashes add shards (a pair at 0.8 meets with probability 1 - 3e-5, a closer one more surely).
In every shard vantage-point trees measure the Jaccard distance of the sets themselves, which
is a metric. Every link is thus verified; the tables are all that is left to chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import parts, stored, table, whole_groups
from tidemark.llm.components import components

LEAF = 16
FULL = 64  # classes a shard of unrelated ones holds on average
MOST = 5000
WIDE_LEAF = 256
SIZE, ALIKE = 5, 0.8
BANDS, ROWS = 20, 4
BLOCK = 2000
_MIX = np.random.default_rng(8).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def run_hashes(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of a text's runs of ``size`` words, in order; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs), dtype=np.uint64)


def fingerprint(text: str | None, size: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 if it has no words."""
    return voted(run_hashes(text, size))


def voted(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 if there are none."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounds what a very long text holds at once
        votes += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for each row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """A vantage-point tree over fingerprints, as nested tuples over index arrays."""

    def __init__(self, fp: np.ndarray):
        self.fp = fp
        self.root = self._grown(np.arange(len(fp)))

    def _grown(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        vantage = at[len(at) // 2]
        d = np.bitwise_count(self.fp[at] ^ self.fp[vantage])
        cut = int(np.median(d))
        inside, outside = at[d <= cut], at[d > cut]
        if not len(inside) or not len(outside):  # all alike from here: no vantage tells them apart
            return at
        return vantage, cut, self._grown(inside), self._grown(outside)

    def within(self, i: int, radius: int, free: np.ndarray) -> np.ndarray:
        """Members still free that differ from member i in at most radius bits."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                vantage, cut, inside, outside = node
                d = int(self.fp[i] ^ self.fp[vantage]).bit_count()
                if d - radius <= cut:
                    stack.append(inside)
                if d + radius > cut:
                    stack.append(outside)
            elif len(own := node[free[node]]):
                out.append(own[np.bitwise_count(self.fp[own] ^ self.fp[i]) <= radius])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def vantage_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of all links within ``radius`` among distinct fps."""
    out: list[tuple[int, int]] = []
    if len(fp) <= LEAF:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        if near.sum() == len(fp):
            return out
    tree, free = VantageTree(fp), np.ones(len(fp), bool)
    for first in range(len(fp)):
        if not free[first]:
            continue
        free[first] = False
        queue = [first]
        while queue:
            i = queue.pop()
            found = tree.within(i, radius, free).tolist()
            free[found] = False
            out += [(i, j) for j in found]
            queue += found
    return out


def _blocks(fp: Column, bits: list[int], count: int) -> list[Column]:
    """The named bits of a fingerprint in ``count`` blocks, a long each."""
    edges = [round(len(bits) * i / count) for i in range(count + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        runs: list[list[int]] = []
        for bit in bits[lo:hi]:
            if runs and bit == runs[-1][-1] + 1:
                runs[-1].append(bit)
            else:
                runs.append([bit])
        block, at = F.lit(0).cast("long"), 0
        for run in runs:
            part = F.shiftrightunsigned(fp, run[0]).bitwiseAND(F.lit((1 << len(run)) - 1))
            block, at = block.bitwiseOR(F.shiftleft(part, at)), at + len(run)
        out.append(block)
    return out


def _shards(classes: DataFrame, radius: int, take: int) -> DataFrame:
    """A row a class and choice of ``take`` of its blocks, named by the choice's number."""
    blocks = _blocks(F.col("fp"), list(range(64)), radius + take)
    keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *(blocks[i] for i in own)).alias("shard")) for t, own in enumerate(combinations(range(radius + take), take))]
    return classes.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "k.t", "k.shard")


def _dealt(classes: DataFrame, radius: int, take: int) -> DataFrame:
    """Shards, those of more than MOST classes dealt once more by their remaining bits."""
    rows = _shards(classes, radius, take)
    large = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("shard", F.lit(True).alias("_large"))
    rows = rows.join(large, "shard", "left")
    edges = [round(64 * i / (radius + take)) for i in range(radius + take + 1)]
    finer = F.lit(None).cast("array<bigint>")
    for t, own in enumerate(combinations(range(radius + take), take)):
        rest = [b for i in range(radius + take) if i not in own for b in range(edges[i], edges[i + 1])]
        keys = F.array(*[F.xxhash64("shard", F.lit(i), x) for i, x in enumerate(_blocks(F.col("fp"), rest, radius + 1))])
        finer = F.when(F.col("t") == t, keys).otherwise(finer)
    return rows.select("fp", "rep", F.explode(F.when(F.col("_large"), finer).otherwise(F.array("shard"))).alias("shard"))


def near_duplicates(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``(doc_id, fp)`` to ``(doc_id, fp, component_id)``, exact for links within ``radius``.

    Null and empty texts have fingerprint 0 and are linked like any other; rows that share an
    id, equal or not, are rows of their own and link as their fingerprints do; a null id names a
    component only if all its ids are null; texts of any length count whole; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = fps.sparkSession
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("rep", F.monotonically_increasing_id()))
    n = classes.count()
    take = next((t for t in range(1, 5) if n / 2 ** (64 * t // (radius + t)) <= FULL), 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in whole_groups(batches, "shard"):
            shard, fp, rep = (own.column(c).to_numpy() for c in ("shard", "fp", "rep"))
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            found = [rep[a:b][np.array(p)] for a, b in zip(edges, edges[1:], strict=False) if b - a > 1 and (p := vantage_links(fp[a:b].view(np.uint64), radius))]
            if found:
                p = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    spread = _dealt(classes, radius, take).repartition(max(parts(spark), 8), "shard").sortWithinPartitions("shard")
    links = spread.mapInArrow(run, "a long, b long")
    roots = components(links.distinct())
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "rep").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(named.join(lowest, "root"), "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``size`` words; none without words."""
    return np.unique(run_hashes(text, size))


def band_keys(own: np.ndarray) -> list[int]:
    """One key a table: the minima of ROWS mixings of the hashes."""
    if not len(own):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        low = np.minimum(low, ((own[at : at + 4096] ^ _MIX[0]) * _MIX[1]).min(1))
    rows = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def alike_links(sets: list[np.ndarray], least: float = ALIKE) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of all links among sets of Jaccard ``least`` or more."""
    out: list[tuple[int, int]] = []
    size = np.array([len(x) for x in sets])

    def shared(i: int, at: np.ndarray) -> np.ndarray:
        """Members in common of set i and each set of ``at``."""
        line = np.concatenate([sets[j] for j in at])
        place = np.minimum(np.searchsorted(sets[i], line), size[i] - 1)
        return np.add.reduceat((sets[i][place] == line).astype(np.int64), np.concatenate([[0], np.cumsum(size[at])[:-1]]))

    stack = [np.arange(len(sets))]
    while stack:
        at = stack.pop()
        if len(at) > WIDE_LEAF:
            both = shared(at[len(at) // 2], at)
            d = 1 - both / (size[at] + size[at[len(at) // 2]] - both)
            cut = float(np.median(d))
            inside, outside = at[d <= cut], at[d >= cut - (1 - least) - 1e-9]
            if max(len(inside), len(outside)) <= 0.9 * len(at):
                stack += [inside, outside]
                continue
        rest = at
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                i = queue.pop()
                fits = np.flatnonzero(np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i]) - 1e-9)
                if len(fits):
                    both = shared(i, rest[fits])
                    hit = fits[both >= least * (size[rest[fits]] + size[i] - both) - 1e-9]
                    out.extend((i, j) for j in rest[hit])
                    queue.extend(rest[hit])
                    rest = np.delete(rest, hit)
    return out


def _tagged(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own, the key of their text's class (equal sets), its tables and
    its fingerprint over runs of SIZE words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                runs = [run_hashes(t.as_py(), SIZE) for t in part.column(2)]
                fps = np.array([voted(x) for x in runs], np.uint64)
                sets = [np.unique(x) for x in runs]
                kind = [xxhash.xxh64_intdigest(x.tobytes(), 7) - (1 << 63) for x in sets]
                keys = pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(kind, pa.int64()), keys, pa.array(fps.view(np.int64))], ["_row", "doc_id", "th", "class", "keys", "fp"])

    rows = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return rows.mapInArrow(run, "_row long, doc_id long, th long, class long, keys array<long>, fp long")


def _alike_pairs(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``(class, _row, keys, fp)`` to ``(a, b)``, verified links that span every component.

    Shards are the components of the fingerprints' vantage-point trees and the tables. Of shards with the same members one is enough. Shards beyond BLOCK are cut into blocks,
    and every two blocks meet. Only texts that share a shard are read and cut again.
    """
    spark = classes.sparkSession
    near = stored(near_duplicates(classes.select(F.col("class").alias("doc_id"), "fp")))
    rows = near.select(F.col("doc_id").alias("class"), F.xxhash64("component_id", F.lit(9)).alias("key"))
    rows = rows.unionByName(classes.select("class", F.explode("keys").alias("key")))
    member = F.xxhash64("class", F.lit(3)).cast("decimal(38,0)")
    shards = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(member).alias("sum"), F.min("class").alias("low")).where("n > 1")
    kept = shards.groupBy("n", "sum", "low").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = rows.join(kept, "key").withColumn("i", F.pmod(F.xxhash64("class", F.lit(5)), F.col("blocks")).cast("int"))
    met = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = stored(met.select("class", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("shard")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["class", "raw"])

    asked = classes.select("class", "_row").join(met.select("class").distinct(), "class", "left_semi")
    full = met.join(texts.join(asked, "_row").select("class", "text").mapInArrow(cut, "class long, raw binary"), "class")

    def run(group: pa.Table) -> pa.Table:
        own = group.column("class").to_numpy()
        pairs = alike_links([np.frombuffer(x, np.uint64) for x in group.column("raw").to_pylist()])
        p = own[np.array(pairs, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(p[:, 0]), "b": pa.array(p[:, 1])})

    dealt = full.repartition(max(parts(spark), 8), "shard")
    return dealt.groupBy("shard").applyInArrow(run, "a long, b long")


def one_of_alike(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group linked by Jaccard similarity of 0.8 over 5-word runs.

    The row with the smallest id stays (null last, ties by text). Rows count by their text
    only: null and shared ids lose nothing that resembles no other row. Texts without words
    are alike; texts under five words are one run.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    tagged = stored(_tagged(rows))
    classes = stored(tagged.groupBy("class").agg(F.min("_row").alias("_row"), F.first("keys").alias("keys"), F.min("fp").alias("fp")))
    roots = components(stored(_alike_pairs(rows.select("_row", "text"), classes)))
    named = tagged.select("_row", "doc_id", "th", "class").join(roots, F.col("class") == F.col("node"), "left").withColumn("group", F.coalesce("root", "class"))
    stay = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "_row")).alias("s")).select(F.col("s._row").alias("_row"))
    return rows.join(stay, "_row", "left_semi").select(*docs.columns)


def hex16(col: str):
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def op8_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 4 bits over 4-word shingles."""
    fps = stored(fingerprints(table(spark, sf_dir, "documents")))
    return near_duplicates(fps).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")
