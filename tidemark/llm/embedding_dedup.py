"""Embedding near-duplicates by NN-descent (operator 10).

Equal vectors are one class. Random hyperplanes give each class a first neighbour list from
its bucket in several tables. Rounds of NN-descent then compare, around every pivot, the
pivot's neighbours and those that list it with one another and keep each class's best; a
list that is full of links has its length doubled, so large groups stay connected. Rounds
end when they find next to no new link. Links within the components so found are counted in
blocks of members, without listing pairs. An audit compares a bounded sample of classes with
all rows, as the mean over the asked classes that have links; while recall falls short, twice
as many further tables and more rounds follow (at 18 bits a pair of cosine 0.95 meets in 15% of
the tables). If TABLES were not enough, all classes are compared block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import parts, stored, table, whole_groups
from tidemark.llm.components import components

BUCKET = 200
CHUNK = 256
BLOCK = 2048
AUDIT = 200
TABLES = 200
EDGES = "u long, v long, cos double"


def usable(vector: Column) -> Column:
    """Not null, some component not zero, all finite and not null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)`` of the usable vectors. Adding zero makes the two zeros one."""
    clean = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + 0.0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), clean.alias("vec")).where(usable(F.col("vec")))
    return rows


def unit(column) -> np.ndarray:
    """Unit rows of an Arrow list column whose lists have one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits))


def _buckets(reps: DataFrame, tables: range, bits: int) -> DataFrame:
    """A row a class and table, keyed by dimension, table and signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x = unit(own.column("vec"))
                for t in tables:
                    signs = (x @ _planes(int(dim), bits, t) > 0) @ (1 << np.arange(bits))
                    key = (int(dim) * 4096 + t) * (1 << 20) + signs
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), own.column("rep"), own.column("vec")], ["key", "rep", "vec"])

    rows = reps.select("rep", "vec", F.size("vec").cast("long").alias("dim")).mapInArrow(run, "key long, rep long, vec array<double>")
    sizes = rows.groupBy("key").agg(F.count("*").alias("_n"))
    salt = F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("_n") / (4 * BUCKET)))
    return rows.join(sizes, "key").select(F.xxhash64("key", salt).alias("key"), "rep", "vec")


def _best(own: pa.Table, k: int, floor: float) -> list[np.ndarray]:
    """For each member of one group its best k others with cosine at least ``floor``."""
    ids, x = own.column("rep").to_numpy(), unit(own.column("vec"))
    out = []
    for at in range(0, len(ids), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        take = min(k, len(ids) - 1)
        near = np.argpartition(-s, take - 1, axis=1)[:, :take]
        cos = np.take_along_axis(s, near, 1)
        r, c = np.nonzero(cos >= floor)
        out.append(np.rec.fromarrays([ids[at + r], ids[near[r, c]], np.minimum(cos[r, c], 1.0)], names="u,v,cos"))
    return out


def _compared(rows: DataFrame, k: int, floor: float) -> DataFrame:
    """Edges among the members of each keyed group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            cuts = np.flatnonzero(np.diff(t.column("key").to_numpy())) + 1
            bounds = [0, *cuts.tolist(), t.num_rows]
            found = [e for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1 for e in _best(t.slice(a, b - a), k, floor)]
            if found:
                e = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(e["u"]), pa.array(e["v"]), pa.array(e["cos"])], ["u", "v", "cos"])

    spread = rows.repartition(max(8, parts(rows.sparkSession)), "key").sortWithinPartitions("key")
    return spread.mapInArrow(run, EDGES)


def _kept(edges: DataFrame, caps: DataFrame | None, k: int) -> DataFrame:
    """Each class's best entries up to its list length."""
    each = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("cos"), "v"))
    ranked = each.withColumn("r", rank)
    if caps is None:
        return ranked.where(F.col("r") <= k).drop("r")
    return ranked.join(caps, "u", "left").where(F.col("r") <= F.coalesce("cap", F.lit(k))).select("u", "v", "cos")


def _around(edges: DataFrame, reps: DataFrame, k: int, floor: float) -> DataFrame:
    """One local join: the members around every pivot compared with one another."""
    ends = edges.select(F.col("u").alias("pivot"), F.col("v").alias("rep")).union(edges.select("v", "u")).union(edges.select("u", "u")).distinct()
    sizes = ends.groupBy("pivot").agg(F.count("*").alias("_n"))
    salt = F.pmod(F.xxhash64("rep", "pivot"), F.ceil(F.col("_n") / CHUNK))
    keyed = ends.join(sizes, "pivot").select(F.xxhash64("pivot", salt).alias("key"), "rep")
    return _compared(keyed.join(reps.select("rep", "vec"), "rep"), k, floor)


def descend(reps: DataFrame, least: float, k: int = 10, tables: range = range(6), rounds: int = 6, start: DataFrame | None = None) -> DataFrame:
    """The neighbour graph ``(u, v, cos)`` after NN-descent; floor cosines are navigation."""
    floor = max(0.0, least - 0.25)
    n = reps.count()
    bits = max(1, min(18, int(np.log2(max(2, n / BUCKET)))))
    found = _compared(_buckets(reps, tables, bits), k, floor)
    now = stored(_kept(found if start is None else found.unionByName(start), None, k))
    links = now.where(F.col("cos") >= least).count()
    caps = None
    for _ in range(rounds):
        held = now.groupBy("u").agg(F.count("*").alias("n"), F.min("cos").alias("low"))
        full = held.where((F.col("n") >= k) & (F.col("low") >= least))
        caps = stored(full.select("u", F.least(2 * F.col("n"), F.lit(4 * k)).alias("cap")))
        now = stored(_kept(now.unionByName(_around(now, reps, k, floor)), caps, k))
        more = now.where(F.col("cos") >= least).count()
        if more - links <= 0.001 * links:
            break
        links = more
    return now


def _met(members: DataFrame) -> DataFrame:
    """Members of each root in blocks of about BLOCK, a group for every two blocks."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.xxhash64("root", F.least(F.col("block"), o), F.greatest(F.col("block"), o)))
    return own.select(F.explode(pairs).alias("key"), "rep", "copies", "block", "vec")


def _tallied(members: DataFrame, least: float) -> DataFrame:
    """``(rep, root, copies, vec)`` to ``(rep, n)``: linked vectors of the same component,
    the class itself included, counted block against block."""
    rows = _met(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            bounds = [0, *(np.flatnonzero(np.diff(t.column("key").to_numpy())) + 1).tolist(), t.num_rows]
            ids, counts = [], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                g = t.slice(a, b - a)
                x, copies, block = unit(g.column("vec")), g.column("copies").to_numpy(), g.column("block").to_numpy()
                one = (block == block[0]).all()
                ids.append(g.column("rep").to_numpy())
                for at in range(0, len(x), 512):
                    near = x[at : at + 512] @ x.T >= least
                    counts.append((near if one else near & (block[at : at + 512, None] != block[None, :])) @ copies)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(counts))], ["rep", "n"])

    spread = rows.repartition(max(8, parts(rows.sparkSession)), "key").sortWithinPartitions("key")
    return spread.mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def audited(reps: DataFrame, links: DataFrame, least: float, sample: int = AUDIT) -> float:
    """Share of its true links that was found, as the mean over those of a bounded, hash-chosen
    sample of classes that have links; a class without an entry in ``links`` has its copies."""
    asked = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    if not asked:
        return 1.0
    by_dim: dict[int, tuple[list, list]] = {}
    for r in asked:
        own = by_dim.setdefault(len(r["vec"]), ([], []))
        own[0].append(r["rep"])
        own[1].append(r["vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim, (ids, vecs) in by_dim.items():
                own = b.filter(pa.array(dims == dim))
                if own.num_rows:
                    q = unit(pa.array(vecs, pa.list_(pa.float64())))
                    near = (q @ unit(own.column("vec")).T >= least) @ own.column("copies").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near)], ["rep", "n"])

    truth = reps.select("copies", "vec", F.size("vec").cast("long").alias("dim")).mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("true"))
    both = truth.join(reps.select("rep", "copies"), "rep").join(links, "rep", "left").where(F.col("true") > 1)
    share = F.least(F.lit(1.0), (F.coalesce("n", "copies") - 1) / (F.col("true") - 1))
    row = both.agg(F.avg(share).alias("share")).first()
    return 1.0 if row["share"] is None else float(row["share"])


def _spanning(own: pa.Table, least: float) -> list[tuple[int, int, float]]:
    """Links that connect what is connected within one group."""
    ids, x = own.column("rep").to_numpy(), unit(own.column("vec"))
    free, out = np.ones(len(ids), bool), []
    for first in range(len(ids)):
        queue = [first] if free[first] else []
        free[first] = False
        while queue:
            i = queue.pop()
            cos = x @ x[i]
            new = np.flatnonzero(free & (cos >= least))
            free[new] = False
            queue += new.tolist()
            out += [(ids[i], ids[j], min(1.0, cos[j])) for j in new]
    return out


def _all_links(reps: DataFrame, least: float) -> DataFrame:
    """Spanning links among all classes of one length, block against block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            bounds = [0, *(np.flatnonzero(np.diff(t.column("key").to_numpy())) + 1).tolist(), t.num_rows]
            found = [e for a, b in zip(bounds, bounds[1:], strict=False) for e in _spanning(t.slice(a, b - a), least)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["u", "v", "cos"])

    rows = _met(reps.select("rep", "copies", "vec", F.size("vec").cast("long").alias("root"))).select("key", "rep", "vec")
    return rows.repartition(max(8, parts(rows.sparkSession)), "key").sortWithinPartitions("key").mapInArrow(run, EDGES)


def near_duplicates(vectors: DataFrame, least: float = 0.95, recall: float = 0.98, most: int | None = None) -> DataFrame:
    """``(vec_id, embedding)`` to ``(vec_id, n_links, component_id, kept, audited_recall)``.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor
    do vectors of different lengths; rows that share an id are vectors of their own; a
    component's id is its smallest that isn't null, and null where it has none; other columns are
    ignored; an empty table gives none.
    """
    named = classes(vectors)
    reps = stored(named.groupBy("vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    graph, share, used, more = None, 0.0, 0, 6
    while True:
        last = used + more > (TABLES if most is None else most)
        if last:
            graph = stored(_all_links(reps, least))
        else:
            graph = descend(reps, least, tables=range(used, used + more), start=graph)
        used, more = used + more, 2 * more
        linked = graph.where(F.col("cos") >= least)
        roots = stored(components(linked.select(F.col("u").alias("a"), F.col("v").alias("b"))))
        members = reps.join(roots, reps["rep"] == roots["node"]).select("rep", "root", "copies", "vec")
        counts = stored(_tallied(members, least))
        share = audited(reps, counts, least)
        if share >= recall or last:
            break
    known = reps.join(roots, reps["rep"] == roots["node"], "left").join(counts, "rep", "left")
    known = known.select("vec", "low", F.coalesce("root", "rep").alias("root"), (F.coalesce("n", "copies") - 1).alias("links"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.join(known.join(lowest, "root").drop("low", "root"), "vec").select("vec_id", F.col("links").alias("n_links"), "component_id")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0).alias("vec"))
    lone = rest.where(~F.coalesce(usable(F.col("vec")), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = ids.unionByName(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audited_recall", F.lit(float(share)))


def op10_embedding_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and survivors of all embeddings at cosine 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
