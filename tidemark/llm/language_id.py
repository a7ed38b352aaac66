"""Language identification by Bayesian evidence fusion (operator 7).

Four sources of evidence meet in one posterior per document:

* text: log-likelihood of its byte trigrams under one multinomial model a language, trained
  on at most ``sample`` documents a declared language (a stated bound; nothing else is
  sampled) and tempered by ``1 / sqrt(n)`` growth so that long texts don't drown the rest;
* the declared markup language, through a confusion table P(declared | language);
* the address suffix and the host, through priors that shrink host counts to their suffix's
  and the suffix's to the corpus's.

The confusion table and the priors are grouped aggregates over all documents. A document is
rejected if its text holds no letters at all or no language reaches ``least``.

Every declared language with at least FEW documents has a model, however small its share. The
documents of rarer ones have one model together, whose outcome is named "und" (undetermined):
such a document passes under that name, not under a frequent language's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

BUCKETS = 1 << 15
SAMPLE = 1500
FEW = 5
UND = "und"
STEP = 1 << 18


def _trigrams(text: str) -> tuple[np.ndarray, int]:
    """Bucket counts of the lower-cased bytes' trigrams (digits and signs as blanks), letters."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    letters = 0
    raw = text.lower().encode("utf-8", "replace")
    for at in range(0, max(len(raw), 1), STEP):
        b = np.frombuffer(b" " + raw[max(0, at - 2) : at + STEP] + b" ", dtype=np.uint8).astype(np.uint32)
        plain = ((b >= 97) & (b <= 122)) | (b >= 128)
        letters += int(plain.sum())
        b = np.where(plain, b, 32)
        keep = ~((b[:-2] == 32) & (b[1:-1] == 32))
        g = (b[:-2] * 65536 + b[1:-1] * 256 + b[2:])[keep]
        counts += np.bincount((g * np.uint32(2654435761)) >> 17, minlength=BUCKETS)[:BUCKETS]
    return counts, letters


def languages(docs: DataFrame) -> dict[str, int]:
    """Declared languages and how many documents declare them, those with fewer than FEW
    documents together as UND."""
    named = docs.where(F.col("declared").isNotNull() & (F.col("declared") != "")).groupBy("declared").agg(F.count("*").alias("n"))
    own = F.when((F.col("n") >= FEW) & (F.col("declared") != UND), F.col("declared")).otherwise(UND)
    return {r["l"]: r["n"] for r in named.groupBy(own.alias("l")).agg(F.sum("n").alias("n")).orderBy("l").collect()}


def _labelled(docs: DataFrame, langs: list[str]) -> DataFrame:
    """``docs`` with ``_as``, the model that the declared language belongs to, or null."""
    known = docs.sparkSession.createDataFrame([(x,) for x in langs], "_l string")
    told = F.when(F.col("declared").isNotNull() & (F.col("declared") != ""), F.coalesce("_l", F.lit(UND if UND in langs else None)))
    return docs.join(F.broadcast(known), F.col("declared") == F.col("_l"), "left").withColumn("_as", told).drop("_l")


def train(docs: DataFrame, counts: dict[str, int], sample: int = SAMPLE) -> np.ndarray:
    """(languages, BUCKETS) log-probabilities from a bounded sample a language.

    A hash of the id picks about twice the sample, its smallest hashes are the sample; so no
    window ever holds more than that.
    """
    langs = list(counts)
    shares = docs.sparkSession.createDataFrame([(x, min(1_000_000, -(-2_000_000 * sample // n))) for x, n in counts.items()], "_as string, _share long")
    docs = _labelled(docs, langs).drop("declared").join(F.broadcast(shares), "_as").withColumnRenamed("_as", "declared")
    order = W.partitionBy("declared").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = docs.select("doc_id", "declared", "_share").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < F.col("_share"))
    ids = some.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample)
    chosen = stored(ids.select("doc_id").distinct())
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("declared", "text")  # <= languages x sample ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    held[lang] += _trigrams(text)[0]
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], ["declared", "bucket", "n"])

    got = rows.mapInArrow(count, "declared string, bucket long, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))
    model = np.full((len(langs), BUCKETS), 0.5)
    packed = got.groupBy("declared").agg(F.collect_list(F.struct("bucket", "n")).alias("rows"))  # at most BUCKETS a language
    place = {lang: i for i, lang in enumerate(langs)}
    for r in packed.toLocalIterator():
        for bucket, n in r["rows"]:
            model[place[r["declared"]], bucket] += n
    return np.log(model / model.sum(1, keepdims=True))


def text_scores(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``docs`` keys with ``ll`` (tempered log-likelihoods) and ``letters``; whole texts.

    The text is the column ``text``, which is dropped, or else the field ``text`` of ``row``,
    which is kept.
    """
    weights = np.ascontiguousarray(model.T)
    keys = [c for c in docs.columns if c != "text"]
    carried = "text" not in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ll, letters = [], []
            for t in (b.column("row").field("text") if carried else b.column("text")).to_pylist():
                counts, n = _trigrams(t) if t else (np.zeros(BUCKETS, np.int64), 0)
                total = int(counts.sum()) if n else 0
                at = np.flatnonzero(counts)
                own = counts[at] @ weights[at] if total else np.zeros(weights.shape[1])
                ll.append((own / max(1.0, total**0.5)).tolist())
                letters.append(n)
            arrays = [*(b.column(k) for k in keys), pa.array(ll, pa.list_(pa.float64())), pa.array(letters, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "ll", "letters"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.select(*keys, *([] if carried else ["text"])).mapInArrow(run, f"{schema}, ll array<double>, letters long")


def _argmax(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int")


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raw = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, _best, n) to each key's total and its counts by language, at most one each."""
    some = F.when(F.col("_best").isNotNull(), F.struct("_best", "n"))
    return rows.groupBy(*keys).agg(F.sum(F.when(F.col("_best").isNotNull(), F.col("n")).otherwise(0.0)).alias("_total"), F.map_from_entries(F.collect_list(some)).alias("_counts"))


def _shrunk(above: str, k: int, weight: float) -> Column:
    """(n_l + weight * parent_l) / (n + weight) for each of the k languages."""
    own = lambda i: F.coalesce(F.try_element_at("_counts", i), F.lit(0.0))
    return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (own(i) + weight * F.element_at(F.col(above), i)) / (F.col("_total") + weight))


def fused(scored: DataFrame, langs: list[str], least: float = 0.5, smooth: float = 20.0) -> DataFrame:
    """Scored rows with the identified ``language``, its ``posterior`` and ``accepted``."""
    k = len(langs)
    if not k:
        return scored.withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(0.0), "accepted": F.lit(False)})
    told = scored.withColumn("_best", F.when(F.col("letters") > 0, _argmax(F.col("ll"))))
    suffix = F.when(F.col("host").contains("."), F.lower(F.element_at(F.split("host", r"\."), -1))).otherwise("")
    told = told.withColumn("_host", F.coalesce("host", F.lit(""))).withColumn("_suffix", F.coalesce(suffix, F.lit("")))
    hosts = stored(told.groupBy("_host", "_suffix", "_best").agg(F.count("*").cast("double").alias("n")))
    found = {r[0]: r[1] for r in hosts.where("_best is not null").groupBy("_best").agg(F.sum("n")).collect()}
    every = [found.get(i + 1, 0.0) for i in range(k)]
    total = sum(every)
    corpus = F.array(*[F.lit((n + 1.0) / (total + k)) for n in every])
    suffixes = _counted(hosts.groupBy("_suffix", "_best").agg(F.sum("n").alias("n")), "_suffix").withColumn("_all", corpus)
    suffixes = suffixes.select("_suffix", _shrunk("_all", k, smooth).alias("_above"))
    priors = _counted(hosts, "_host", "_suffix").join(suffixes, "_suffix").select("_host", _shrunk("_above", k, smooth).alias("_prior"))

    told = _labelled(told, langs)
    pairs = {(r[0], r[1]): r[2] for r in told.where("_best is not null").groupBy("_as", "_best").agg(F.count("*").alias("n")).collect()}  # (languages + 1)^2
    names = [*langs, None]
    heard = [sum(pairs.get((e, i + 1), 0) for e in names) + len(names) for i in range(k)]
    table_ = [(d or "", [float((pairs.get((d, i + 1), 0) + 1.0) / heard[i]) for i in range(k)]) for d in names]
    confusion = F.broadcast(scored.sparkSession.createDataFrame(table_, "_d string, _row array<double>"))
    joined = told.join(priors, "_host").join(confusion, F.coalesce("_as", F.lit("")) == F.col("_d"))
    joined = joined.withColumn("_spoken", F.when(F.col("declared").isNull(), F.array_repeat(F.lit(1.0), k)).otherwise(F.col("_row")))
    scores = F.transform(F.arrays_zip(F.col("ll").alias("a"), F.col("_spoken").alias("b"), F.col("_prior").alias("c")), lambda x: x["a"] + F.log(x["b"]) + F.log(x["c"]))
    out = joined.withColumn("_post", _softmax(scores)).withColumn("_at", _argmax(F.col("_post")))
    return out.select(
        *scored.columns, F.element_at(F.array(*[F.lit(x) for x in langs]), F.col("_at")).alias("language"), F.array_max("_post").alias("posterior"),
        ((F.col("letters") > 0) & (F.array_max("_post") >= least)).alias("accepted"),
    )


def identified(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """``(doc_id, declared, host, ll, letters, language, posterior, accepted)`` a row of docs.

    Null or letterless texts keep the fused guess of the other evidence but are rejected;
    null hosts share one prior; a null or empty declared language is evidence of its own, and
    one with fewer than FEW documents counts as UND;
    ties go to the first language by name; repeated rows are judged alike; an empty table
    gives none.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(declared).alias("declared"), F.col(host).alias("host"), F.col(text).alias("text"))
    counts = languages(own)
    langs = list(counts)
    model = train(own, counts) if langs else np.zeros((0, BUCKETS))
    return fused(stored(text_scores(own, model)), langs, least)


def screened(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rejected rows, ``lang`` being the identified language (UND for the rarest)."""
    own = docs.select("doc_id", F.col("lang").alias("declared"), F.col("source").alias("host"), "text")
    counts = languages(own)
    langs = list(counts)
    model = train(own, counts) if langs else np.zeros((0, BUCKETS))
    rows = docs.select(F.col("lang").alias("declared"), F.col("source").alias("host"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    judged = fused(stored(text_scores(rows, model)), langs, least).where("accepted")
    return judged.select(*[F.col("language").alias(c) if c == "lang" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def op7_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and acceptance of every document."""
    out = identified(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "declared", "language", F.round("posterior", 6).alias("posterior"), "accepted")
