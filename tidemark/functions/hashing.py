"""Content addresses of records, revisions and row sets, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """JSON string form of text: backslash, quote and all control characters are escaped."""
    rare = F.to_json(F.struct(text.alias("t")))
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, safe in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    plain = F.concat(F.lit('"'), out, F.lit('"'))
    return F.when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.substring(rare, F.lit(6), F.length(rare) - 6)).otherwise(plain)


def _array(parts: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def record_id(domain: str, keys: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of a natural key."""
    pairs = [_array([quoted(F.lit(n)), quoted(c.cast("string"))]) for n, c in keys.items()]
    return F.sha2(_array([quoted(F.lit("tidemark-record-1")), quoted(F.lit(domain)), _array(pairs)]).cast("binary"), 256)


def revision_id(dataset: Column, record: Column, op: Column, supersedes: Column, row_hash: Column) -> Column:
    """SHA-256 over what makes a revision itself; a null predecessor is JSON null."""
    before = F.when(supersedes.isNull(), "null").otherwise(quoted(supersedes))
    return F.sha2(_array([quoted(F.lit("tidemark-revision-1")), quoted(dataset), quoted(record), quoted(op), before, quoted(row_hash)]).cast("binary"), 256)


def minted(prefix: str, namespace: str, token: Column) -> Column:
    """A stable id for a token of a namespace."""
    return F.concat(F.lit(prefix), F.sha2(_array([quoted(F.lit("tidemark-id-1")), quoted(F.lit(namespace)), quoted(token)]).cast("binary"), 256))


def encoded_row(columns: dict[str, str]) -> Column:
    """Length-prefixed, type-tagged cells of a row; nulls are told from empty text."""
    cells = []
    for name, tag in columns.items():
        text = F.col(name).cast("string")
        cells.append(F.when(F.col(name).isNull(), f"{tag}:~").otherwise(F.concat(F.lit(f"{tag}:"), F.length(text).cast("string"), F.lit(":"), text)))
    return F.concat(*cells)


def rowset_digest(rows: DataFrame, columns: dict[str, str], by: list[str]) -> DataFrame:
    """An order-independent digest: the sums of four 64-bit slices of each row's SHA-256.

    Sums of exact decimals commute, so the digest is a plain grouped aggregate that combines
    before the shuffle, whatever the table's size.
    """
    h = F.sha2(encoded_row(columns).cast("binary"), 256)
    slices = [F.conv(F.substring(F.col("_h"), 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)") for i in range(4)]
    return rows.withColumn("_h", h).groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *[F.sum(s).cast("string") for s in slices]).cast("binary"), 256).alias("digest"))
