"""Readers of provider documents: HTML tables, XML, index files, JSON headers, receipted exports.

Each takes a DataFrame of documents, one a row, so Spark decides where they are read; shapes
that don't fit get a ``fault`` instead of failing the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a master index and the character references of its sibling tables.
INDEX_HEADER = "cik|company name|form type|date filed|file name"
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))


def _cell(html: Column) -> Column:
    text = F.regexp_replace(html, "<[^>]*>", "")
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_table(df: DataFrame, column: str, header: list[str], keep: list[str]) -> DataFrame:
    """Rows of a document's table as text columns; another header or a ragged row is a fault."""
    rows = F.regexp_extract_all(column, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda row, kind: F.transform(F.regexp_extract_all(row, F.lit(rf"(?is)<{kind}(?:\s[^>]*)?>(.*?)</{kind}>"), F.lit(1)), _cell)
    parsed = df.withColumn("_rows", rows).withColumn("_head", cells(F.element_at("_rows", 1), "th"))
    each = parsed.select(*keep, "_head", F.posexplode(F.filter(F.transform("_rows", lambda r: cells(r, "td")), lambda c: F.size(c) > 0)).alias("place", "_c"))
    fault = F.when(~F.coalesce(F.col("_head") == F.array(*[F.lit(h) for h in header]), F.lit(False)), "other_header").when(F.size("_c") != len(header), "ragged_row")
    return each.withColumn("fault", fault).select(*keep, "place", *[F.when(F.col("fault").isNull(), F.get("_c", F.lit(i))).alias(h) for i, h in enumerate(header)], "fault")


def xml_records(df: DataFrame, column: str, schema: str, keep: list[str]) -> DataFrame:
    """One XML record a document, typed by the schema."""
    return df.select(*keep, F.from_xml(column, schema).alias("_x")).select(*keep, "_x.*")


def index_lines(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Entry lines below a master index's header and dashed rule, in its order. A line that isn't
    five fields with a number, form, day and a file below that number stays as its text."""
    lines = F.split(column, "\r?\n")
    names = lambda line: F.array_join(F.transform(F.split(line, r"\|"), lambda n: F.lower(F.trim(n))), "|")
    at = F.array_position(F.transform(lines, lambda x: F.when(names(x) == "cik|company name|form type|date filed|filename", INDEX_HEADER).otherwise(names(x))), INDEX_HEADER)
    ruled = (at > 0) & F.coalesce(F.trim(F.get(lines, at.cast("int"))).rlike("^-{10,}$"), F.lit(False))
    below = F.filter(F.slice(lines, at.cast("int") + 2, F.size(lines)), lambda x: x != "")
    each = df.select(*keep, F.posexplode(F.when(ruled, below)).alias("place", "line")).withColumn("_p", F.split("line", r"\|"))
    p = [F.get("_p", F.lit(i)) for i in range(5)]
    good = (F.size("_p") == 5) & p[0].rlike("^[0-9]{1,10}$") & (p[2] != "") & p[3].try_cast("date").isNotNull() & F.startswith(p[4], F.concat(F.lit("edgar/data/"), p[0], F.lit("/")))
    good = F.coalesce(good, F.lit(False))
    return each.select(*keep, "place", *[F.when(good, c).alias(n) for n, c in (("cik", p[0]), ("company", p[1]), ("form", p[2]))], F.when(good, p[3].try_cast("date")).alias("filed"), F.when(good, p[4]).alias("path"), F.when(~good, F.col("line")).alias("text"))


def company_headers(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Company headers of JSON documents with the latest filing day; other JSON is a fault."""
    j = F.from_json(column, "struct<cik:string,name:string,sic:string,filings:struct<recent:struct<filingDate:array<string>>>>")
    fault = F.when(F.json_object_keys(column).isNull(), "not_an_object")
    read = df.select(*keep, j.alias("_j"), fault.alias("fault"))
    return read.select(*keep, "_j.cik", "_j.name", "_j.sic", F.array_max("_j.filings.recent.filingDate").alias("latest"), "fault")


def two_tables(df: DataFrame, column: str, first: tuple[str, str], second: tuple[str, str], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """One JSON document's two arrays as two tables; each is (field, element type)."""
    read = df.select(*keep, F.from_json(column, f"struct<{first[0]}:array<{first[1]}>,{second[0]}:array<{second[1]}>>").alias("_j"))
    return tuple(read.select(*keep, F.inline(f"_j.{name}")) for name, _ in (first, second))  # type: ignore[return-value]


def reconciled(held: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Rows held of each file against its receipt: whole, short, long, absent or unclaimed."""
    there = held.groupBy(key).agg(F.count("*").alias("held"))
    both = claims.select(key, "claimed").join(there, key, "full")
    state = F.when(F.col("claimed").isNull(), "unclaimed").when(F.col("held").isNull(), "absent").when(F.col("held") < F.col("claimed"), "short").when(F.col("held") > F.col("claimed"), "long").otherwise("whole")
    return both.select(key, "claimed", F.coalesce("held", F.lit(0)).alias("held"), state.alias("state"))


def verified_job(rows: DataFrame, completions: DataFrame, job: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows of completed jobs, typed, and the rows held back: those of jobs whose completion
    promises another number of rows, and those that don't cast."""
    from tidemark.sources.formats import typed

    whole = reconciled(rows, completions, job).where("state = 'whole'").select(job)
    good, bad = typed(rows.join(whole, job, "left_semi"), fields)
    refused = rows.join(whole, job, "left_anti").withColumn("reason", F.lit("unverified_job"))
    return good, refused.unionByName(bad.withColumn("reason", F.concat(F.lit("bad_"), "_bad")).drop("_bad"))


@dataclass(frozen=True)
class Loader:
    """A named reader of a legacy layout; ``nonzero`` says that an empty result is a fault."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    nonzero: bool = True


LOADERS: dict[str, Loader] = {}


def loader(name: str, nonzero: bool = True) -> Callable:
    """Register the decorated (spark, path) function under ``name``."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        LOADERS[name] = Loader(name, f, nonzero)
        return f

    return keep


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    """What the named loader reads; an empty layout is refused where it may not be."""
    own = LOADERS[name]
    rows = own.read(spark, path)
    if own.nonzero and rows.isEmpty():
        raise ValueError(f"{name} found no rows")
    return rows


@loader("series.csv")
def series_csv(spark: SparkSession, path: str) -> DataFrame:
    """Series as all-text CSV (series, day, value); a lone dot is missing."""
    from tidemark.sources.formats import text_csv

    rows = text_csv(spark, path, ["series", "day", "value"])
    return rows.select("series", F.col("day").try_cast("date").alias("day"), F.nullif("value", F.lit(".")).try_cast("double").alias("value"))


@loader("series.response")
def series_response(spark: SparkSession, path: str) -> DataFrame:
    """Series as JSON responses, one a line: a name and its observations."""
    read = spark.read.schema("series string, observations array<struct<day:date,value:double>>").json(path)
    return read.select("series", F.inline("observations"))


@loader("series.parts", nonzero=False)
def series_parts(spark: SparkSession, path: str) -> DataFrame:
    """Series as the Parquet parts of collection runs."""
    return spark.read.schema("series string, day date, value double").parquet(path)
