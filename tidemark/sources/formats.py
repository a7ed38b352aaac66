"""Strict readers of provider formats: all-text CSV, exact-key JSON, parallel arrays, nested maps, archives."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """CSV as text in exactly these columns; another header or a ragged row fails."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    options = {"header": True, "enforceSchema": False, "mode": "FAILFAST", "quote": "", "escape": "", "nullValue": "\0", "emptyValue": ""}
    return spark.read.schema(schema).options(**options).csv(path)


def exact_json(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """JSON objects with exactly these keys to typed columns; ``_fault`` names the others."""
    schema = T.StructType([T.StructField(n, T.DataType.fromDDL(k)) for n, k in fields.items()])
    keys = F.json_object_keys(column)
    fault = F.when(keys.isNull(), "not_an_object").when(F.array_sort(keys) != F.array_sort(F.array(*[F.lit(n) for n in fields])), "other_keys")
    return df.withColumn("_j", F.from_json(column, schema)).withColumn("_fault", fault).select("*", "_j.*").drop("_j")


def parallel_rows(df: DataFrame, arrays: list[str], keep: list[str]) -> DataFrame:
    """Parallel arrays to one row a position; shorter arrays end in nulls."""
    return df.select(*keep, F.inline(F.arrays_zip(*arrays)))


def nested_facts(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Facts nested as taxonomy, tag, unit to rows."""
    shape = "map<string,map<string,map<string,array<struct<end:string,val:string>>>>>"
    a = df.select(*keep, F.explode(F.from_json(column, shape)).alias("taxonomy", "_t"))
    b = a.select(*keep, "taxonomy", F.explode("_t").alias("tag", "_u"))
    c = b.select(*keep, "taxonomy", "tag", F.explode("_u").alias("unit", "_f"))
    return c.select(*keep, "taxonomy", "tag", "unit", F.explode("_f").alias("f")).select(*keep, "taxonomy", "tag", "unit", "f.end", "f.val")


def typed(df: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose text casts to all the types, and the rows held back with the first bad field."""
    casts = {n: F.col(n).try_cast(k) for n, k in fields.items()}
    bad: Column = F.lit(None).cast("string")
    for n in reversed(list(fields)):
        bad = F.when(F.col(n).isNotNull() & casts[n].isNull(), n).otherwise(bad)
    marked = df.withColumn("_bad", bad)
    return marked.where("_bad is null").drop("_bad").withColumns(casts), marked.where("_bad is not null")


def zip_members(files: DataFrame) -> DataFrame:
    """Members of the ZIP archives of a ``binaryFile`` read."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(path, i.filename, i.file_size, z.read(i)) for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["path", "member", "size", "content"])

    return files.select("path", "content").mapInPandas(members, "path string, member string, size long, content binary")


def sqlite_table(files: DataFrame, table: str, schema: str) -> DataFrame:
    """One table of each closed SQLite file of a ``binaryFile`` read."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with closing(sqlite3.connect(":memory:")) as con:
                    con.deserialize(bytes(content))
                    yield pd.read_sql_query(f'SELECT * FROM "{table}"', con)

    return files.select("content").mapInPandas(rows, schema)
