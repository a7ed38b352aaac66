"""Shared plumbing of the training-data operators.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``
(shared by the driver and all executors, so a lost executor costs a re-read, not a
recomputation).  Only where that setting is absent, as in unit tests, a temporary folder
of this process is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches, key: str):
    """Arrow batches sorted by ``key`` regrouped into tables that hold whole groups.

    Holds a batch and the group under way, not the partition.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        column = b.column(key)
        last = column[b.num_rows - 1]
        cut = pc.index(column, last).as_py()
        if held and (cut or held[0].column(key)[0] != last):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
