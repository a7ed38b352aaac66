"""Folders for published tables: append-only generations behind exclusively created markers.

Everything goes through Hadoop's file system interface, so any store that Spark reads will do.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared checkpoint folder, or in this process's own where the
    session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        named = _LOCAL[0]
    return f"{named.rstrip('/')}/store-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; fails if it is there already."""
    at, fs = _fs(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


class Chain:
    """One dataset's generations below a root: ``rows/sequence=N`` and ``markers/N.json``.

    Rows are written first and count for nothing until their marker exists; the marker's
    exclusive creation is the compare-and-set on the parent, so of two writers one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def head(self) -> int:
        n = 0
        while exists(self.spark, f"{self.root}/markers/{n + 1}.json"):
            n += 1
        return n

    def stage(self, rows: DataFrame, parent: int) -> str:
        """Write rows that count for nothing yet."""
        part = f"{self.root}/rows/sequence={parent + 1}/attempt={uuid.uuid4().hex}"
        rows.write.parquet(part)
        return part

    def commit(self, part: str, parent: int, payload: str | None = None) -> int:
        """Make staged rows the generation on top of ``parent``; raises if another came first. The
        marker keeps the ``payload`` that the rows are known by, if given."""
        if self.head() != parent:
            raise ValueError(f"the head is {self.head()}, not {parent}")
        n = parent + 1
        marker = {"sequence": n, "parent": parent, "rows": self.spark.read.parquet(part).count(), "path": part} | ({} if payload is None else {"payload": payload})
        create_once(self.spark, f"{self.root}/markers/{n}.json", json.dumps(marker))
        return n

    def discard(self, part: str) -> None:
        """Delete staged rows that no marker names."""
        at, fs = _fs(self.spark, part)
        fs.delete(at, True)

    def publish(self, rows: DataFrame, parent: int, payload: str | None = None) -> int:
        """Append a generation on top of ``parent``; raises if another came first."""
        if self.head() != parent:
            raise ValueError(f"the head is {self.head()}, not {parent}")
        return self.commit(self.stage(rows, parent), parent, payload)

    def markers(self, upto: int | None = None) -> list[dict]:
        last = self.head() if upto is None else upto
        return [json.loads(self.spark.read.text(f"{self.root}/markers/{i}.json", wholetext=True).first()[0]) for i in range(1, last + 1)]

    def read(self, upto: int | None = None) -> DataFrame:
        """All rows of the generations up to one, with their ``sequence``."""
        out = None
        for m in self.markers(upto):
            one = self.spark.read.parquet(m["path"]).withColumn("sequence", F.lit(m["sequence"]).cast("long"))
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("the chain is empty")
        return out


def put_raw(spark: SparkSession, root: str, payload: bytes) -> str:
    """Store bytes under their SHA-256, once."""
    import base64
    import hashlib

    path = f"{root}/{(digest := hashlib.sha256(payload).hexdigest())[:2]}/{digest}"
    if not exists(spark, path):
        create_once(spark, path, base64.b64encode(payload).decode())
    return digest


def get_raw(spark: SparkSession, root: str, digest: str) -> bytes:
    """Read bytes back and verify their digest."""
    import base64
    import hashlib

    payload = base64.b64decode(spark.read.text(f"{root}/{digest[:2]}/{digest}", wholetext=True).first()[0])
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("the stored bytes don't have their digest")
    return payload


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Hive-partitioned Parquet, one file a partition and task."""
    df.write.partitionBy(*by).parquet(path)
