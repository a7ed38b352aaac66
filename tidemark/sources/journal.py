"""Publications that happen once: an intent before the marker, a completion after it.

Both are small files that are created exclusively. What a crash leaves is an intent without a
completion, and ``recover`` tells from the chain's markers what became of it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.requests import receipts
from tidemark.sources.storage import Chain, _fs, create_once, exists


def payload_of(rows: DataFrame, columns: list[str]) -> str:
    """Count and checksum of a payload, whatever the order of its rows."""
    r = receipts(rows, columns, []).first()
    return f"{r['n']}:{r['checksum']}"


class Journal:
    """Intents and completions below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, kind: str, operation: str) -> str:
        return f"{self.root}/{kind}/{operation}.json"

    def _read(self, path: str) -> dict:
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def prepare(self, operation: str, intent: dict) -> dict:
        """Note an intent; the same operation with another intent is refused."""
        path = self._path("prepared", operation)
        if not exists(self.spark, path):
            create_once(self.spark, path, json.dumps(intent, sort_keys=True))
        if (held := self._read(path)) != intent:
            raise ValueError(f"{operation} already stands for another request")
        return held

    def complete(self, operation: str, outcome: str) -> None:
        create_once(self.spark, self._path("completed", operation), json.dumps({"outcome": outcome}))

    def outcome(self, operation: str) -> str | None:
        path = self._path("completed", operation)
        return self._read(path)["outcome"] if exists(self.spark, path) else None

    def unfinished(self) -> dict[str, dict]:
        """Intents without a completion, by operation."""
        at, fs = _fs(self.spark, f"{self.root}/prepared")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        found = [n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith(".")]
        return {o: self._read(self._path("prepared", o)) for o in found if self.outcome(o) is None}


def publish_once(chain: Chain, journal: Journal, operation: str, rows: DataFrame, columns: list[str], parent: int) -> int:
    """Publish ``rows`` as the generation after ``parent``; done again, it changes nothing.

    The rows are staged first, so the payload is that of the rows that will be read, whatever a
    second run of their plan would give. If another generation took the place, the operation
    ends as superseded and this raises.
    """
    part = chain.stage(rows, parent)
    payload = payload_of(chain.spark.read.parquet(part), columns)
    journal.prepare(operation, {"parent": parent, "payload": payload})
    outcome = journal.outcome(operation)
    if outcome is None:
        stands = _stands(chain, parent, payload)
        if stands is None:
            chain.commit(part, parent, payload)
            part = None
        outcome = "superseded" if stands is False else "published"
        journal.complete(operation, outcome)
    if part is not None:
        chain.discard(part)
    if outcome != "published":
        raise ValueError(f"{operation} is {outcome}")
    return parent + 1


def _stands(chain: Chain, parent: int, payload: str) -> bool | None:
    """Whether the generation after ``parent`` is this payload; None if there is none."""
    markers = chain.markers()
    return None if len(markers) <= parent else markers[parent].get("payload") == payload


def recover(chain: Chain, journal: Journal) -> dict[str, str]:
    """What became of unfinished operations: published if the marker holds the payload (noted as
    complete), superseded if another generation took the place, pending if there is none yet."""
    found = {}
    for operation, intent in journal.unfinished().items():
        stands = _stands(chain, intent["parent"], intent["payload"])
        found[operation] = "pending" if stands is None else "published" if stands else "superseded"
        if stands is not None:
            journal.complete(operation, found[operation])
    return found
