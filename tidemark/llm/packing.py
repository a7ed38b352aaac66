"""Packing token sequences by non-negative least squares (operator 3).

Each document becomes its ids and a closing id 0, cut into whole windows and one rest
shorter than a window.  Only the histogram of lengths (one row a length, so at most
``window`` rows) reaches the driver.  There all pairs and triples of lengths that fill a
window exactly are enumerated, coordinate descent solves for non-negative repeat counts that
reproduce the histogram in the least-squares sense, the counts are rounded within what the
histogram has, and the residual lengths are packed greedily.  The plan says, for each length,
which ranks go to which sequences; pieces find their rank by seeded cells, so that no length,
however common, is ranked in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

WINDOW = 1024
CACHED = 100_000_000
SEGMENT = 500_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokens never begin before a single space between two characters that
    aren't white space and end after it, and a single line feed between such characters is one
    of its own. So a text is the concatenation of its space-led chunks' and line feeds' ids.
    The vocabulary's added tokens, such as its end-of-text mark, are cut out first: each is one
    id, and the text on its two sides is encoded on its own. Chunks met before come from a memo
    of at most CACHED characters beyond a batch's own; new ones are encoded together.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.marks = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.mark = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        size = self.tokenizer.get_vocab_size()
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.memo: dict[str, bytes] = dict(self.marks)
        self.held = 0

    @staticmethod
    def chunks(text: str) -> list[str]:
        if "\0" not in text:
            plain = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            blank = text.count(" ") + text.count("\n")
            if "" not in plain and " " not in plain and sum(map(len, text.split())) == len(text) - blank:
                return plain  # no white space beside other white space, nor of any other kind
        first, *rest = _SAFE.split(text)
        return [first, *(" " + w for w in rest)] if first else [" " + w for w in rest]

    def _learn(self, new: list[str]) -> None:
        joined = [w for w in new if w[0] == " " and not w[-1].isspace()]
        alone = [w for w in new if not (w[0] == " " and not w[-1].isspace())]
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)] + [[w] for w in alone]
        for group, found in zip(groups, self.tokenizer.encode_batch(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            ends = np.cumsum([len(w.encode("utf-8", "replace")) for w in group])
            cuts = (4 * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            self.held += sum(map(len, group)) + len(raw) // 4
            self.memo.update((w, raw[a:b]) for w, a, b in zip(group, [0, *cuts], cuts, strict=False))

    def _segments(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > SEGMENT and (m := _SAFE.search(text, at + SEGMENT)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def _parts(self, text: str) -> list[str]:
        """Chunks and added tokens of a text."""
        if self.mark is None or not (found := self.mark.findall(text)):
            return [c for seg in self._segments(text) for c in self._cut(seg)]
        plain = [[c for seg in self._segments(t) for c in self._cut(seg)] for t in self.mark.split(text)]
        return [c for own, mark in zip(plain, [*found, None], strict=True) for c in ([*own, mark] if mark else own)]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in texts]
        if self.held > CACHED:
            self.memo, self.held = dict(self.marks), 0
        memo = self.memo
        if new := [w for w in {w for p in parts for w in p} if w not in memo]:
            self._learn(new)
        return [b"".join(map(memo.__getitem__, p)) for p in parts]

    def _cut(self, segment: str) -> list[str]:
        """A later segment begins with its space, which belongs to its first chunk."""
        if segment[:1] == " " and segment[1:2] and not segment[1].isspace():
            first, *rest = self.chunks(segment[1:])
            return [" " + first, *rest]
        return self.chunks(segment) if segment else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder a worker process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", window: int = WINDOW, ids: bool = False) -> DataFrame:
    """Documents cut into windows and a rest; with ``ids`` the pieces' token ids too."""
    schema = PIECES + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                cols: list[list] = [[] for _ in range(6)]
                for doc, own in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    own += b"\0\0\0\0"
                    total = len(own) // 4
                    for start in range(0, total, window):
                        piece = own[4 * start : 4 * (start + window)]
                        row = (doc, start, len(piece) // 4, zlib.crc32(piece), total)
                        for c, v in zip(cols, row, strict=False):
                            c.append(v)
                        if ids:
                            cols[5].append(np.frombuffer(piece, "<u4").astype(np.int32))
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + ([pa.array(cols[5], pa.list_(pa.int32()))] if ids else [])
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Pairs and triples of the given lengths that fill the window exactly."""
    have = set(lengths)
    pairs = [(a, window - a) for a in lengths if a >= window - a and window - a in have]
    triples = [(a, b, c) for i, a in enumerate(lengths) for b in lengths[i:] if (c := window - a - b) <= b and c in have] if lengths else []
    return pairs + triples


def solve(hist: dict[int, int], combos: list[tuple[int, ...]], sweeps: int = 8) -> list[float]:
    """Non-negative least squares ``A x = hist`` by cyclic coordinate descent, A's columns
    being the combinations' length counts."""
    left = {k: float(v) for k, v in hist.items()}
    columns = [{k: c.count(k) for k in set(c)} for c in combos]
    norms = [sum(n * n for n in col.values()) for col in columns]
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            slope = sum(n * left[k] for k, n in col.items()) / norms[j]
            step = slope if slope > -x[j] else -x[j]
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, n in col.items():
                    left[k] -= n * step
        if moved < 0.25:
            break
    return x


def plan(hist: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how often) that use every length exactly as often as it is."""
    out = [((window,), hist[window])] if hist.get(window) else []
    left = {k: v for k, v in hist.items() if v and k != window}
    combos = combinations(sorted(left, reverse=True), window)
    x = solve(left, combos)
    for j in sorted(range(len(combos)), key=lambda j: (-x[j], combos[j])):
        n = min([round(x[j]), *(left[k] // combos[j].count(k) for k in set(combos[j]))])
        if n > 0:
            out.append((combos[j], n))
            for k in combos[j]:
                left[k] -= n
    live = sorted((k for k, v in left.items() if v), reverse=True)
    while live:
        room, own = window, []
        used: dict[int, int] = {}
        for k in live:
            if k <= room and (n := min(room // k, left[k])):
                own += [k] * n
                used[k] = n
                room -= n * k
        n = min(left[k] // m for k, m in used.items())
        out.append((tuple(own), n))
        for k, m in used.items():
            left[k] -= n * m
        live = [k for k in live if left[k]]
    return out


def packed(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored pieces with their ``sequence_id`` and ``offset``."""
    counted = cut.groupBy("length").agg(F.count("*").alias("n"))
    hist = {int(r["length"]): int(r["n"]) for r in counted.collect()}  # at most `window` rows
    slots: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for lengths, n in plan(hist, window):
        offset = 0
        for k in lengths:
            slots.setdefault(k, []).append((seen.get(k, 0), sequence, offset))
            seen[k] = seen.get(k, 0) + n
            offset += k
        sequence += n
    find = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in slots.items()}

    total = sum(hist.values())
    cells = max(1, int(total**0.5))
    celled = cut.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "start"), F.lit(cells)))
    sizes = celled.groupBy("length", "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("length", "_cell", before.alias("_before"))
    own = F.row_number().over(W.partitionBy("length", "_cell").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = celled.withColumn("_own", own).join(offsets, ["length", "_cell"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    names = [c for c in cut.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                at = length == k
                first, base, offset = find[int(k)]
                slot = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = base[slot] + rank[at] - first[slot], offset[slot]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*names, "_rank").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def op3_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens.

    A null or empty text is the closing id alone; a text of any length is cut into windows and a
    rest; repeated rows are packed as often as they occur; ties within a length go by id and
    start; other columns are ignored; an empty table gives no sequences.
    """
    return packed(stored(pieces(table(spark, sf_dir, "documents"))))
