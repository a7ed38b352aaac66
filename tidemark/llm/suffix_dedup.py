"""Exact substring dedup over a difference-cover suffix array (operator 5).

A byte goes if a 50-byte string over it also starts in a document with a smaller id. Sorting
every suffix of a large corpus would shuffle many times its size, so the array is built only
where something can match, and that selection loses nothing:

* an anchor is a 24-byte string whose hash is smallest among the 27 of some 50-byte string.
  Equal 50-byte strings have equal anchors, so a string can repeat only around an anchor that
  occurs in two documents.
* the 26 bytes before a repeated anchor, the anchor and the 26 bytes behind it are its context;
  beyond the ends of a text it holds 0xFF, which UTF-8 never has. It holds every 50-byte string
  of its anchor. A context whose bytes a smaller document has too is covered whole, so only
  distinct ones go on, each with its smallest document, its owner.
* distinct contexts meet at their anchor. Those that share a window hash are suffix-sorted by
  the difference cover modulo 3: sampled triples are sorted and named, names are sorted
  recursively, the remaining suffixes are merged in, and neighbours that agree on 50 bytes fall
  into one class with its smallest owner.
* an anchor that more than HOT parts hold may have unboundedly many distinct contexts. Theirs
  don't meet at the anchor: each of their 27 windows goes to a group of its own hash.

Documents sit in parts of about PART_BYTES by a hash of their id; texts are dealt once, and the
same exchange serves all four passes over them. A part sends every key, context and window at
most once, as sorted runs, and a group answers a run item by item, so no item, however common,
makes more rows than there are parts, and there are never more runs than items. A part's text,
and what as many bytes of text can send to one group, is the most that a task holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

DEPTH = 50
K = 24
SPAN = DEPTH - K + 1
SIDE = DEPTH - K
WIDE = DEPTH + SIDE
PART_BYTES = 8 << 20
HOT = 64
SLICE = 1 << 15  # an array of 64-bit hashes stays in a core's cache
SORTED_AT_ONCE = 400_000
END = 0xFF


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _hashes(a: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size``-byte string, from those of the powers of two below."""
    h, have = _mixed(a.astype(np.uint64) + np.uint64(1)), 1
    out, done = None, 0
    while True:
        if size & have:
            out = h if out is None else _mixed(out[: len(h) - done] * np.uint64(0xA24BAED4963EE407) + h[done:])
            done += have
        if 2 * have > size:
            return out
        h, have = _mixed(h[:-have] * np.uint64(0xC2B2AE3D27D4EB4F) + h[have:]), 2 * have


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Extreme of every run of ``width`` by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out, have = pick(out[:-have], out[have:]), have * 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all 50-byte strings without END, in order."""
    at, hs = [], []
    for s in range(0, len(line) - DEPTH + 1, SLICE):
        a = line[s : s + SLICE + DEPTH - 1]
        h = _hashes(a, K)
        ended = _sliding((a == END).view(np.uint8), DEPTH, np.maximum)
        low = np.where(ended == 0, _sliding(h, SPAN, np.minimum), np.uint64(0))
        edge = np.zeros(SPAN - 1, np.uint64)
        top = _sliding(np.concatenate([edge, low, edge]), SPAN, np.maximum)
        own = np.flatnonzero((top == h) & (top > 0))
        at.append(own + s)
        hs.append(h[own])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, first = np.unique(np.concatenate(at), return_index=True)
    return pos, np.concatenate(hs)[first]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One integer for each pair of integers from 0, in order of the pairs."""
    wide = int(b.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * wide >= 1 << 63:
        a = np.unique(a, return_inverse=True)[1]
    return a.astype(np.int64) * wide + b


def suffix_order(s: np.ndarray, reach: int) -> np.ndarray:
    """Suffixes of ``s`` (values from 1; 0 ends a string) in order of their first ``reach``
    values at least, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)])
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    cover = np.concatenate([one, two])
    pair = _joined(t[:-1], t[1:])
    key = _joined(pair[:-1], t[2:])[cover]
    triple = np.argsort(key)
    new = _heads(key[triple])
    names = np.empty(len(cover), np.int64)
    names[triple] = np.cumsum(new)
    if reach > 3 and not new.all():
        line = np.concatenate([names[: len(one)], [0], names[len(one) :]])
        deep = suffix_order(line, -(-reach // 3))
        deep = deep[deep != len(one)]
        names[np.where(deep > len(one), deep - 1, deep)] = np.arange(1, len(deep) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[cover] = names
    in_cover = cover[np.argsort(names, kind="stable")]
    # An uncovered suffix is told from covered ones by a rank one or two places on.
    near, far = _joined(t[:-1], rank[1:]), _joined(pair[:-1], rank[2:])
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(near[zero])]
    first = in_cover[in_cover % 3 == 1]
    second = in_cover[in_cover % 3 == 2]
    lo = np.searchsorted(near[first], near[zero], side="right") + np.searchsorted(far[second], far[zero], side="right")
    out = np.empty(n, np.int64)
    mine = np.maximum.accumulate(lo) + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[mine] = False
    out[mine] = zero
    out[rest] = in_cover
    return out


def repeated_windows(contexts: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each context (a row) the offsets, as bits, of its windows that a context of a smaller
    owner has too."""
    n = len(contexts)
    s = np.zeros((n, WIDE + 1), np.int64)
    s[:, :WIDE] = contexts.astype(np.int64) + 1
    order = suffix_order(s.ravel(), DEPTH + 4)
    piece, offset = order // (WIDE + 1), order % (WIDE + 1)
    whole = offset < SPAN
    piece, offset = piece[whole], offset[whole]
    whole = _whole(contexts)[piece, offset]
    piece, offset = piece[whole], offset[whole]
    masks = np.zeros(n, np.uint32)
    if len(piece) < 2:
        return masks
    view = np.lib.stride_tricks.sliding_window_view(contexts.ravel(), DEPTH)
    at = piece * WIDE + offset
    new = np.ones(len(at), bool)
    for i in range(1, len(at), 100_000):
        stop = min(len(at), i + 100_000)
        new[i:stop] = (view[at[i:stop]] != view[at[i - 1 : stop - 1]]).any(1)
    least = np.minimum.reduceat(owners[piece], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = owners[piece] > least
    np.bitwise_or.at(masks, piece[hit], np.uint32(1) << offset[hit].astype(np.uint32))
    return masks


def _whole(contexts: np.ndarray) -> np.ndarray:
    """Which of a context's windows hold no END."""
    ends = np.concatenate([np.zeros((len(contexts), 1), np.int64), np.cumsum(contexts == END, axis=1)], axis=1)
    return ends[:, DEPTH:] == ends[:, :SPAN]


def _windows(contexts: np.ndarray) -> np.ndarray:
    """Hashes of each context's windows."""
    flat = _hashes(contexts.ravel(), DEPTH)
    return np.append(flat, np.zeros(DEPTH - 1, np.uint64)).reshape(-1, WIDE)[:, :SPAN]


class _Part:
    """A part's documents on one line, END between them, and what its passes derive from it."""

    def __init__(self, rows: pa.Table, n: int):
        self.n, self.me = n, rows.column("part")[0].as_py()
        self.ids = rows.column("id").to_numpy()
        texts = rows.column("raw").to_pylist()
        self.sizes = np.array([len(t) for t in texts], np.int64)
        gap = bytes([END]) * SIDE
        self.line = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
        self.starts = SIDE + np.cumsum(np.append(0, self.sizes[:-1] + SIDE))
        self.pos, h = anchors(self.line)
        self.owner = np.repeat(self.ids, np.diff(np.append(np.searchsorted(self.pos, self.starts), len(self.pos))))
        self.code = (((h >> np.uint64(40)) % np.uint64(n)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))

    def keys(self):
        """Distinct anchor keys in order and which of them two documents have."""
        order = np.argsort(self.code)
        code, owner = self.code[order], self.owner[order]
        new = _heads(code)
        heads = np.flatnonzero(new)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        return code[heads], np.minimum.reduceat(owner, heads) < np.maximum.reduceat(owner, heads) if len(heads) else new

    def contexts(self, status: np.ndarray):
        """Distinct contexts at repeated anchors: (hash, second hash, smallest id, kind)."""
        self.keys()
        kind = status[self.place] if len(status) else np.zeros(0, np.uint8)
        kept = kind > 0
        self.at, self.who, self.kind, self.group = self.pos[kept], self.owner[kept], kind[kept], (self.code[kept] >> np.uint64(32)).astype(np.int64)
        h = np.zeros(len(self.at), np.uint64)
        h2 = np.zeros(len(self.at), np.uint32)
        for i in range(0, len(self.at), 100_000):
            wide = np.zeros((len(self.at[i : i + 100_000]), WIDE + 4), np.uint8)
            wide[:, :WIDE] = self.cut(self.at[i : i + 100_000])
            words = wide.view("<u8")
            a, b = np.full(len(wide), 1, np.uint64), np.full(len(wide), 2, np.uint64)
            for w in words.T:
                a, b = _mixed((a ^ w) * np.uint64(0xC2B2AE3D27D4EB4F)), _mixed((b + w) * np.uint64(0xD6E8FEB86659FD93))
            h[i : i + 100_000], h2[i : i + 100_000] = a, b >> np.uint64(32)
        order = np.argsort(h)
        if (~_heads(h[order]) & np.append(False, h2[order][1:] != h2[order][:-1])).any():
            order = np.lexsort((h2, h))
        new = _heads(h[order], h2[order])
        heads, klass = np.flatnonzero(new), np.cumsum(new) - 1
        first = order[heads]
        if len(heads):  # the first place of each one's smallest document
            least = np.minimum.reduceat(self.who[order], heads)
            first = np.minimum.reduceat(np.where(self.who[order] == least[klass], order, len(order)), heads)
        dest = (h[first] % np.uint64(self.n)).astype(np.int64)
        by = np.argsort(dest, kind="stable")
        turn = np.empty(len(by), np.int64)
        turn[by] = np.arange(len(by))
        self.klass = np.empty(len(order), np.int64)
        self.klass[order] = turn[klass]
        self.first = first = first[by]
        return dest[by], h[first], h2[first], self.who[first], self.kind[first]

    def cut(self, at: np.ndarray) -> np.ndarray:
        """The contexts at some positions, one a row."""
        return np.lib.stride_tricks.sliding_window_view(self.line, WIDE)[at - SIDE]

    def cold(self, own: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes that are owned here and meet at their anchor, in order of its group."""
        found = np.flatnonzero(own & (kind == 1))
        group = self.group[self.first[found]]
        order = np.argsort(group, kind="stable")
        return found[order], group[order]

    def covered(self, answers: pa.Table) -> np.ndarray:
        """Which bytes of the line a smaller document covers."""
        *_, least, kind = self.contexts(_told(answers, 1, "u1"))
        own = _told(answers, 2, "u1").astype(bool)
        masks = np.zeros(len(kind), np.uint32)
        masks[self.cold(own, kind)[0]] = _told(answers, 3, "<u4")
        hot = np.flatnonzero(own & (kind == 2))
        if len(hot):
            (*_, smallest), place = self.windows(hot)
            mine = _told(answers, 0, "u1").astype(bool)
            smaller = (place >= 0) & (~mine[place] | (smallest[place] < least[hot][:, None]))
            masks[hot] = (smaller.astype(np.uint32) << np.arange(SPAN, dtype=np.uint32)).sum(1, dtype=np.uint32)
        whole = ~own[self.klass] | (self.who > least[self.klass])
        bits = np.where(whole, np.uint32(0), masks[self.klass])
        edge = np.zeros(len(self.line) + 1, np.int32)
        spans = [(self.at[whole] - SIDE, WIDE)] + [(self.at[(bits >> np.uint32(o)) & np.uint32(1) > 0] - SIDE + o, DEPTH) for o in range(SPAN)]
        for begin, size in spans:
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + size, -1)
        return (np.cumsum(edge[:-1], dtype=np.int32) > 0) & (self.line != END)

    def windows(self, hot: np.ndarray):
        """Distinct windows of the contexts of some classes: (where, hash, second hash, smallest
        id) and for each class and offset its window's place, or -1."""
        cut = self.cut(self.at[self.first[hot]])
        h, fine = _windows(cut), _whole(cut)
        row, off = np.nonzero(fine)
        own, who = h[row, off], self.who[self.first[hot]][row]
        more = (_windows(cut ^ np.uint8(0x5A))[row, off] >> np.uint64(32)).astype(np.uint32)
        dest = own % np.uint64(self.n)
        order = np.lexsort((who, more, own, dest))
        new = _heads(own[order], more[order])
        place = np.full(fine.shape, -1, np.int64)
        place[row[order], off[order]] = np.cumsum(new) - 1
        first = order[new]
        return (dest[first].astype(np.int64), own[first], more[first], who[first]), place


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0) if len(new) > 1 else False
    return new


def _cuts(group: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, their like bytes together, which packs well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplaned(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


SENT = "dest long, part int, a binary, b binary"
ANSWER = "part int, kind int, src long, bits binary"
_SENT = pa.schema([("dest", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_ANSWER = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("src", pa.int64()), ("bits", pa.binary())])


def _sent(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_SENT.names, r, strict=True)) for r in rows], _SENT)


def _answers(kind: int, sent: pa.Table, bits: list[bytes]) -> pa.Table:
    src = sent.column("dest")
    return pa.table([sent.column("part").combine_chunks(), pa.array([kind] * len(bits), pa.int32()), src.combine_chunks(), pa.array(bits, pa.binary())], schema=_ANSWER)


def _told(answers: pa.Table, kind: int, dtype: str) -> np.ndarray:
    """A part's answers of one kind, in the order of what it sent."""
    rows = sorted((s, b) for k, s, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "src", "bits")), strict=True) if k == kind)
    return np.frombuffer(b"".join(b for _, b in rows), dtype)


def _send_keys(n: int):
    """Pass 1: distinct anchor keys."""

    def run(rows: pa.Table) -> pa.Table:
        p = _Part(rows, n)
        key, twice = p.keys()
        return _sent([(int(key[a] >> np.uint64(32)), p.me, key[a:b].astype("<u4").tobytes(), np.packbits(twice[a:b]).tobytes()) for a, b in _cuts(key >> np.uint64(32))])

    return run


def _answer_keys(sent: pa.Table) -> pa.Table:
    """For each key 0 if no two documents have it, 2 if it is hot, else 1."""
    runs = [np.frombuffer(a, "<u4") for a in sent.column("a").to_pylist()]
    twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(r)) for b, r in zip(sent.column("b").to_pylist(), runs, strict=True)])
    _, back, count = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
    held = count[back]
    status = np.where(held > HOT, 2, (held > 1) | (twice > 0)).astype(np.uint8)
    edges = np.cumsum([0, *map(len, runs)])
    return _answers(1, sent, [status[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)])


def _owned_runs(kind: int, me: int, dest: np.ndarray, h: np.ndarray, h2: np.ndarray, who: np.ndarray) -> list[tuple]:
    return [(int(dest[a]) * 4 + kind, me, h[a:b].astype("<u8").tobytes() + h2[a:b].astype("<u4").tobytes(), _planes(who[a:b].astype("<i8"))) for a, b in _cuts(dest)]


def _send_contexts(n: int):
    """Pass 2: distinct contexts' hashes and smallest ids."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sent([])
        p = _Part(rows, n)
        return _sent(_owned_runs(2, p.me, *p.contexts(_told(answers, 1, "u1"))[:4]))

    return run


def _answer_owned(sent: pa.Table) -> pa.Table:
    """For each context or window whether this part has its smallest id."""
    sizes = [len(a) // 12 for a in sent.column("a").to_pylist()]
    h = np.concatenate([np.frombuffer(a, "<u8", m) for a, m in zip(sent.column("a").to_pylist(), sizes, strict=True)])
    h2 = np.concatenate([np.frombuffer(a, "<u4", m, 8 * m) for a, m in zip(sent.column("a").to_pylist(), sizes, strict=True)])
    who = np.concatenate([_unplaned(b, "<i8") for b in sent.column("b").to_pylist()])
    order = np.lexsort((who, h2, h))
    least = np.empty(len(order), bool)
    least[order] = _heads(h[order], h2[order])
    edges = np.cumsum([0, *sizes])
    return _answers(sent.column("dest")[0].as_py() % 4, sent, [least[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)])


def _send_owned(n: int):
    """Pass 3: contexts whose owner is here, or their windows if their anchor is hot."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sent([])
        p = _Part(rows, n)
        *_, kind = p.contexts(_told(answers, 1, "u1"))
        own = _told(answers, 2, "u1").astype(bool)
        out = []
        cold, dest = p.cold(own, kind)
        at = p.at[p.first[cold]]
        for a, b in _cuts(dest):
            out.append((int(dest[a]) * 4 + 3, p.me, pa.compress(p.cut(at[a:b]).tobytes(), "zstd", asbytes=True), _planes(p.who[p.first[cold[a:b]]].astype("<i8"))))
        hot = np.flatnonzero(own & (kind == 2))
        if len(hot):
            out += _owned_runs(0, p.me, *p.windows(hot)[0])
        return _sent(out)

    return run


def _answer_windows(sent: pa.Table) -> pa.Table:
    """Windows by their smallest id, or for each context which of its windows are covered."""
    if sent.column("dest")[0].as_py() % 4 == 0:
        return _answer_owned(sent)
    owners = [_unplaned(b, "<i8") for b in sent.column("b").to_pylist()]
    raw = b"".join(pa.decompress(a, len(w) * WIDE, "zstd", asbytes=True) for a, w in zip(sent.column("a").to_pylist(), owners, strict=True))
    contexts, who = np.frombuffer(raw, np.uint8).reshape(-1, WIDE), np.concatenate(owners)
    anchor = np.full(len(who), 1, np.uint64)
    for w in np.ascontiguousarray(contexts[:, SIDE : SIDE + K]).view("<u8").T:
        anchor = _mixed((anchor ^ w) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(anchor, kind="stable")
    several = np.zeros(len(order), bool)
    several[1:] = anchor[order][1:] == anchor[order][:-1]
    several[:-1] |= several[1:]
    order = order[several]
    masks = np.zeros(len(who), np.uint32)
    if len(order):
        h = np.where(_whole(contexts[order]), _windows(contexts[order]), np.arange(len(order) * SPAN, dtype=np.uint64).reshape(-1, SPAN))
        _, back, count = np.unique(h.ravel(), return_inverse=True, return_counts=True)
        order = order[(count[back] > 1).reshape(-1, SPAN).any(1)]
        for a, b in _blocks(anchor[order], SORTED_AT_ONCE // WIDE):
            masks[order[a:b]] = repeated_windows(np.ascontiguousarray(contexts[order[a:b]]), who[order[a:b]])
    edges = np.cumsum([0, *map(len, owners)])
    return _answers(3, sent, [masks[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:], strict=False)])


def _blocks(group: np.ndarray, most: int):
    """Runs of whole groups of about ``most`` rows."""
    begin = 0
    for a, b in _cuts(group):
        if b - begin >= most or b == len(group):
            yield begin, b
            begin = b


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cutting(n: int, kept: bool):
    """Pass 4: a part's documents without what smaller ones cover."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * kept
        names = [f.split()[0] for f in RESULT.split(", ")] + ["kept"] * kept
        if not rows.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        p = _Part(rows, n)
        gone = p.covered(answers)
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = np.concatenate([[0], np.cumsum(gone & ~np.append(False, gone[:-1]))])
        removed, spans = (c[p.starts + p.sizes] - c[p.starts] for c in (total, begins))
        rest = []
        for raw, start, size, n_gone in zip(rows.column("raw").to_pylist(), p.starts.tolist(), p.sizes.tolist(), removed.tolist(), strict=True):
            rest.append(p.line[start : start + size][~gone[start : start + size]].tobytes() if n_gone else raw)
        cols = [rows.column("doc_id").combine_chunks(), pa.array(p.sizes), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in rest]), pa.array(rest, pa.binary())]
        return pa.table([c.cast(k) for c, k in zip(cols, kinds, strict=False)], names)

    return run


def deduplicated(docs: DataFrame, kept: bool = False) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])``.

    Null text counts as empty; rows that share an id (null ones too, which rank last) never
    remove from one another and lose each what smaller ids have; texts under 50 bytes lose
    nothing; other columns are ignored; an empty table gives none.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4, -(-size // PART_BYTES))
    doc_id = F.col("doc_id").cast("long")
    dealt = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(2**63 - 1)).alias("id"), raw.alias("raw"), F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int").alias("part"))
    own = dealt.groupBy("part")
    keys = own.applyInArrow(_send_keys(n), SENT).groupBy("dest").applyInArrow(_answer_keys, ANSWER)
    owners = own.cogroup(keys.groupBy("part")).applyInArrow(_send_contexts(n), SENT).groupBy("dest").applyInArrow(_answer_owned, ANSWER)
    told = keys.unionByName(owners)
    covers = own.cogroup(told.groupBy("part")).applyInArrow(_send_owned(n), SENT).groupBy("dest").applyInArrow(_answer_windows, ANSWER)
    return own.cogroup(told.unionByName(covers).groupBy("part")).applyInArrow(_cutting(n, kept), RESULT + (", kept binary" if kept else ""))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What substring dedup removes from every document."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
