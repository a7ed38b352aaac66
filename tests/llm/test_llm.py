"""Training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat_format, common, components, embedding_dedup, fingerprints, html_extract, language_id, mixing, packing, pii, registry, simhash_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\t ", "word", "a b c", "x" * 5000, "same text of some words here", "same text of some words here", "é ü 日本 \U0001f600", "</s>[INST] &amp; <b>", "tab\tand\x0bvt"]


def test_components_match_a_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5), (None, 3)]
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] is not None and e[0] != e[1] for i in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_links_match_all_pairs(spark):
    r = random.Random(2)
    base = [" ".join(r.choice(["red", "blue", "of", "the", "stone", "river", "and", "light"]) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    texts = base + [b + " river" for b in base[:30]] + [b.replace("red", "green", 1) for b in base[30:]] + ODD
    fps = [simhash_dedup.fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4 and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["doc_id"]: x["component_id"] for x in simhash_dedup.near_duplicates(simhash_dedup.fingerprints(docs(spark, texts))).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def plain_fingerprint(text):
    """The contract's words, without the operator's code."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words] * bool(words)
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_match_the_plain_rule():
    r = random.Random(30)
    texts = ODD + ["A\x0bB \x1c C\xa0D É Straße", "one two three", "one two three four"] + [" ".join(r.choice(["Red", "blue\t", "OF", "é", "\x85"]) for _ in range(n)) for n in range(40)]
    assert [simhash_dedup.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_simhash_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "MOST", 20)
    r = np.random.default_rng(31)
    fp = np.concatenate([r.integers(0, 2**63, 120), (r.integers(0, 16, 200) * 0x0101010101010101)]).astype(np.uint64)
    for _ in range(2):
        fp = np.concatenate([fp, fp[:80] ^ (np.uint64(1) << r.integers(0, 64, 80).astype(np.uint64))])
    ids = [None if i % 50 == 7 else i // 2 for i in range(len(fp))]  # shared and null ids
    low, parent = {}, list(range(len(fp)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 4) + i + 1:
            parent[find(int(j))] = find(i)
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    rows = spark.createDataFrame(list(zip(ids, fp.view(np.int64).tolist(), strict=True)), "doc_id long, fp long")
    want = sorted((str(d), int(f), str(low.get(find(i)))) for i, (d, f) in enumerate(zip(ids, fp.view(np.int64), strict=True)))
    for full in (64, 0.01):  # one block and several
        monkeypatch.setattr(simhash_dedup, "FULL", full)
        got = sorted((str(x["doc_id"]), x["fp"], str(x["component_id"])) for x in simhash_dedup.near_duplicates(rows).collect())
        assert got == want


def test_vantage_tree_finds_every_component():
    r = np.random.default_rng(3)
    fp = r.integers(0, 2**63, 1500, dtype=np.uint64)
    near = fp[:700] ^ (np.uint64(1) << r.integers(0, 60, 700).astype(np.uint64))
    own = np.unique(np.concatenate([fp, near]))
    parent = list(range(len(own)))

    def find(p, i):
        while p[i] != i:
            i = p[i]
        return i

    want = list(range(len(own)))
    for i in range(len(own)):
        for j in np.flatnonzero(np.bitwise_count(own[i + 1 :] ^ own[i]) <= 4) + i + 1:
            want[max(find(want, i), find(want, int(j)))] = min(find(want, i), find(want, int(j)))
    for a, b in simhash_dedup.vantage_links(own, 4):
        assert (int(own[a]) ^ int(own[b])).bit_count() <= 4
        parent[max(find(parent, a), find(parent, b))] = min(find(parent, a), find(parent, b))
    assert [find(parent, i) for i in range(len(own))] == [find(want, i) for i in range(len(own))]


def test_near_duplicate_stage_finds_planted_edits(spark):
    import corpus_pipeline

    r = random.Random(20)
    texts = []
    for _ in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(150, 400))]
        texts.append(" ".join(words))
        for least in (0.8, 0.85, 0.9, 0.95):
            own, new = set(zip(*(words[i:] for i in range(5)), strict=False)), list(words)
            while True:
                tried = list(new)
                tried[r.randrange(len(new))] = f"e{r.randrange(10**9)}"
                other = set(zip(*(tried[i:] for i in range(5)), strict=False))
                if len(own & other) < least * len(own | other):
                    break
                new = tried
            texts.append(" ".join(new))
        half = words[: len(words) // 2] + [f"v{r.randrange(5000)}" for _ in range(len(words) // 2)]
        texts.append(" ".join(half))
    got = sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs(spark, texts), SF).collect())
    assert got == [i for i in range(len(texts)) if i % 6 in (0, 5)]


def test_near_duplicate_stage_keeps_rows_with_null_and_shared_ids(spark):
    import corpus_pipeline

    texts = [(None, "one two three four five six"), (None, "a b c d e f g"), (1, "h i j k l m n"), (1, "o p q r s t u"), (2, "one two three four five six")]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], DOCS)
    got = sorted(map(str, ((x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, rows, SF).collect())))
    assert got == sorted(map(str, texts[1:]))


def test_alike_links_match_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "WIDE_LEAF", 8)
    r = np.random.default_rng(21)
    base = [np.unique(r.integers(0, 2**40, 60).astype(np.uint64)) for _ in range(40)]
    sets = base + [np.unique(np.concatenate([b[k:], r.integers(0, 2**40, k).astype(np.uint64)])) for b in base for k in (2, 5, 7, 9, 20)]

    def roots(pairs):
        parent = list(range(len(sets)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(sets))]

    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    assert roots(simhash_dedup.alike_links(sets)) == roots((i, j) for i, j in itertools.combinations(range(len(sets)), 2) if alike(sets[i], sets[j]))


def test_near_duplicate_stage_links_what_the_fingerprint_trees_find(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in range(500)), None]
    tagged = simhash_dedup._tagged(docs(spark, texts).withColumn("_row", F.col("doc_id")))
    alone = tagged.select("class", "_row", "fp", F.array("class").alias("keys"))  # no table brings two together
    pairs = simhash_dedup._alike_pairs(docs(spark, texts).select(F.col("doc_id").alias("_row"), "text"), alone)
    at = {r["class"]: r["_row"] for r in tagged.collect()}
    assert [sorted((at[a], at[b])) for a, b in pairs.collect()] == [[0, 1]]


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def holds(kind, hit):
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        d = re.sub("[ -]", "", hit)
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return 10 <= len(re.sub("[^0-9]", "", hit)) <= 15 if kind == "phone" else True


def test_pii_base_spans_match_the_plain_patterns(spark, tmp_path):
    r = random.Random(4)
    bits = ["a.b@c.d", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "001.02.3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-1234", "+44", "é", "\U0001f600", " ", "\n", "x@y", "...", "@", "9" * 40, "+1 2 3 4 5 6 7 8 9 0 (", "token = \"0123456789abcdef0123456789abcdef01234567\""]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", ","]) for _ in range(r.randrange(12))) for _ in range(250)] + ODD + ["1" * 30000, "a" * 30000, "1 " * 20000]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in pii.op2_pii_weak_supervision(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, t or "") if holds(kind, m[0]))
        text = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t[:200]
        assert [got[i][f"n_{kind}"] for kind, _ in BASE] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))


def test_pii_classifier_admits_and_refuses_candidates(spark):
    good = [f"You can write an email to john{i} [at] example [dot] com today." for i in range(30)] + [f"Please call phone 415-555-{1000 + i} now." for i in range(30)]
    good += [f"real mail ann{i}@example.org and call +1 415 555 {2000 + i}" for i in range(40)]
    bad = [f"order 015-555-{3000 + i}x" for i in range(30)] + [f"version 1.2.3.{400 + i} of serial 4111 1111 1111 11{i}" for i in range(10, 40)]
    table = docs(spark, good + bad)
    marked = pii.candidates(table)
    weights = pii.train(pii.vote_patterns(marked))
    kinds = {x["doc_id"]: {pii.KINDS[s["no"]] for s in x["spans"]} for x in marked.select("doc_id", pii.decided(weights).alias("spans")).collect()}
    assert all("email" in kinds[i] for i in range(30)) and all("phone" in kinds[i] for i in range(30, 60))
    assert all(not kinds[i] for i in range(len(good), len(good) + 30))
    theta, prior, post = pii.reliabilities(pii.vote_patterns(marked))
    assert all(theta[i][1][1] > theta[i][0][1] for i in (0, 1)) and all(0 <= p <= 1 for p in post)


def test_pii_redaction_leaves_clean_texts(spark):
    texts = ["mail a@b.com now", "clean words", None, "", "\U0001f600 1.2.3.4 and +1 (415) 555-1234."]
    extra = docs(spark, texts).withColumn("start", F.lit(1)).withColumn("_base", F.lit("x"))
    out = {r["doc_id"]: r for r in pii.redacted(extra).collect()}
    assert out[0]["text"] == "mail <email> now" and out[1]["text"] == "clean words" and out[2]["text"] is None and out[3]["text"] == ""
    assert out[4]["text"] == "\U0001f600 <ip> and <phone>." and out[4]["n_chars"] == len(out[4]["text"]) and out[0]["_base"] == "x"


def test_mixing_meets_targets(spark):
    r = random.Random(5)
    texts = [" ".join(["w"] * r.randrange(0, 90)) for _ in range(800)]
    sources = [r.choice(["a"] * 8 + ["b", "c", "tiny" if i % 50 == 0 else "c", None]) for i in range(800)]
    out = [x.asDict() for x in mixing.mixed(mixing.sized(docs(spark, texts, sources))).collect()]
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(t.split())
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in names if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    goal = {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in names}
    taken = {}
    for x in out:
        assert x["taken"] <= 3 * x["size"] and x["target"] == pytest.approx(goal[x["source"]])
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(abs(taken[s] - goal[s]) <= mixing.BLOCK for s in names)
    again = {x["doc_id"]: x["taken"] for x in mixing.mixed(mixing.sized(docs(spark, texts, sources).orderBy(F.desc("doc_id")))).collect()}
    assert again == {x["doc_id"]: x["taken"] for x in out}
    mixed = mixing.mixture(docs(spark, texts, sources))
    assert mixed.agg(F.sum(mixing.words(F.col("text")))).first()[0] == sum(taken.values())


def test_apportionment_is_by_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.5, "e": 0.0}
    for seats in (0, 1, 7, 10, 101):
        won = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = min(won, key=lambda p: (-votes[p] / (2 * won[p] + 1), p))
            won[best] += 1
        rows = spark.createDataFrame([(0, p, v, seats) for p, v in votes.items()], "g int, p string, v double, s long")
        assert {x["p"]: x["quota"] for x in mixing.apportioned(rows, "g", "v", "s", "p").collect()} == won


def named_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_leaves_little_padding(spark):
    rows = registry.QUERIES["op3_pack_nnls"](spark, "/root/testdata/sf0.01").agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("k")).first()
    assert rows["n"] >= 0.99 * 1024 * rows["k"]


def test_packing_round_trip(spark):
    r = random.Random(6)
    texts = ODD + [" ".join(r.choice(["alpha", "beta", "gamma's", "x1", "--", "\n", " "]) for _ in range(r.randrange(0, 2500))) for _ in range(60)] + ["<|endoftext|> as text"]
    rows = packing.packed(common.stored(packing.pieces(docs(spark, texts), ids=True).drop("ids"))).collect()
    tok = named_tokenizer()
    assert tok.encode("<|endoftext|> as text", add_special_tokens=False).ids[0] == 50256
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((x for x in rows if x["doc_id"] == i), key=lambda x: x["start"])
        assert [x["start"] for x in own] == [0, *np.cumsum([x["length"] for x in own])[:-1]] and sum(x["length"] for x in own) == len(ids)
        assert all(zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"] and x["doc_tokens"] == len(ids) for x in own)
    by = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_plan_uses_the_histogram_exactly():
    r = random.Random(7)
    hist = {k: r.randrange(0, 40) for k in range(1, 1024)} | {1024: 50}
    used = {}
    for lengths, n in packing.plan(hist):
        assert sum(lengths) <= 1024
        for k in lengths:
            used[k] = used.get(k, 0) + n
    assert used == {k: v for k, v in hist.items() if v}
    assert packing.plan({}) == []


def test_encoder_equals_the_plain_tokenizer():
    enc, r = packing.encoder("byte_bpe_50k.json"), random.Random(8)
    texts = ["".join(r.choice([" ", "\n", "\t", "a", "bc", "'s", "9", ".", "é", "\xa0", "\0", "the", "<|endoftext|>", "<|endof"]) for _ in range(r.randrange(14))) for _ in range(1500)]
    tok = named_tokenizer()
    for _ in range(2):
        for t, got in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
        enc.held = packing.CACHED + 1  # the memo begins anew


def substring_oracle(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        own = set()
        for k in range(len(b) - 49):
            own.add(b[k : k + 50])
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= own
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 64])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 6000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(9)
    words = ["the", "of", "and", "stone", "é", "日本", "ab", "\n"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [line(30) for _ in range(6)] + ["x" * 200, "abc" * 60]
    texts = [line(r.randrange(30)) + r.choice(shared)[r.randrange(20) :] + line(r.randrange(30)) + r.choice(shared) for _ in range(90)]
    texts += ODD + [texts[0], texts[0][:-1], "x" * 49, "x" * 51]
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.deduplicated(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == substring_oracle(texts)


def test_substring_dedup_leaves_equal_texts_under_the_depth(spark, monkeypatch):
    r = random.Random(23)
    own = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in range(24, 61) for _ in range(4)]
    for size in (300, 1 << 20):  # copies in several parts and in one
        monkeypatch.setattr(suffix_dedup, "PART_BYTES", size)
        got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.deduplicated(docs(spark, own + own)).collect()}
        assert [got[i] for i in range(2 * len(own))] == substring_oracle(own + own)


def test_substring_dedup_of_null_and_shared_ids(spark):
    a, b = "one sentence that is long enough to hold many strings of fifty bytes", "0123456789" * 12
    rows = [(None, a, 1), (None, b, 2), (7, a + "!", 3), (7, a, 4), (-5, "~" + b, 5), (None, None, 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["kept"]) for x in suffix_dedup.deduplicated(table, kept=True).collect()), key=str)
    want = [(None, len(a), len(a), b""), (None, len(b), len(b), b""), (7, len(a) + 1, 0, (a + "!").encode()), (7, len(a), 0, a.encode()), (-5, len(b) + 1, 0, b"~" + b.encode()), (None, 0, 0, b"")]
    assert got == sorted(want, key=str)


def test_substring_dedup_of_documents(spark):
    rows = common.table(spark, SF, "documents")
    texts = {x["doc_id"]: x["text"] for x in rows.collect()}
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.deduplicated(rows).collect()}
    assert [got[i] for i in sorted(texts)] == substring_oracle([texts[i] for i in sorted(texts)])


def test_suffix_order_merges_by_joined_ranks():
    r = np.random.default_rng(11)
    for high in (5, 1 << 20, 1 << 40):  # pairs of the last don't fit an integer as they are
        values = np.unique(r.integers(0, high, 40))
        a, b = r.choice(values, 300), r.choice(values, 300)
        key = suffix_dedup._joined(a, b).tolist()
        want = {p: i for i, p in enumerate(sorted(set(zip(a.tolist(), b.tolist(), strict=True))))}
        assert [sorted(set(key)).index(k) for k in key] == [want[p] for p in zip(a.tolist(), b.tolist(), strict=True)]
        s = r.choice(values + 1, 200)
        order = suffix_dedup.suffix_order(s, 8)
        keys = [s[i : i + 8].tolist() for i in order]
        assert keys == sorted(keys)


def test_substring_anchors_do_not_depend_on_the_slice(monkeypatch):
    r = np.random.default_rng(12)
    line = r.choice(np.frombuffer(b"abc \xff", np.uint8), 9000, p=[0.3, 0.3, 0.2, 0.19, 0.01])
    want = suffix_dedup.anchors(line)
    assert len(want[0])
    for size in (64, 1000, 9000):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        assert all(np.array_equal(x, y) for x, y in zip(suffix_dedup.anchors(line), want, strict=True))


def test_suffix_order_is_by_prefix():
    r = np.random.default_rng(10)
    for high in (2, 3, 30):
        for n in (0, 1, 2, 3, 4, 5, 50, 301):
            s = r.integers(1, high + 1, n)
            order = suffix_dedup.suffix_order(s.astype(np.int64), 8)
            assert sorted(order.tolist()) == list(range(n))
            keys = [s[i : i + 8].tolist() for i in order]
            assert keys == sorted(keys)


def test_chat_round_trip(spark):
    texts = [t for t in ODD] + ["&lt; &amp; [x] </s>", "<s>[user]"]
    rows = [(c, "r" if n % 2 == 0 else "assistant", n, texts[(c * 3 + n) % len(texts)]) for c in range(8) for n in range(c + 1)]
    df = spark.createDataFrame(rows, "conv_id long, role string, turn long, text string")
    out = chat_format.formatted(chat_format.conversations_as_trees(df))
    back = {x["tree"]: [(t["role"], t["text"]) for t in x["t"]] for x in out.select("tree", chat_format.read_back(F.col("formatted")).alias("t")).collect()}
    assert back == {c: [(r, t or "") for cc, r, n, t in rows if cc == c] for c in range(8)}


def test_chat_keeps_rows_without_conversation_or_turn(spark, tmp_path):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "there"), (3, None, "user", "first"), (3, 0, "assistant", "then"), (3, 0, "assistant", None), (4, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(chat_format.ORACLE)
    columns = [c[0] for c in want.description]
    got = chat_format.op6_chat_reply_trees(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())) and len(got) == 4


def test_reply_trees_enumerate_and_rank(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 3, 0.0), (2, 1, None, None), (3, 2, 99, 1.0), (4, 1, 2, 1.0), (4, 2, 1, 1.0)] + [(5, i, i - 1 if i else None, 1.0) for i in range(70)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {(x["tree"], tuple(x["path"])): x["score"] for x in chat_format.paths(nodes).collect()}
    assert got == {(1, (1, 2)): 5.0, (1, (1, 3, 4)): 10.0, (1, (1, 3, 5)): 1.0, (2, (1,)): 0.0, (5, tuple(range(70))): 70.0}
    assert [tuple(x["path"]) for x in chat_format.chosen(chat_format.paths(nodes), 2).where("tree = 1").orderBy("rank").collect()] == [(1, 3, 4), (1, 2)]


def test_language_on_held_out_documents(spark):
    rows = common.table(spark, SF, "documents")
    truth = {x["doc_id"]: x["lang"] for x in rows.collect()}
    hidden = rows.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    got = {x["doc_id"]: x for x in language_id.identified(hidden).collect()}
    held = [i for i in truth if i % 4 == 0]
    assert sum(got[i]["language"] == truth[i] for i in held) >= 0.95 * len(held)
    odd = rows.limit(0).unionByName(docs(spark, ODD))
    assert {x["doc_id"]: x["accepted"] for x in language_id.identified(rows.unionByName(odd.withColumn("doc_id", F.col("doc_id") - 100))).collect()}[-100] is False
    assert language_id.screened(rows.limit(0)).count() == 0


def test_language_posterior_matches_brute_force(spark):
    r = random.Random(32)
    langs = ["de", "en", "fr"]
    rows = []
    for i in range(120):
        own = r.randrange(3)
        ll = [r.gauss(2.0 if k == own else 0.0, 1.5) for k in range(3)]
        rows.append((i, r.choice([langs[own]] * 6 + ["xx", None, ""]), r.choice(["a.org", "b.org", "c.de", "plain", None]), ll, 0 if i % 17 == 0 else 40))
    scored = spark.createDataFrame(rows, "doc_id long, declared string, host string, ll array<double>, letters long")
    best = {i: max(range(3), key=lambda k: ll[k]) if n else None for i, _, _, ll, n in rows}
    tail = lambda h: h.rsplit(".", 1)[-1] if h and "." in h else ""
    told = lambda d: d if d in langs else None

    def shrunk(own, above, weight):
        return [(own.count(k) + weight * above[k]) / (len(own) + weight) for k in range(3)]

    seen = [b for b in best.values() if b is not None]
    corpus = [(seen.count(k) + 1) / (len(seen) + 3) for k in range(3)]
    suffix = {t: shrunk([best[i] for i, _, h, _, _ in rows if tail(h) == t and best[i] is not None], corpus, 20.0) for t in {tail(x[2]) for x in rows}}
    host = {h: shrunk([best[i] for i, _, g, _, _ in rows if (g or "") == h and best[i] is not None], suffix[tail(h)], 20.0) for h in {x[2] or "" for x in rows}}
    pairs = [(told(d), best[i]) for i, d, *_ in rows if best[i] is not None]
    names = [*langs, None]
    got = {x["doc_id"]: x for x in language_id.fused(scored, langs).collect()}
    for i, d, h, ll, n in rows:
        said = [(pairs.count((told(d), k)) + 1) / (sum(pairs.count((e, k)) for e in names) + len(names)) if d is not None else 1.0 for k in range(3)]
        raw = [math.exp(ll[k]) * said[k] * host[h or ""][k] for k in range(3)]
        top = max(raw) / sum(raw)
        assert got[i]["language"] == langs[raw.index(max(raw))] and got[i]["posterior"] == pytest.approx(top), (i, d, h)
        assert got[i]["accepted"] == (n > 0 and top >= 0.5)


def test_language_of_small_share_is_named(spark):
    rows = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    rows = rows.unionByName(rows.withColumn("doc_id", F.col("doc_id") + 100_000))
    r = random.Random(22)
    script = lambda low: " ".join("".join(chr(low + r.randrange(20)) for _ in range(r.randrange(2, 9))) for _ in range(120))
    rare = [(-i, script(0x3B1), "el", "s", 1) for i in range(1, 7)] + [(-i, script(0x561), "hy", "s", 1) for i in range(11, 13)]
    both = rows.unionByName(spark.createDataFrame(rare, DOCS))
    want = {i: "el" if i > -10 else "und" for i, *_ in rare}
    assert {x["doc_id"]: x["language"] for x in language_id.identified(both).where("doc_id < 0").collect()} == want
    assert {x["doc_id"]: x["lang"] for x in language_id.screened(both).where("doc_id < 0").collect()} == want


def test_fingerprints_of_equal_and_edited_texts(spark, tmp_path):
    texts = ODD + [" ".join(f"w{i * j % 37}" for j in range(80)) for i in range(1, 40)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(fingerprints.op9_simhash_tables(spark, str(tmp_path)).collect(), key=lambda x: x["doc_id"])
    fps = [int(x["fingerprint"], 16) for x in got]
    for i, x in enumerate(got):
        t, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert x["near_next"] == 1 - (fps[i] ^ fps[(i + 1) % len(fps)]).bit_count() / 64
        if x["doc_id"] % 50 == 0:
            assert x["n_near"] == sum((f ^ fps[i]).bit_count() <= 3 for f in fps)
    assert fps[7] == fps[8] and fps[0] == 0
    for i, x in enumerate(got):
        t, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert fps[i] == pair_votes(t) and int(x["edited_fingerprint"], 16) == pair_votes(edited)
        assert x["near_edited"] == 1 - (pair_votes(t) ^ pair_votes(edited)).bit_count() / 64


def pair_votes(text):
    """Votes of word pairs, each pair's hash being that of its second word seeded by its first's."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    one = lambda w, seed: xxhash.xxh64_intdigest(w.encode(), seed=seed)
    hashes = [one(b, one(a, 42)) for a, b in zip(words, words[1:], strict=False)] if len(words) > 1 else [one(w, 42) for w in words]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_following_rows_of_wide_skewed_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_A_BUCKET", 5)
    r = random.Random(33)
    ids = [-(2**63) + 5, 2**63 - 1, 2**62, None, None, -7] + [r.randrange(40) for _ in range(60)] + [9] * 80 + [2**40 + i for i in range(30)]
    rows = [(d, f"t{i % 90}") for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "k long, v string").withColumn("tie", F.xxhash64("v"))
    tie = {x["v"]: x["tie"] for x in df.collect()}
    order = sorted(rows, key=lambda x: (-(2**63) if x[0] is None else x[0], tie[x[1]]))
    want = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((str(x["k"]), x["v"], x["next_v"]) for x in fingerprints.following(df, "k", "v", "tie").collect()) == want


def test_embedding_links_match_brute_force(spark):
    r = np.random.default_rng(11)
    x = r.standard_normal((300, 16))
    near = np.concatenate([x, x[:100] + 0.12 * r.standard_normal((100, 16)), np.repeat(x[:1], 40, 0) + 0.05 * r.standard_normal((40, 16)), x[5:8], 3 * x[9:10]])
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(near)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 5), (904, [None] + [1.0] * 15), (905, [])]
    got = {v["vec_id"]: v for v in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = near / np.linalg.norm(near, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    assert len(got) == len(rows) and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))
    each = [got[i]["n_links"] / n for i, n in enumerate(s.sum(1)) if n]
    assert got[0]["audited_recall"] >= 0.98 and np.mean(each) >= 0.98
    found, true = sum(got[i]["n_links"] for i in range(len(near))), int(s.sum())
    assert found >= 0.98 * true and all(got[i]["n_links"] <= s[i].sum() for i in range(len(near)))


def linked_by_force(x, ids):
    """(id, links, component id) of each vector, by union-find over all pairs."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(near), strict=True):
        parent[find(int(i))] = find(int(j))
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((str(d), int(near[i].sum()) - 1, str(low.get(find(i)))) for i, d in enumerate(ids))


def test_embedding_copies_shared_ids_and_the_exact_way(spark):
    r = np.random.default_rng(34)
    x = np.repeat(r.standard_normal((20, 8)), 2, 0)
    x = np.concatenate([x, x[:10] + 0.05 * r.standard_normal((10, 8))])
    ids = [None if i in (3, 4) else i // 3 for i in range(len(x))]
    table = spark.createDataFrame([(d, [float(v) for v in e]) for d, e in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    for most in (None, 0):  # by descent, and block against block
        got = embedding_dedup.near_duplicates(table, most=most).collect()
        assert {v["audited_recall"] for v in got} == {1.0}
        assert sorted((str(v["vec_id"]), v["n_links"], str(v["component_id"])) for v in got) == linked_by_force(x, ids)
        assert all(v["kept"] == (v["vec_id"] == v["component_id"]) for v in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav>
<article><header><p>By me</p><h1>Title &amp; more</h1></header><p>One <b>two</b>
three<p>Four&nbsp;five<br>six</p><form><p>Mail</p></form><div class="share-box">Share</div><section id=comments><p>Nice</p></section></article><footer>&copy;</footer>"""


def test_html_blocks():
    found = html_extract.blocks(PAGE)
    top = max(z for z, _, _ in found)
    assert [t for z, t, _ in found if z == top] == ["Title & more", "One two three", "Four five six"]
    assert html_extract.blocks(None) == [] and html_extract.blocks("<p") == []


def test_html_containers_quotes_and_unclosed_values():
    texts = lambda page: [t for z, t, _ in html_extract.blocks(page) if z > html_extract.OPEN]
    assert texts('<main class="has-sidebar"><p>Real story</main>') == ["Real story"]
    assert texts('<div class="has-sidebar"><main><p>Real</p></main><div class=sidebar>Side</div></div>') == ["Real"]
    assert texts('<article class="post search-result"><p>Real</article>') == ["Real"]
    assert texts("<article><p title=it's>One</p><p>Two it's here</p><p>Three</p></article>") == ["One", "Two it's here", "Three"]
    assert texts('<article><p title="x>One</p><p>Two</p></article>') == ["One", "Two"]
    assert texts('<article><p title="a>b" data-class="menu">One</p><article class="comment">Nice</article></article>') == ["One"]
    deep = 4000
    assert texts("<article>" + "<div>" * deep + "Deep" + "</section>" * deep) == ["Deep"]


def test_html_text_beside_an_article_stays_unless_it_repeats(spark):
    page = lambda i: f"<main><p>Intro {i}</p><p>Our house rules</p><article><p>Story {i}</p><p>Our house rules</p></article><p>Outro {i}</p><p><a href=/>More</a></p></main>"
    rows = [(i, f"http://m.example/{i}", page(i)) for i in range(3)] + [(None, "http://m.example/n", page(9))]
    got = {x["page_id"]: x for x in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Intro 1\nStory 1\nOur house rules\nOutro 1" and got[None]["text"].startswith("Intro 9\nStory 9")


def test_html_repeated_runs_go_on_pages_without_a_container(spark):
    menu = "<div>all the many sections of our great site listed here for you</div>"
    pages = [(i, f"http://h.example/{i}", f"<body>{menu}<p>unique story number {i} with words of its own {i * 7}</p></body>") for i in range(5)]
    pages += [(9, None, None), (10, "http://x", ""), (11, "http://h.example/11", PAGE)]
    got = {x["page_id"]: x for x in html_extract.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[2]["text"] == "unique story number 2 with words of its own 14" and got[2]["n_repeated"] == 1
    assert got[9]["text"] == "" and got[10]["n_chars"] == 0 and got[11]["text"].startswith("Title & more\n")


def test_html_short_menus_two_page_hosts_and_run_ends_go(spark):
    head, tail = "<ul><li>Home<li>World news<li>Sport</ul>", "<p>a long notice that closes every page of this host with many words<p>Call us<p>Imprint"
    pages = [(i, f"http://{h}/{i}", f"<body>{head}<p>Please note<p>story {i} that is told on this page alone{tail}</body>") for i, h in enumerate(["two.example"] * 2 + ["more.example"] * 4 + ["one.example"])]
    pages += [(6, *pages[6][1:])]
    got = {x["page_id"]: x for x in html_extract.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i]["text"] == f"story {i} that is told on this page alone" and got[i]["n_repeated"] == 7 for i in range(6))
    assert got[6]["n_blocks"] == 8 and got[6]["n_repeated"] == 0 and got[6]["text"].startswith("Home\nWorld news\n")


def covered_by_force(pages):
    """Covered blocks by page row: every word under RUN tokens, or a whole block, of another page."""
    streams = [(h, i, html_extract._tokens(t)) for i, h, t in pages]
    n, held = html_extract.RUN, {}
    for h, i, s in streams:
        ends = [k for k, t in enumerate(s) if t == html_extract.MARK]
        for a, z in [(k, k + n) for k in range(len(s) - n + 1)] + [(a, b + 1) for a, b in itertools.pairwise(ends)]:
            held.setdefault((h, tuple(s[a:z])), set()).add(i)
    out = []
    for h, _, s in streams:
        ends = [k for k, t in enumerate(s) if t == html_extract.MARK]
        gone = set()
        for a, z in [(k, k + n) for k in range(len(s) - n + 1)] + [(a, b + 1) for a, b in itertools.pairwise(ends)]:
            if len(held[h, tuple(s[a:z])]) > 1:
                gone |= set(range(a, z))
        out.append([k for k, (a, b) in enumerate(itertools.pairwise(ends)) if gone >= set(range(a + 1, b))])
    return out


@pytest.mark.parametrize("hot", [3, 20_000])
def test_html_suffix_array_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(html_extract, "HOT", hot)
    r = random.Random(31)
    line = lambda n: " ".join(r.choice(["red", "blue", "of", "the", "stone", "river"]) for _ in range(n))
    shared = [line(n) for n in (1, 3, 20, 26, 40, 70, 200)] + ["x " * 300]
    texts = [[x for x in (r.choice(shared), line(2 + i % 5), " ".join(r.choice(shared).split()[r.randrange(4) :]) + " " + line(1 + i % 3), r.choice(shared) + " " + r.choice(shared)) if x.strip()] for i in range(60)]
    pages = [(i // 2, f"h{i % 3}.example", [" ".join(t.split()) for t in own]) for i, own in enumerate(texts)]
    table = spark.createDataFrame([(i, f"http://{h}/{k}", "".join(f"<p>{t}" for t in own)) for k, (i, h, own) in enumerate(pages)], "page_id long, url string, html string")
    want, got = covered_by_force(pages), {x["url"]: x for x in html_extract.extracted(table).collect()}
    assert sum(map(len, want)) > 50
    for k, ((_, h, own), gone) in enumerate(zip(pages, want, strict=True)):
        x = got[f"http://{h}/{k}"]
        assert x["n_repeated"] == len(gone) and x["text"] == "\n".join([t for i, t in enumerate(own) if i not in gone] or own)


def test_html_repeats_across_block_bounds_go(spark):
    notice = " ".join(f"w{k}" for k in range(60))
    split = f"<p>{notice[: notice.index(' w30')]}<p>{notice[notice.index('w30') :]}"
    rows = [(0, "http://b.example/0", f"<p>story zero<p>{notice}"), (1, "http://b.example/1", f"<p>story one{split}")]
    got = {x["page_id"]: x["text"] for x in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "story zero", 1: "story one"}


def test_pages_table(spark):
    got = {x["page_id"]: x["text"] for x in registry.QUERIES["op1_html_suffix_array"](spark, SF).collect()}
    import html

    for row in common.table(spark, SF, "pages").collect():
        body = re.search(r"<article[^>]*>(.*?)(</article>|$)", row["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[row["page_id"]] == "\n".join(p for p in parts if p)


def test_sql_oracles(spark):
    import os

    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    for name, sql in registry.ORACLES.items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        got = registry.QUERIES[name](spark, SF).select(*columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "conversations", "embeddings"):
        common.table(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op6") else 0)


def test_pipeline_stages(spark):
    import corpus_pipeline

    rows = common.table(spark, SF, "documents")
    seen = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = common.stored(stage(spark, seen, SF))
        assert seen.columns == rows.columns, name
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == seen.agg(F.countDistinct("doc_id")).first()[0]
