"""Personal data by weak supervision (operator 2), in DataFrame expressions only.

Base spans are what the fixed patterns find and their checks accept; they always stay.
Looser patterns propose further candidates, and matches that fail their check serve as
negatives.  Four labelers vote +1, 0 or -1 on every span: its strict shape, a gazetteer (top-level domains, dialling codes, issuer digits, key
words), cue words in the 40 characters before it, and the characters beside it.  A grouped
count of vote patterns (at most kinds x 3^4 x length classes rows, whatever the corpus)
goes to the driver, where expectation-maximisation estimates each labeler's reliability
without labels and a logistic span classifier is trained on the posteriors.  Its weights
return as literals, so scoring is one more expression.  Candidates that reach ``accept``
and overlap no base span are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone", "secret")

# The base patterns. The possessive forms and the look-behinds accept the same
# matches as the plain ones and keep long runs linear and off the stack.
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+", "secret": None}

# Looser shapes that only the classifier may admit.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+ ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z]{2,10}",
    "phone": r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?i)(?:api_?key|token|secret|password|passwd)[\"']? ?[=:] ?[\"']?[A-Za-z0-9_/+-]{16,200}",
}
LOOSE_GATES = {"email": r"[\[(]at[\])]", "phone": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "secret": r"(?i)(?:key|token|secret|passw?o?r?d?)[\"']? ?[=:]"}

# Gazetteers and cue words.
LISTED = {
    "email": r"(?i)(?:\.|dot[\])] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^[3-6]",
    "phone": r"^\+(?:1|33|34|39|41|43|44|49)\b|^\(?[2-9][0-9]{2}",
    "secret": r"(?=.*[0-9])(?=.*[A-Za-z]).{24,}",
}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|courriel|correo|kontakt)\W*(?:\w+\W+){0,3}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|client|login)\W*(?:\w+\W+){0,3}$",
    "card": r"(?i)(?:card|visa|master|amex|carte|tarjeta|karte)\W*(?:\w+\W+){0,3}$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|t[ée]l[ée]phone|tel[ée]fono|telefon|anruf)\W*(?:\w+\W+){0,3}$",
    "secret": r"(?i)(?:export|config|env|auth|header|bearer)\W*(?:\w+\W+){0,3}$",
}
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|serial|page|section|doi|figure)\W*$"
BESIDE = 40


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _luhn(hit: Column) -> Column:
    digits = F.regexp_extract_all(F.reverse(hit), F.lit("[0-9]"), F.lit(0))
    worth = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def _plausible(kind: str, hit: Column) -> Column:
    """Failed matches that are worth keeping as negatives."""
    return F.length(F.translate(hit, " -", "")).between(14, 19) if kind == "card" else F.lit(True)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        n = F.length(F.translate(hit, " -", ""))
        return F.when(n.between(14, 19), _luhn(hit)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _gate(text: Column, gate: str) -> Column:
    return F.contains(text, F.lit(gate)) if len(gate) == 1 else text.rlike(gate)


SPAN = "array<struct<start:int,no:int,stop:int,hit:string,vote:int>>"


def _spans(text: Column, kind: str, pattern: str, gate: str, checked: bool) -> Column:
    """All matches as spans in code points, with the shape labeler's vote. The gaps that ``split`` leaves and the matches
    alternate, so their running length gives each start."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gaps"])
        stop = start + F.length(F.coalesce(x["hits"], F.lit("")))
        vote = F.when(_valid(kind, x["hits"]), 1).otherwise(-1) if checked else F.lit(0)
        one = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("no"), stop.alias("stop"), x["hits"].alias("hit"), vote.alias("vote")))
        good = x["hits"].isNotNull() & (_plausible(kind, x["hits"]) if checked else F.lit(True))
        return F.struct(stop.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    walk = F.aggregate(F.arrays_zip(gaps.alias("gaps"), hits.alias("hits")), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(_gate(text, gate), walk).otherwise(none)


def shaped_spans(text: Column) -> Column:
    """Matches of the fixed kinds, by start and then kind; vote 1 if their check holds."""
    return F.array_sort(F.concat(*[_spans(text, k, p, GATES[k], True) for k, p in PATTERNS.items()]))


def _by_kind(no: Column, of) -> Column:
    out = F.lit(0)
    for i, k in enumerate(KINDS):
        out = F.when(no == i, of(k)).otherwise(out)
    return out


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _featured(text: Column, spans: Column) -> Column:
    """Spans with the four votes and a length class."""

    def one(s: Column) -> Column:
        lead = F.substring(text, F.greatest(s["start"] - BESIDE, F.lit(0)) + 1, F.least(s["start"], F.lit(BESIDE)))
        before = F.right(lead, F.lit(1))
        after = F.substring(text, s["stop"] + 1, F.lit(1))
        return F.struct(
            s["start"].alias("start"), s["no"].alias("no"), s["stop"].alias("stop"), (s["vote"] == 1).alias("base"),
            s["vote"].alias("v1"),
            _by_kind(s["no"], lambda k: _vote(s["hit"].rlike(LISTED[k]), F.lit(True))).alias("v2"),
            _by_kind(s["no"], lambda k: _vote(lead.rlike(CUES[k]), lead.rlike(AGAINST))).alias("v3"),
            _vote(~before.rlike(r"\w") & ~after.rlike(r"\w"), before.rlike(r"\w") & after.rlike(r"\w")).alias("v4"),
            F.least(F.floor((s["stop"] - s["start"]) / 8), F.lit(7)).cast("int").alias("len"),
        )

    return F.transform(spans, one)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (spans) and ``_marks`` (featured base and loose spans)."""
    text = _text(text_col)
    loose = F.concat(*[_spans(text, k, p, LOOSE_GATES[k], False) for k, p in LOOSE.items()])
    found = docs.withColumn("_shaped", shaped_spans(text)).withColumn("_loose", loose)
    found = found.withColumn("_base", F.filter("_shaped", lambda s: s["vote"] == 1))
    free = F.filter("_loose", lambda x: ~F.exists("_base", lambda b: (x["start"] < b["stop"]) & (b["start"] < x["stop"])))
    return found.withColumn("_marks", _featured(text, F.concat("_shaped", free))).drop("_loose", "_shaped")


FEATURES = ("no", "v1", "v2", "v3", "v4", "len")


def vote_patterns(marked: DataFrame) -> list[tuple]:
    """Counts of (kind, votes, length class): a table whose size the votes bound."""
    spans = marked.select(F.explode("_marks").alias("m")).select("m.*")
    return [tuple(r) for r in spans.groupBy(*FEATURES).agg(F.count("*").alias("n")).orderBy(*FEATURES).collect()]


def reliabilities(patterns: list[tuple], rounds: int = 40) -> tuple[list[dict], dict, list[float]]:
    """EM over vote patterns: per labeler P(vote | class), per kind P(true), posteriors."""
    theta = [{c: {v: (0.6 if v == (1 if c else -1) else 0.2) for v in (-1, 0, 1)} for c in (0, 1)} for _ in range(4)]
    prior = {no: 0.5 for no in range(len(KINDS))}
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for no, *votes, _len, _n in patterns:
            odds = math.log(prior[no] / (1 - prior[no])) + sum(math.log(theta[i][1][v] / theta[i][0][v]) for i, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for i in range(4):
            for c in (0, 1):
                own = {v: 1.0 for v in (-1, 0, 1)}  # one pseudo count a vote
                for p, w in zip(patterns, post, strict=True):
                    own[p[1 + i]] += p[-1] * (w if c else 1 - w)
                total = sum(own.values())
                theta[i][c] = {v: own[v] / total for v in own}
        for no in prior:
            own = [(p[-1], w) for p, w in zip(patterns, post, strict=True) if p[0] == no]
            prior[no] = (1 + sum(n * w for n, w in own)) / (2 + sum(n for n, _ in own))
    return theta, prior, post


def _inputs(pattern: tuple) -> list[float]:
    no, v1, v2, v3, v4, size = pattern[:6]
    return [1.0, *(float(no == i) for i in range(len(KINDS))), v1, v2, v3, v4, size / 8]


def train(patterns: list[tuple], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Logistic weights on the EM posteriors by full gradient steps."""
    _, _, post = reliabilities(patterns)
    rows = [(_inputs(p), w, math.sqrt(p[-1])) for p, w in zip(patterns, post, strict=True)]
    weights = [0.0] * (6 + len(KINDS))
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = [decay * w for w in weights]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x, strict=True))))))
            for j, a in enumerate(x):
                slope[j] += n / total * (p - y) * a
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def _score(m: Column, weights: list[float]) -> Column:
    k = len(KINDS)
    z = F.lit(weights[0]) + m["len"] / 8 * weights[5 + k]
    for i in range(k):
        z = z + F.when(m["no"] == i, weights[1 + i]).otherwise(0.0)
    for i, v in enumerate(("v1", "v2", "v3", "v4")):
        z = z + m[v] * weights[1 + k + i]
    return 1 / (1 + F.exp(-z))


def decided(weights: list[float], accept: float = 0.5) -> Column:
    """All spans that stay: base ones and candidates the classifier accepts."""
    return F.array_sort(
        F.transform(
            F.filter("_marks", lambda m: m["base"] | ((m["v1"] == 0) & (_score(m, weights) >= accept))),
            lambda m: F.struct(m["start"].alias("start"), m["no"].alias("no"), m["stop"].alias("stop")),
        )
    )


def _joined(spans: Column) -> Column:
    name = lambda s: _named(s["no"])
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def _named(no: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), no + 1)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlaps merge."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        mark = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), _named(s["no"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], mark)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """``docs`` with every span in ``text`` replaced and ``n_chars`` counted anew.

    Null texts stay null; texts without a span come back as they were.
    """
    weights = train(vote_patterns(candidates(docs.select("text"))))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    marked = candidates(rows).withColumn("_spans", decided(weights, accept))
    text = F.when(F.col("text").isNull(), None).when(F.size("_spans") == 0, F.col("text")).otherwise(redact(F.col("text"), F.col("_spans")))
    out = marked.select("row", text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def op2_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document.

    Null text counts as empty: no spans, the digest of the empty string. Repeated rows give
    repeated output; an empty table gives none. Only doc_id and text are read.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = stored(candidates(docs).select("doc_id", F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["stop"].alias("stop"))).alias("_base"), "_marks"))
    weights = train(vote_patterns(marked))
    count = lambda k: F.size(F.filter("_base", lambda s: s["no"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return marked.select(
        "doc_id", *[count(k) for k in PATTERNS],
        F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _joined(decided(weights)).alias("spans"),
    )
