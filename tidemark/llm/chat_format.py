"""Chat formatting of reply trees (operator 6), in DataFrame expressions only.

A message names its parent; a tree's root-to-leaf paths are its possible conversations.
Messages with an only reply form chains; self-joins by pointer doubling take each message to
its chain's first, in as many rounds as the longest chain has binary digits, and a message that
has arrived takes part in no further one. Then self-joins
extend every open path by the chains that reply to its tip, one branching a round, until no
path has a reply left. All rounds carry ids and scores only. Finished paths are ranked within their
tree by total score, and the chosen ones fetch their texts and become one string each.

Template: ``<s>[role]text</s>`` per turn. In roles and texts ``&``, ``<`` and ``[`` become
``&amp;``, ``&lt;`` and ``&lb;``, so no marker can occur inside them and the escape can be
undone. The loss mask lists the character ranges of the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

OPEN, MID, CLOSE = "<s>[", "]", "</s>"


def escape(text: Column) -> Column:
    """Reversibly free of template markers."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def unescape(text: Column) -> Column:
    """Undoes ``escape``."""
    out = text
    for raw, safe in (("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(safe), F.lit(raw))
    return out


def _chains(edges: DataFrame) -> DataFrame:
    """``(tree, first, parent, last, path, score)`` of the maximal runs of only replies."""
    replies = edges.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    only = replies.where("n = 1").select("tree", F.col("node").alias("parent"), F.lit(True).alias("_only"))
    linked = edges.join(only, ["tree", "parent"], "left").withColumn("_inner", F.col("_only").isNotNull())
    to = F.when(F.col("_inner"), F.col("parent")).otherwise(F.col("node"))
    now = stored(linked.select("tree", "node", "parent", "score", to.alias("first"), F.col("_inner").cast("long").alias("steps")))
    done, open_ = now.where("steps = 0"), now.where("steps > 0")
    left, before = open_.count(), -1
    while left and left != before:  # every round ends some chain; what never ends is a cycle, and no root leads there
        before = left
        ahead = done.unionByName(open_).select("tree", F.col("node").alias("first"), F.col("first").alias("_to"), F.col("steps").alias("_more"))
        hop = open_.join(ahead, ["tree", "first"])  # a chain whose first message doesn't exist drops out
        after = stored(hop.select("tree", "node", "parent", "score", F.col("_to").alias("first"), (F.col("steps") + F.col("_more")).alias("steps"), (F.col("_more") > 0).alias("_moved")))
        done, open_ = done.unionByName(after.where("not _moved").drop("_moved")), after.where("_moved").drop("_moved")
        left = open_.count()
    now = done
    heads = now.where("node = first").select("tree", "first", F.col("parent").alias("above"))
    at = F.struct("steps", "node")
    own = now.groupBy("tree", "first").agg(F.array_sort(F.collect_list(at)).alias("run"), F.sum("score").alias("score"), F.max(at).alias("end"))
    return own.join(heads, ["tree", "first"]).select("tree", "first", F.col("above").alias("parent"), F.col("end.node").alias("last"), F.transform("run", lambda x: x["node"]).alias("path"), "score")


def paths(nodes: DataFrame) -> DataFrame:
    """``(tree, node, parent, score)`` to ``(tree, path array<node>, score)`` from roots to
    leaves. A root has a null parent; messages whose parent doesn't exist, or that are their
    own ancestors, belong to no path. Node ids are unique in their tree."""
    edges = stored(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    chains = stored(_chains(edges))
    replies = chains.where("parent is not null").select(F.col("tree").alias("t"), "parent", F.col("last").alias("end"), F.col("path").alias("more"), F.col("score").alias("gain"))
    tips = chains.where("parent is null").select("tree", F.col("last").alias("tip"), "path", "score")
    done = []
    while not tips.isEmpty():
        grown = stored(tips.join(replies, (F.col("tree") == F.col("t")) & (F.col("tip") == F.col("parent")), "left"))
        done.append(grown.where("end is null").select("tree", "path", "score"))
        tips = grown.where("end is not null").select("tree", F.col("end").alias("tip"), F.concat("path", "more").alias("path"), (F.col("score") + F.col("gain")).alias("score"))
    if not done:
        return tips.select("tree", "path", "score")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def chosen(all_paths: DataFrame, top: int = 1) -> DataFrame:
    """The best ``top`` paths a tree; ties go to the smaller ids."""
    order = W.partitionBy("tree").orderBy(F.desc("score"), "path")
    return all_paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def render(turns: Column) -> Column:
    """An array of (role, text) as the template's string."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID), escape(t["text"]), F.lit(CLOSE))))


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """Half-open character ranges of that role's texts in the rendered string."""
    fixed = len(OPEN) + len(MID) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + len(OPEN) + len(MID) + F.length(escape(t["role"]))
        size = F.length(escape(t["text"]))
        span = F.array(F.struct(first.alias("start"), (first + size).alias("stop")))
        stop = acc["at"] + fixed + F.length(escape(t["role"])) + size
        return F.struct(stop.alias("at"), F.when(t["role"] == role, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def formatted(messages: DataFrame, top: int = 1) -> DataFrame:
    """``(tree, node, parent, score, role, text)`` to ``(tree, rank, formatted, loss_spans)``.

    Null roles and texts count as empty; repeated (tree, node) rows are the caller's to name
    apart; an empty table gives none.
    """
    best = chosen(paths(messages), top)
    texts = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    steps = best.select("tree", "rank", F.posexplode("path").alias("at", "node"))
    turn = F.struct("at", "role", "text")
    joined = steps.join(texts, ["tree", "node"]).groupBy("tree", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return joined.select("tree", "rank", render(F.col("turns")).alias("formatted"), loss_mask(F.col("turns")).alias("loss_spans"))


def read_back(rendered: Column) -> Column:
    """The (role, text) turns of a rendered string."""
    bodies = F.filter(F.split(rendered, CLOSE), lambda x: x != "")
    opened = F.transform(bodies, lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.length(x)))
    cut = F.transform(opened, lambda x: F.struct(x.alias("x"), F.instr(x, F.lit(MID)).alias("i")))
    return F.transform(cut, lambda c: F.struct(unescape(F.substring(c["x"], F.lit(1), c["i"] - 1)).alias("role"), unescape(F.substring(c["x"], c["i"] + 1, F.length(c["x"]))).alias("text")))


def conversations_as_trees(rows: DataFrame) -> DataFrame:
    """Turns as reply chains: each answers the one before it. Rows that share a turn follow
    each other by role and text."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    at = F.row_number().over(order).cast("long")
    named = rows.select(F.col("conv_id").alias("tree"), at.alias("node"), "role", "text")
    return named.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.length(F.coalesce("text", F.lit(""))).cast("double"))


CONTROL = "</s>[INST] ok [/INST]"


def op6_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 whose texts are control strings, formatted and
    read back.

    Rows without a conversation id are one conversation; rows without a turn come first in
    theirs, ties by role and text; null roles and texts count as empty; repeated rows are turns of
    their own; other columns are ignored; an empty table gives conversation -1 alone.
    """
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    every = rows.unionByName(extra).withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))  # joins lose null keys
    done = stored(formatted(stored(conversations_as_trees(every))))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))))
    return done.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss).select(
        F.expr("try_cast(tree AS bigint)").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", turns).cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same digests straight from the rows, without any template.
ORACLE = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), grouped AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;'))
           + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;')) + 9) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM grouped
"""
