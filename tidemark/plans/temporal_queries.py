"""Head projections and reads around them over the revision history made from events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import temporal as T
from tidemark.plans.inputs import CUTOFF, HOUR, INGESTED, REVISIONS, read, revisions
from tidemark.plans.registry import query

DAY = 24 * HOUR


def event_sql(cutoff: str = str(CUTOFF), ingestion: str | None = str(INGESTED), excluded: str = "FALSE") -> str:
    """The strict event CASE in SQL."""
    seen = "TRUE" if ingestion is None else f"ingested <= {ingestion}"
    known, held = f"({seen} AND coalesce(known <= {cutoff}, FALSE))", f"(NOT coalesce(available <= {cutoff}, FALSE) OR {excluded})"
    return f"CASE WHEN {known} AND {held} AND op <> 'ASSERT' THEN 'pop' WHEN {known} AND NOT {held} AND role <> 'reference' THEN 'set' END"


def heads_sql(source: str = "revisions", keys: str = "record_id", event: str | None = None) -> str:
    """Heads of a relation as a subquery."""
    return f"""(SELECT * EXCLUDE (ev, rk) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sequence DESC) AS rk
      FROM (SELECT *, {event or event_sql()} AS ev FROM {source}) WHERE ev IS NOT NULL) WHERE rk = 1 AND ev = 'set' AND op <> 'TOMBSTONE')"""


@query("i1_project_heads", f"WITH {REVISIONS} SELECT subject, count(*) AS n_heads, round(sum(value), 4) AS total, max(sequence) AS deepest FROM {heads_sql()} GROUP BY subject")
def i1(spark, d):
    heads = T.project_heads(revisions(spark, d), CUTOFF, INGESTED)
    return heads.groupBy("subject").agg(F.count("*").alias("n_heads"), F.round(F.sum("value"), 4).alias("total"), F.max("sequence").alias("deepest"))


@query("i1_observed_heads", f"WITH {REVISIONS} SELECT record_id, event_id, sequence, op FROM {heads_sql(event="'set'")}")
def i1_observed(spark, d):
    return T.project_heads(revisions(spark, d)).select("record_id", "event_id", "sequence", "op")


@query("i2_heads_by_pin", f"WITH {REVISIONS} SELECT pin, record_id, event_id, value FROM {heads_sql(keys='pin, record_id', event=event_sql(excluded='flagged'))}")
def i2(spark, d):
    heads = T.project_heads(revisions(spark, d), CUTOFF, INGESTED, keys=("pin", "record_id"), excluded=F.col("flagged"))
    return heads.select("pin", "record_id", "event_id", "value")


_GRANT = "(SELECT * REPLACE (CASE WHEN pin = 1 THEN available END AS available) FROM revisions WHERE event_type <> 'click' AND (known IS NULL OR known <= 1705881600000000))"


@query("i3_read_heads", f"WITH {REVISIONS} SELECT pin, record_id, day, value FROM {heads_sql(_GRANT, 'pin, record_id')} WHERE day >= DATE '2024-01-05'")
def i3(spark, d):
    heads = T.read_heads(revisions(spark, d), CUTOFF, INGESTED, subjects=F.col("event_type") != "click", days=F.col("day") >= F.lit("2024-01-05").cast("date"), ceiling=1_705_881_600_000_000, granted={0: False, 1: True})
    return heads.select("pin", "record_id", "day", "value")


@query(
    "i4_held_back",
    f"""WITH {REVISIONS} SELECT record_id, CAST(sum(CASE WHEN known IS NULL OR available IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown,
    CAST(sum(CASE WHEN known > {CUTOFF} OR available > {CUTOFF} THEN 1 ELSE 0 END) AS BIGINT) AS n_late, count(*) AS n_rows
    FROM revisions WHERE ingested <= {INGESTED} GROUP BY record_id HAVING n_unknown + n_late > 0""",
)
def i4(spark, d):
    return T.held_back(revisions(spark, d), CUTOFF, INGESTED)


_CUTS = [(i, 1_704_672_000_000_000 + i * 4 * DAY) for i in range(6)]
_CUTS_SQL = "cutoffs(cutoff_id, cutoff) AS (VALUES " + ", ".join(f"({i}, {c})" for i, c in _CUTS) + ")"
_EV = event_sql("cutoff", None)


@query(
    "i5_heads_at_many_cutoffs",
    f"""WITH {REVISIONS}, {_CUTS_SQL}, ev AS (SELECT *, {_EV} AS e FROM revisions, cutoffs), last AS (SELECT *, row_number() OVER (PARTITION BY cutoff_id, record_id ORDER BY sequence DESC) AS rk FROM ev WHERE e IS NOT NULL)
    SELECT CAST(cutoff_id AS BIGINT) AS cutoff_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM last WHERE rk = 1 AND e = 'set' AND op <> 'TOMBSTONE' GROUP BY 1, 2""",
)
def i5(spark, d):
    return T.project_revisions(revisions(spark, d), _CUTS).groupBy("cutoff_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("i7_granted_rules", f"WITH {REVISIONS} SELECT pin, count(*) AS n FROM {heads_sql('(SELECT * REPLACE (CASE WHEN pin = 0 THEN available END AS available) FROM revisions)', 'pin, record_id')} GROUP BY pin")
def i7(spark, d):
    return T.read_heads(revisions(spark, d), CUTOFF, INGESTED, granted={0: True, 1: False}).groupBy("pin").agg(F.count("*").alias("n"))


@query(
    "i8_coverage",
    f"""WITH {REVISIONS}, grid AS (SELECT s.subject, t.event_type FROM (SELECT DISTINCT subject FROM revisions) s, (SELECT DISTINCT event_type FROM revisions) t),
    h AS (SELECT * FROM {heads_sql()})
    SELECT grid.subject, grid.event_type, CASE WHEN h.record_id IS NULL THEN 'missing_row' ELSE concat_ws(',', CASE WHEN h.value < 5 THEN 'low_value' END, CASE WHEN h.day < DATE '2024-01-10' THEN 'stale' END) END AS reasons
    FROM grid LEFT JOIN h ON grid.subject = h.subject AND grid.event_type = h.event_type""",
)
def i8(spark, d):
    r = revisions(spark, d)
    grid = r.select("subject").distinct().crossJoin(F.broadcast(r.select("event_type").distinct()))  # five types
    cells = T.coverage(grid, T.project_heads(r, CUTOFF, INGESTED), ["subject", "event_type"], {"low_value": F.col("value") < 5, "stale": F.col("day") < F.lit("2024-01-10").cast("date")})
    return cells.select("subject", "event_type", F.array_join("reasons", ",").alias("reasons"))


@query("i9_read_receipt", f"WITH {REVISIONS}, h AS (SELECT * FROM {heads_sql(keys='pin, record_id')}) SELECT pin, count(*) AS n, count(DISTINCT subject) AS subjects, min(event_id) AS low, max(event_id) AS high, CAST(sum(event_id) AS BIGINT) AS checksum FROM h GROUP BY pin")
def i9(spark, d):
    h = T.read_heads(revisions(spark, d), CUTOFF, INGESTED)
    return h.groupBy("pin").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"), F.min("event_id").alias("low"), F.max("event_id").alias("high"), F.sum("event_id").alias("checksum"))


@query(
    "i10_cutover_routing",
    f"""WITH {REVISIONS} SELECT CASE WHEN day < DATE '2024-01-08' THEN 0 WHEN day < DATE '2024-01-16' THEN 1 ELSE 0 END AS pin_for, count(*) AS n
    FROM revisions WHERE pin = CASE WHEN day < DATE '2024-01-08' THEN 0 WHEN day < DATE '2024-01-16' THEN 1 ELSE 0 END GROUP BY 1""",
)
def i10(spark, d):
    cut = spark.createDataFrame([(0, "1900-01-01", "2024-01-08"), (1, "2024-01-08", "2024-01-16"), (0, "2024-01-16", "9999-12-31")], "pin_for int, a string, b string").select("pin_for", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    r = revisions(spark, d)
    j = r.join(F.broadcast(cut), (r["day"] >= cut["a"]) & (r["day"] < cut["b"]) & (r["pin"] == cut["pin_for"]))  # three declared intervals
    return j.groupBy("pin_for").agg(F.count("*").alias("n"))


@query("i12_observed_dates", f"WITH {REVISIONS} SELECT record_id, CAST(make_timestamp(greatest(known, available)) AS DATE) AS observed, day FROM {heads_sql()}")
def i12(spark, d):
    h = T.project_heads(revisions(spark, d), CUTOFF, INGESTED)
    return h.select("record_id", F.date_from_unix_date(F.floor(F.greatest("known", "available") / DAY).cast("int")).alias("observed"), "day")


@query(
    "i23_bounded_clocks",
    f"""WITH {REVISIONS}, x AS (SELECT CASE WHEN known IS NULL THEN 'unknown' WHEN known < ingested - 6 * 3600000000 THEN 'held' WHEN known > ingested - 5 * 3600000000 THEN 'clamped' ELSE 'kept' END AS done,
    CASE WHEN known < ingested - 6 * 3600000000 THEN NULL WHEN known IS NULL THEN ingested - 5 * 3600000000 ELSE least(known, ingested - 5 * 3600000000) END AS clock FROM revisions)
    SELECT done, count(*) AS n, CAST(sum(clock % 1000003) AS BIGINT) AS checksum FROM x GROUP BY done""",
)
def i23(spark, d):
    r = revisions(spark, d)
    clock, done = T.bounded(F.col("known"), F.col("ingested") - 6 * HOUR, F.col("ingested") - 5 * HOUR)
    return r.select(clock.alias("clock"), done.alias("done")).groupBy("done").agg(F.count("*").alias("n"), F.sum(F.col("clock") % 1000003).alias("checksum"))


GENERATIONS = """generations AS (SELECT 'g' || event_type || '-' || s AS generation_id, event_type AS dataset_id, s AS sequence, CASE WHEN s > 1 THEN 'g' || event_type || '-' || (s - 1) END AS parent_id, n AS row_count
  FROM (SELECT event_type, dayofyear(ts) AS s, count(*) AS n FROM events GROUP BY 1, 2))"""


def generations(spark, d):
    """A chain a type of events: a generation a day."""
    g = read(spark, d, "events").groupBy("event_type", F.dayofyear("ts").alias("s")).agg(F.count("*").alias("row_count"))
    name = lambda s: F.concat(F.lit("g"), "event_type", F.lit("-"), s.cast("string"))
    return g.select(name(F.col("s")).alias("generation_id"), F.col("event_type").alias("dataset_id"), F.col("s").cast("long").alias("sequence"), F.when(F.col("s") > 1, name(F.col("s") - 1)).alias("parent_id"), "row_count")


@query("a25_generation_chain", f"WITH {GENERATIONS} SELECT g.generation_id, g.sequence, g.parent_id FROM generations g JOIN generations h ON g.dataset_id = h.dataset_id AND g.sequence <= h.sequence WHERE h.generation_id = 'gview-12'")
def a25(spark, d):
    return T.generation_chain(generations(spark, d), "gview-12").select("generation_id", "sequence", "parent_id")


@query(
    "a26_chain_rows",
    f"WITH {GENERATIONS} SELECT dayofyear(ts) AS sequence, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type = 'view' AND dayofyear(ts) <= (SELECT sequence FROM generations WHERE generation_id = 'gview-12') GROUP BY 1",
)
def a26(spark, d):
    chain = T.generation_chain(generations(spark, d), "gview-12")
    rows = read(spark, d, "events").withColumn("sequence", F.dayofyear("ts").cast("long"))
    j = rows.join(chain.select(F.col("dataset_id").alias("event_type"), "sequence"), ["event_type", "sequence"])
    return j.groupBy("sequence").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("a27_read_generation", f"WITH {REVISIONS} SELECT record_id, value FROM {heads_sql()} ORDER BY record_id LIMIT 100")
def a27(spark, d):
    return T.project_heads(revisions(spark, d), CUTOFF, INGESTED).orderBy("record_id").select("record_id", "value").limit(100)


@query(
    "i6_verify_pins",
    f"""WITH {GENERATIONS}, lagged AS (SELECT *, lag(generation_id) OVER w AS prior, lag(sequence) OVER w AS ps FROM (SELECT * FROM generations WHERE sequence % 7 <> 0) WINDOW w AS (PARTITION BY dataset_id ORDER BY sequence))
    SELECT generation_id, sequence FROM lagged WHERE parent_id IS DISTINCT FROM prior OR sequence <> coalesce(ps + 1, 1)""",
)
def i6(spark, d):
    return T.broken_links(generations(spark, d).where("sequence % 7 <> 0")).select("generation_id", "sequence")


@query("c16_visible_candidates", f"WITH {REVISIONS} SELECT event_type, count(*) AS n FROM revisions WHERE known IS NULL OR known <= {CUTOFF} GROUP BY 1")
def c16(spark, d):
    return revisions(spark, d).where(F.col("known").isNull() | (F.col("known") <= CUTOFF)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("e8_ordered_structs", f"WITH {REVISIONS} SELECT subject, string_agg(event_id || ':' || op, ',' ORDER BY event_id) AS flags FROM revisions WHERE flagged GROUP BY subject")
def e8(spark, d):
    flags = revisions(spark, d).where("flagged").groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("event_id", "op"))).alias("f"))
    return flags.select("subject", F.array_join(F.transform("f", lambda x: F.concat(x["event_id"].cast("string"), F.lit(":"), x["op"])), ",").alias("flags"))


@query("e22_chain_row_counts", f"WITH {GENERATIONS}, stored AS (SELECT 'g' || event_type || '-' || dayofyear(ts) AS generation_id, count(*) AS stored FROM events WHERE event_id % 50 <> 0 GROUP BY 1) SELECT generation_id, row_count AS claimed, stored FROM generations FULL JOIN stored USING (generation_id) WHERE row_count IS DISTINCT FROM stored")
def e22(spark, d):
    from tidemark.operators.changes import counts_against

    rows = read(spark, d, "events").where("event_id % 50 <> 0").select(F.concat(F.lit("g"), "event_type", F.lit("-"), F.dayofyear("ts").cast("string")).alias("generation_id"))
    return counts_against(generations(spark, d), rows, "generation_id")


@query("f2_heads_filtered_first", f"WITH {REVISIONS} SELECT record_id, sequence, op FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY sequence DESC) AS r FROM revisions WHERE day < DATE '2024-01-15') WHERE r = 1")
def f2(spark, d):
    kept = revisions(spark, d).where(F.col("day") < F.lit("2024-01-15").cast("date"))
    return kept.withColumn("r", F.row_number().over(W.partitionBy("record_id").orderBy(F.desc("sequence")))).where("r = 1").select("record_id", "sequence", "op")


@query("c4_event_states", f"WITH {REVISIONS} SELECT coalesce({event_sql()}, 'none') AS state, op, count(*) AS n FROM revisions GROUP BY 1, 2")
def c4(spark, d):
    return revisions(spark, d).select(F.coalesce(T.event(CUTOFF, INGESTED), F.lit("none")).alias("state"), "op").groupBy("state", "op").agg(F.count("*").alias("n"))


@query("i11_sessions_as_of", f"WITH {REVISIONS} SELECT day, count(*) AS n FROM {heads_sql(event=event_sql(ingestion=None))} WHERE event_type = 'view' GROUP BY day")
def i11(spark, d):
    return T.project_heads(revisions(spark, d), CUTOFF).where("event_type = 'view'").groupBy("day").agg(F.count("*").alias("n"))
