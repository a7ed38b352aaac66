"""Promotion: staging, mapping, comparison with heads, tombstones, rules and digests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import calendar as CAL
from tidemark.functions import exact, hashing
from tidemark.operators import asof as A
from tidemark.operators import changes as C
from tidemark.plans.inputs import read
from tidemark.plans.registry import query

#: Heads from the even events, a new snapshot from the last event of each record.
_SIDES = """h AS (SELECT user_id || ':' || event_type AS record_id, arg_max(round(value / 10), event_id) AS value, arg_max(event_id, event_id) AS clock, 'r' || max(event_id) AS revision_id, CASE WHEN max(event_id) % 13 = 0 THEN 'TOMBSTONE' ELSE 'ASSERT' END AS op FROM events WHERE event_id % 2 = 0 AND user_id % 10 <> 3 GROUP BY 1),
n AS (SELECT user_id || ':' || event_type AS record_id, arg_max(round(value / 10), event_id) AS value, max(event_id) AS clock FROM events WHERE event_id % 3 <> 0 AND user_id % 10 <> 4 GROUP BY 1)"""


def sides(spark, d):
    e = read(spark, d, "events").withColumn("record_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type")).withColumn("v", F.round(F.col("value") / 10))
    h = e.where("event_id % 2 = 0 and user_id % 10 <> 3").groupBy("record_id").agg(F.max_by("v", "event_id").alias("value"), F.max("event_id").alias("clock"))
    h = h.withColumn("revision_id", F.concat(F.lit("r"), F.col("clock").cast("string"))).withColumn("op", F.when(F.col("clock") % 13 == 0, "TOMBSTONE").otherwise("ASSERT"))
    n = e.where("event_id % 3 <> 0 and user_id % 10 <> 4").groupBy("record_id").agg(F.max_by("v", "event_id").alias("value"), F.max("event_id").alias("clock"))
    return h, n


_DIFF = _SIDES + ", d AS (SELECT n.*, CASE WHEN h.record_id IS NULL THEN 'ASSERT' WHEN h.op <> 'TOMBSTONE' AND n.value IS NOT DISTINCT FROM h.value THEN 'SKIP' WHEN n.clock < h.clock THEN 'STALE' ELSE 'SUPERSEDE' END AS op, h.revision_id AS supersedes FROM n LEFT JOIN h USING (record_id))"


@query("d6_diff", f"WITH {_DIFF} SELECT record_id, value, op, supersedes FROM d")
def d6(spark, d):
    h, n = sides(spark, d)
    return C.diff(n, h, "record_id", ["value"], "clock").select("record_id", "value", "op", "supersedes")


@query("i16_diff_counts", f"WITH {_DIFF} SELECT op, count(*) AS n FROM d GROUP BY 1")
def i16(spark, d):
    h, n = sides(spark, d)
    return C.diff(n, h, "record_id", ["value"], "clock").groupBy("op").agg(F.count("*").alias("n"))


@query("i18_stale_rows", f"WITH {_DIFF} SELECT record_id, clock FROM d WHERE op = 'STALE'")
def i18(spark, d):
    h, n = sides(spark, d)
    return C.diff(n, h, "record_id", ["value"], "clock").where("op = 'STALE'").select("record_id", "clock")


@query("d7_tombstones", f"WITH {_SIDES} SELECT record_id, revision_id AS supersedes FROM h WHERE op <> 'TOMBSTONE' AND NOT EXISTS (SELECT 1 FROM n WHERE n.record_id = h.record_id)")
def d7(spark, d):
    h, n = sides(spark, d)
    return C.tombstones(h, n, "record_id").select("record_id", "supersedes")


@query("c18_scoped_tombstones", f"WITH {_SIDES} SELECT record_id FROM h WHERE op <> 'TOMBSTONE' AND record_id LIKE '%view' AND NOT EXISTS (SELECT 1 FROM n WHERE n.record_id = h.record_id)")
def c18(spark, d):
    h, n = sides(spark, d)
    return C.tombstones(h, n, "record_id", F.col("record_id").endswith("view")).select("record_id")


@query("i20_delta", f"WITH {_DIFF} SELECT op, count(*) AS n, count(supersedes) AS superseding FROM (SELECT op, supersedes FROM d WHERE op IN ('ASSERT', 'SUPERSEDE') UNION ALL SELECT 'TOMBSTONE', revision_id FROM h WHERE op <> 'TOMBSTONE' AND NOT EXISTS (SELECT 1 FROM n WHERE n.record_id = h.record_id)) GROUP BY 1")
def i20(spark, d):
    h, n = sides(spark, d)
    out = C.delta(C.diff(n, h, "record_id", ["value"], "clock"), C.tombstones(h, n, "record_id"))
    return out.groupBy("op").agg(F.count("*").alias("n"), F.count("supersedes").alias("superseding"))


@query("i15_promotion_report", f"WITH {_DIFF} SELECT split_part(record_id, ':', 2) AS kind, op, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM d GROUP BY 1, 2")
def i15(spark, d):
    h, n = sides(spark, d)
    return C.diff(n, h, "record_id", ["value"], "clock").groupBy(F.split_part("record_id", F.lit(":"), F.lit(2)).alias("kind"), "op").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("d18_revision_faults", f"""WITH e AS (SELECT user_id || ':' || event_type AS record_id, event_id FROM events), p AS (SELECT record_id, 'r' || event_id AS revision_id, event_id AS sequence, CASE WHEN event_id % 5 = 0 THEN 'TOMBSTONE' ELSE 'ASSERT' END AS op FROM e WHERE event_id % 2 = 0),
r AS (SELECT record_id, 'r' || (event_id - event_id % 4) AS revision_id, CASE WHEN event_id % 3 = 0 THEN 'ASSERT' ELSE 'SUPERSEDE' END AS op, 'r' || (event_id + 1) AS supersedes FROM e WHERE event_id % 10 = 1),
hd AS (SELECT record_id, arg_max(revision_id, sequence) AS rid, arg_max(op, sequence) AS hop FROM p GROUP BY 1),
x AS (SELECT r.record_id, r.revision_id, CASE WHEN r.revision_id IN (SELECT revision_id FROM p) THEN 'repeated_revision' WHEN r.op = 'ASSERT' AND rid IS NOT NULL AND hop <> 'TOMBSTONE' THEN 'assert_of_live' WHEN r.op <> 'ASSERT' AND NOT coalesce(r.supersedes = rid, FALSE) THEN 'wrong_predecessor' END AS fault FROM r LEFT JOIN hd USING (record_id))
SELECT fault, count(*) AS n FROM x WHERE fault IS NOT NULL GROUP BY 1""")
def d18(spark, d):
    k = F.col("event_id")
    e = read(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("record_id"), "event_id")
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    p = e.where(k % 2 == 0).select("record_id", name(k).alias("revision_id"), k.alias("sequence"), F.when(k % 5 == 0, "TOMBSTONE").otherwise("ASSERT").alias("op"))
    r = e.where(k % 10 == 1).select("record_id", name(k - k % 4).alias("revision_id"), F.when(k % 3 == 0, "ASSERT").otherwise("SUPERSEDE").alias("op"), name(k + 1).alias("supersedes"))
    return C.revision_faults(p, r).groupBy("fault").agg(F.count("*").alias("n"))


@query("c19_row_status", "SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'refused_required' WHEN m = 0 THEN 'unresolved' WHEN m > 1 THEN 'ambiguous' WHEN o_totalprice > 400000 THEN 'refused_number' WHEN o_orderkey % 7 = 0 THEN 'held' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT *, CAST(o_custkey % 4 AS INTEGER) AS m FROM orders) GROUP BY 1")
def c19(spark, d):
    k = F.col("o_orderkey")
    s = C.row_status(k % 50 != 0, F.col("o_custkey") % 4, F.col("o_totalprice") <= 400_000, k % 7 == 0)
    return read(spark, d, "orders").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("i17_op_times", f"WITH {_DIFF} SELECT op, CAST(sum(CASE op WHEN 'ASSERT' THEN clock WHEN 'SUPERSEDE' THEN greatest(clock, 500) ELSE NULL END) AS BIGINT) AS total FROM d GROUP BY 1")
def i17(spark, d):
    h, n = sides(spark, d)
    at = F.when(F.col("op") == "ASSERT", F.col("clock")).when(F.col("op") == "SUPERSEDE", F.greatest("clock", F.lit(500)))
    return C.diff(n, h, "record_id", ["value"], "clock").groupBy("op").agg(F.sum(at).alias("total"))


_RULES = "SELECT o_orderkey, epoch_us(timezone('America/New_York', CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP))) - 1 AS local_end, epoch_us(timezone('Asia/Seoul', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP))) AS local_start FROM orders"


@query("i22_time_rules", _RULES)
def i22(spark, d):
    day = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").select("o_orderkey", CAL.local_day_end(day, "America/New_York").alias("local_end"), CAL.local_day_start(day, "Asia/Seoul").alias("local_start"))


@query("h2_calendar_functions", "SELECT o_orderkey, last_day(d) AS month_end, CAST(date_trunc('month', d) AS DATE) - 1 AS prior_end, last_day(CAST(date_trunc('month', d) - INTERVAL 3 MONTH AS DATE)) AS lag3, CAST(date_trunc('month', d) - INTERVAL 11 MONTH AS DATE) AS trail12 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def h2(spark, d):
    day = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").select("o_orderkey", CAL.month_end(day).alias("month_end"), CAL.prior_month_end(day).alias("prior_end"), CAL.lag_month(day, 3).alias("lag3"), CAL.trailing_start(day, 12).alias("trail12"))


@query("h2_period_dates", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN make_date(1990 + p_partkey % 30, 1, 1) WHEN 1 THEN make_date(1990 + p_partkey % 30, 1 + p_partkey % 12, 1) WHEN 2 THEN make_date(1990 + p_partkey % 30, 3 * (p_partkey % 4) + 1, 1) END AS day FROM part")
def h2_period(spark, d):
    k = F.col("p_partkey")
    year = (1990 + k % 30).cast("string")
    text = F.when(k % 4 == 0, year).when(k % 4 == 1, F.concat(year, F.lit("-"), F.lpad((1 + k % 12).cast("string"), 2, "0"))).when(k % 4 == 2, F.concat(year, F.lit("-Q"), (k % 4 + 1).cast("string"))).otherwise("soon")
    return read(spark, d, "part").select("p_partkey", CAL.period_date(text).alias("day"))


@query("h1_strings", "SELECT p_partkey, split_part(p_name, ' ', 1) AS first, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, ltrim(lpad(CAST(p_size AS VARCHAR), 4, '0'), '0') AS bare, regexp_extract(p_brand, '#([0-9]+)', 1) AS num, regexp_full_match(p_name, '[a-z]+ [a-z]+') AS plain FROM part")
def h1(spark, d):
    padded = F.lpad(F.col("p_size").cast("string"), 4, "0")
    return read(spark, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), padded.alias("padded"), F.ltrim(padded, F.lit("0")).alias("bare"), F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("num"), F.col("p_name").rlike(r"\A(?:[a-z]+ [a-z]+)\z").alias("plain"))


@query("h3_exact_decimals", "SELECT l_orderkey % 100 AS bucket, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def h3(spark, d):
    x = read(spark, d, "lineitem").withColumn("m", exact.shortest_decimal(F.col("l_extendedprice")).cast("decimal(18,2)"))
    return x.groupBy((F.col("l_orderkey") % 100).alias("bucket"), ).agg(F.sum("m").cast("double").alias("total"), F.count("*").alias("n"))


@query("h4_arrays", "SELECT user_id, list_sort(list_distinct(list(event_type)))[1] AS first_type, len(list_distinct(list(event_type))) AS n_types, list_sum(list_transform(list_filter(list(CAST(event_id AS BIGINT)), lambda x: x % 2 = 0), lambda x: x % 10)) AS digits FROM events GROUP BY 1")
def h4(spark, d):
    g = read(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("t"), F.collect_list("event_id").alias("e"))
    digits = F.aggregate(F.transform(F.filter("e", lambda x: x % 2 == 0), lambda x: x % 10), F.lit(0).cast("long"), lambda a, b: a + b)
    return g.select("user_id", F.array_min("t").alias("first_type"), F.size(F.array_distinct("t")).cast("long").alias("n_types"), digits.alias("digits"))


@query("h5_json_fields", "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events WHERE json_valid(props) GROUP BY 1")
def h5(spark, d):
    e = read(spark, d, "events").where(F.try_parse_json("props").isNotNull())
    return e.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("h5_json_tokens", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS token FROM events")
def h5_tokens(spark, d):
    return read(spark, d, "events").select("event_id", exact.json_token_udf("k")("props").alias("token"))


@query("h6_record_ids", """SELECT p_partkey, sha256('["tidemark-record-1","part",[["brand","' || p_brand || '"],["name","' || p_name || '"]]]') AS record_id FROM part""")
def h6(spark, d):
    return read(spark, d, "part").select("p_partkey", hashing.record_id("part", {"brand": F.col("p_brand"), "name": F.col("p_name")}).alias("record_id"))


@query("h6_minted_ids", """SELECT s_suppkey, 'ins-' || sha256('["tidemark-id-1","supplier","' || s_name || '"]') AS id FROM supplier""")
def h6_minted(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", hashing.minted("ins-", "supplier", F.col("s_name")).alias("id"))


_CELL = lambda c, t: f"'{t}:' || coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')"
_ENCODED = " || ".join(_CELL(c, t) for c, t in (("o_orderkey", "i"), ("o_custkey", "i"), ("o_totalprice", "f"), ("o_orderpriority", "s")))
_SLICES = " || ':' || ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))


@query("e15_rowset_digest", f"SELECT o_orderstatus, count(*) AS n, sha256({_SLICES}) AS digest FROM (SELECT o_orderstatus, sha256({_ENCODED}) AS h FROM orders) GROUP BY 1")
def e15(spark, d):
    """Order-independent digests of the order rows of each status."""
    return hashing.rowset_digest(read(spark, d, "orders"), {"o_orderkey": "i", "o_custkey": "i", "o_totalprice": "f", "o_orderpriority": "s"}, ["o_orderstatus"])


@query("e6_fullest_generation", "SELECT event_type, arg_max(day, (n, day)) AS day, max(n) AS n FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, bool_or(event_id % 97 = 0) AS spoilt FROM events GROUP BY 1, 2) WHERE NOT spoilt GROUP BY 1")
def e6(spark, d):
    g = read(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.bool_or(F.col("event_id") % 97 == 0).alias("spoilt")).where("not spoilt")
    return g.groupBy("event_type").agg(F.max_by("day", F.struct("n", "day")).alias("day"), F.max("n").alias("n"))


@query("e19_data_through", "SELECT event_type, max(CAST(ts AS DATE)) AS through FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND s.event_id = e.event_id + 3) GROUP BY 1")
def e19(spark, d):
    e = read(spark, d, "events")
    s = e.select("user_id", "event_type", (F.col("event_id") - 3).alias("event_id"))
    return e.join(s, ["user_id", "event_type", "event_id"], "left_anti").groupBy("event_type").agg(F.max(F.col("ts").cast("date")).alias("through"))


_RUNS = "WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS old FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), y AS (SELECT *, CASE WHEN old IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM x) SELECT user_id, event_id, event_type, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM y QUALIFY fresh = 1"


@query("f3_revision_runs", _RUNS)
def f3(spark, d):
    r = A.revision_runs(read(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", ["event_type"])
    return r.select("user_id", "event_id", "event_type", "run")


@query("f4_vintage_spans", "SELECT user_id, event_type, count(*) AS spans, min(event_id - old) AS tightest FROM (SELECT user_id, event_type, event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS old FROM events) WHERE old IS NOT NULL GROUP BY 1, 2")
def f4(spark, d):
    old = F.lag("event_id").over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    return read(spark, d, "events").withColumn("old", old).where("old is not null").groupBy("user_id", "event_type").agg(F.count("*").alias("spans"), F.min(F.col("event_id") - F.col("old")).alias("tightest"))


@query("f5_next_dates", "SELECT o_orderkey, lead(CAST(o_orderdate AS DATE)) OVER w AS next_day, lead(o_totalprice) OVER w AS next_price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def f5(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", F.lead(F.col("o_orderdate").cast("date")).over(w).alias("next_day"), F.lead("o_totalprice").over(w).alias("next_price"))


@query("f6_capital_steps", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS factor FROM events")
def f6(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    return read(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("factor"))


@query("f7_dedupe_first", "SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r = 1")
def f7(spark, d):
    r = F.row_number().over(W.partitionBy("p_name").orderBy("p_retailprice", "p_partkey"))
    return read(spark, d, "part").withColumn("r", r).where("r = 1").select("p_name", "p_partkey")


@query("f8_occurrence_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS occurrence FROM lineitem")
def f8(spark, d):
    r = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r.alias("occurrence"))


@query("f20_series_cadence", "SELECT user_id, min(gap) AS cadence, max(day) AS latest FROM (SELECT user_id, day, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase')) GROUP BY 1")
def f20(spark, d):
    days = read(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(W.partitionBy("user_id").orderBy("day"))).cast("long")
    return days.withColumn("gap", gap).groupBy("user_id").agg(F.min("gap").alias("cadence"), F.max("day").alias("latest"))


@query("f23_incremental_window", "SELECT user_id, min(day) AS start, max(day) AS stop FROM (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)) WHERE r <= 5 GROUP BY 1")
def f23(spark, d):
    days = read(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("day")))
    return days.withColumn("r", r).where("r <= 5").groupBy("user_id").agg(F.min("day").alias("start"), F.max("day").alias("stop"))


@query("g6_fact_order", "SELECT p_type, string_agg(p_name, '|' ORDER BY coalesce(CASE WHEN p_size > 25 THEN p_brand END, ''), p_partkey) AS ordered FROM part GROUP BY 1")
def g6(spark, d):
    key = F.struct(F.coalesce(F.when(F.col("p_size") > 25, F.col("p_brand")), F.lit("")).alias("a"), F.col("p_partkey").alias("b"), F.col("p_name").alias("name"))
    g = read(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_list(key)).alias("l"))
    return g.select("p_type", F.array_join(F.transform("l", lambda x: x["name"]), "|").alias("ordered"))


@query("g7_latest_cursor", "SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS day, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS orderkey FROM orders GROUP BY 1")
def g7(spark, d):
    m = F.max(F.struct(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("orderkey")))
    return read(spark, d, "orders").groupBy("o_custkey").agg(m.alias("m")).select("o_custkey", "m.day", "m.orderkey")


@query("g8_top_periods", "SELECT c_mktsegment, c_custkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 8")
def g8(spark, d):
    r = F.row_number().over(W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return read(spark, d, "customer").withColumn("rank", r.cast("long")).where("rank <= 8").select("c_mktsegment", "c_custkey", "rank")


@query("d20_positional_compare", "SELECT side, count(*) AS n FROM (SELECT 'left' AS side FROM (SELECT l_orderkey, l_quantity FROM lineitem EXCEPT ALL SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber < 5) UNION ALL SELECT 'right' FROM (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber < 5 EXCEPT ALL SELECT l_orderkey, l_quantity FROM lineitem)) GROUP BY 1")
def d20(spark, d):
    li = read(spark, d, "lineitem")
    return C.both_ways(li.select("l_orderkey", "l_quantity"), li.where("l_linenumber < 5").select("l_orderkey", "l_quantity")).groupBy("side").agg(F.count("*").alias("n"))


@query("d22_disagreements", "SELECT a.s_nationkey AS nation, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) a JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) b ON s_nationkey = c_nationkey WHERE a.n IS DISTINCT FROM b.n")
def d22(spark, d):
    a = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    b = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return a.join(b, "nation").where(~F.col("suppliers").eqNullSafe(F.col("customers")))


@query("d5_filing_acceptance", "SELECT l_orderkey, l_linenumber, a.first AS accepted FROM lineitem LEFT JOIN (SELECT o_orderkey, min(CAST(o_orderdate AS DATE)) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def d5(spark, d):
    a = read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_orderkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("accepted"))
    li = read(spark, d, "lineitem").where("l_quantity > 45")
    return li.join(a, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "accepted")


@query("d9_manifest_held", "SELECT n_name, coalesce(n, 0) AS held FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1) ON s_nationkey = n_nationkey")
def d9(spark, d):
    h = read(spark, d, "supplier").where("s_acctbal < 0").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return read(spark, d, "nation").join(h, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("held"))


@query("d10_delisted", "WITH gone AS (SELECT l_partkey, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01') GROUP BY 1) SELECT l_partkey, last, p_name FROM gone JOIN part ON p_partkey = l_partkey")
def d10(spark, d):
    li = read(spark, d, "lineitem")
    recent = li.where(F.col("l_shipdate") >= F.expr("timestamp_ntz'2001-06-01 00:00:00'")).select("l_partkey").distinct()
    gone = li.join(recent, "l_partkey", "left_anti").groupBy("l_partkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("last"))
    return gone.join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_partkey", "last", "p_name")


@query("n1_declared_days", "WITH d AS (SELECT CAST(range AS DATE) AS day FROM range(DATE '2024-01-01', DATE '2025-01-01', INTERVAL 1 DAY)) SELECT day, CASE WHEN dayofweek(day) IN (0, 6) OR (month(day) = 12 AND day(day) = 25) THEN 'closed' WHEN month(day) = 12 AND day(day) = 24 THEN 'early' ELSE 'open' END AS status FROM d")
def n1(spark, d):
    from tidemark.sources.calendars import declared_days

    return declared_days(spark, "2024-01-01", "2024-12-31", closed=["2024-12-25"], special={"2024-12-24": "early"})


@query("n2_calendar_changes", "WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '2-HIGH') SELECT CASE WHEN a.day IS NULL THEN 'added' WHEN b.day IS NULL THEN 'removed' ELSE 'unchanged' END AS change, count(*) AS n FROM a FULL JOIN b ON a.day = b.day GROUP BY 1")
def n2(spark, d):
    o = read(spark, d, "orders")
    a = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").cast("date").alias("a")).distinct()
    b = o.where("o_orderpriority = '2-HIGH'").select(F.col("o_orderdate").cast("date").alias("b")).distinct()
    j = a.join(b, F.col("a") == F.col("b"), "full")
    return j.groupBy(F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("unchanged").alias("change")).agg(F.count("*").alias("n"))


@query("i28_freshness", "SELECT event_type, max(CAST(ts AS DATE)) AS through, DATE '2024-02-10' - max(CAST(ts AS DATE)) AS lag_days FROM events GROUP BY 1")
def i28(spark, d):
    t = read(spark, d, "events").groupBy("event_type").agg(F.max(F.col("ts").cast("date")).alias("through"))
    return t.withColumn("lag_days", F.datediff(F.lit("2024-02-10").cast("date"), "through").cast("long"))


@query("i26_relations_equal", "SELECT (SELECT count(*) FROM (SELECT o_orderkey, o_totalprice FROM orders EXCEPT ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 1000 <> 7)) AS only_left")
def i26(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return C.both_ways(o, o.where("o_orderkey % 1000 <> 7")).agg(F.count_if(F.col("side") == "left").alias("only_left"))


@query("d1_rows_by_generation", "SELECT n_regionkey AS pin, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 2 = 0 GROUP BY 1")
def d1(spark, d):
    pins = read(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("pin"))
    return read(spark, d, "customer").join(pins, "c_nationkey").groupBy("pin").agg(F.count("*").alias("n"))


@query("d2_flagged_rows", "SELECT l_returnflag, count(*) AS n, count(f.l_orderkey) AS flagged FROM lineitem LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_tax > 0.07) f USING (l_orderkey, l_partkey, l_suppkey) GROUP BY 1")
def d2(spark, d):
    li = read(spark, d, "lineitem")
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    flags = li.where("l_tax > 0.07").select(*keys).distinct().withColumn("_f", F.lit(True))
    return li.join(flags, keys, "left").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("_f").alias("flagged"))


@query("d4_session_lookup", "WITH s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) SELECT o_orderpriority, count(*) AS n, count(s.day) AS in_session FROM orders LEFT JOIN s ON s.day = CAST(o_orderdate AS DATE) GROUP BY 1")
def d4(spark, d):
    s = read(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    o = read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return o.join(s.withColumn("_s", F.lit(True)), "day", "left").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("_s").alias("in_session"))


@query("d11_absent_since", "WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS top FROM orders) SELECT c_custkey FROM customer, m WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND CAST(o_orderdate AS DATE) > top - 365)")
def d11(spark, d):
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    top = o.agg(F.max("day").alias("top"))
    late = o.crossJoin(F.broadcast(top)).where(F.col("day") > F.date_sub("top", 365))  # one row
    return read(spark, d, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("d19_integrity_audit", "SELECT 'semi' AS check, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'anti', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'full', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) FULL JOIN orders ON l_orderkey = o_orderkey")
def d19(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem").select("l_orderkey").distinct()
    on = F.col("o_orderkey") == F.col("l_orderkey")
    count = lambda how: o.join(li, on, how).agg(F.count("*").alias("n"))
    return count("left_semi").select(F.lit("semi").alias("check"), "n").unionByName(count("left_anti").select(F.lit("anti").alias("check"), "n")).unionByName(count("full").select(F.lit("full").alias("check"), "n"))


@query("d21_basis_except", "SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def d21(spark, d):
    li = read(spark, d, "lineitem")
    return li.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey").subtract(li.where("l_returnflag = 'N'").select("l_suppkey", "l_partkey"))


@query("d28_decision_pairs", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS decision, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS fill FROM orders QUALIFY fill > decision")
def d28(spark, d):
    day = F.col("o_orderdate").cast("date")
    fill = F.lead(day).over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read(spark, d, "orders").select("o_custkey", day.alias("decision"), fill.alias("fill")).where(F.col("fill") > F.col("decision"))


@query("d31_macro_as_of", "WITH m AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS value FROM orders WHERE dayofweek(o_orderdate) = 0 GROUP BY 1), s AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS decision FROM orders) SELECT decision, m.day AS as_of, value FROM s ASOF LEFT JOIN m ON decision >= m.day")
def d31(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    m = o.where(F.dayofweek("day") == 1).groupBy("day").agg(F.max("o_totalprice").alias("value")).withColumn("series", F.lit("m"))
    s = o.select(F.last_day("day").alias("decision")).distinct().withColumn("series", F.lit("m"))
    return A.asof_backward(s, m, "series", "decision", "day", ["value"]).select("decision", "as_of", "value")
