"""Head requests, row validation, verified reads and collection plans."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import planning as P
from tidemark.operators import requests as Q
from tidemark.plans.inputs import BARS, CUTOFF, FIXINGS, INGESTED, MONTHS, REVISIONS, bars, fixings, month_ends, read, revisions
from tidemark.plans.registry import query
from tidemark.plans.temporal_queries import event_sql, heads_sql
from tidemark.sources.storage import scratch, write_partitioned

_PRE = "(SELECT * FROM revisions WHERE event_type <> 'click' AND subject >= 10)"


@query("c1_split_predicates", f"WITH {REVISIONS} SELECT record_id, day, value FROM {heads_sql(_PRE)} WHERE value > 5 AND day >= DATE '2024-01-03'")
def c1(spark, d):
    day = F.to_date(F.lit("2024-01-03"))
    asked = Q.HeadRequest(CUTOFF, INGESTED, (("event_type", "<>", "click"), ("value", ">", 5), ("subject", ">=", 10), ("day", ">=", day)), frozenset({"event_type", "subject"}))
    return Q.read(revisions(spark, d), asked).select("record_id", "day", "value")


@query("c2_clock_days", f"WITH {REVISIONS} SELECT CAST(to_timestamp(floor(available / 86400000000.0) * 86400) AS DATE) AS day, count(*) AS n FROM revisions GROUP BY 1")
def c2(spark, d):
    return revisions(spark, d).groupBy(Q.day_of(F.col("available")).alias("day")).agg(F.count("*").alias("n"))


_CEIL = "(SELECT * FROM revisions WHERE role IN ('primary') AND (known IS NULL OR known <= 1705500000000000))"


@query("c3_roles_and_ceiling", f"WITH {REVISIONS} SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM {heads_sql(_CEIL)} GROUP BY 1")
def c3(spark, d):
    asked = Q.HeadRequest(CUTOFF, INGESTED, roles=("primary",), ceiling=1_705_500_000_000_000)
    return Q.read(revisions(spark, d), asked).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_FLAGS = "flags AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'late' ELSE 'bad' END AS kind FROM events WHERE event_id % 13 < 2 UNION ALL SELECT event_id, 'bad' FROM events WHERE event_id % 26 = 0)"


def flags(spark, d):
    e = read(spark, d, "events").select("event_id")
    some = e.where("event_id % 13 < 2").withColumn("kind", F.when(F.col("event_id") % 2 == 0, "late").otherwise("bad"))
    return some.unionByName(e.where("event_id % 26 = 0").withColumn("kind", F.lit("bad")))


@query("c5_flag_exclusion", f"WITH {REVISIONS}, {_FLAGS}, m AS (SELECT *, event_id IN (SELECT event_id FROM flags WHERE kind = 'bad') AS bad FROM revisions) SELECT record_id, event_id, value FROM {heads_sql('m', event=event_sql(excluded='bad'))}")
def c5(spark, d):
    asked = Q.HeadRequest(CUTOFF, INGESTED, flag_kinds=("bad",))
    return Q.read(revisions(spark, d), asked, flags(spark, d)).select("record_id", "event_id", "value")


@query("b3_flags_by_generation", f"WITH {_FLAGS} SELECT event_id // 1000 AS generation, kind, count(*) AS n, count(DISTINCT event_id) AS rows FROM flags GROUP BY 1, 2")
def b3(spark, d):
    root = scratch(spark)
    write_partitioned(flags(spark, d).withColumn("generation", F.floor(F.col("event_id") / 1000)), root, "generation")
    held = spark.read.schema("event_id long, kind string, generation long").parquet(root)
    return held.groupBy("generation", "kind").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("rows"))


@query(
    "c7_validated_rows",
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE ' ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' ' END AS price, CASE WHEN o_orderkey % 17 = 0 THEN '1995-13-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders),
    t AS (SELECT o_orderkey, trim(price) AS price, TRY_CAST(trim(price) AS DECIMAL(18,2)) AS p, trim(day) AS day, TRY_CAST(trim(day) AS DATE) AS dd FROM x)
    SELECT coalesce(CASE WHEN price <> '' AND p IS NULL THEN 'unparsed:price' WHEN dd IS NULL THEN 'unparsed:day' WHEN p IS NULL THEN 'missing:price' WHEN p > 300000 THEN 'too_high' END, 'fine') AS fault, count(*) AS n, round(sum(p), 2) AS total FROM t GROUP BY 1""",
)
def c7(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    price = F.when(k % 11 == 0, " ").when(k % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")))
    day = F.when(k % 17 == 0, "1995-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = Q.normalized(o.select("o_orderkey", price.alias("price"), day.alias("day")), {"price": "decimal(18,2)", "day": "date"}, ("price", "day"), {"too_high": F.col("price") > 300_000})
    return out.groupBy(F.coalesce("fault", F.lit("fine")).alias("fault")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("c20_layered_columns", "SELECT l_returnflag, round(sum(net), 2) AS net, round(sum(taxed), 2) AS taxed, count_if(big) AS big FROM (SELECT *, taxed > 50000 AS big FROM (SELECT *, net * (1 + l_tax) AS taxed FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem))) GROUP BY 1")
def c20(spark, d):
    x = Q.layered(read(spark, d, "lineitem"), [{"net": F.col("l_extendedprice") * (1 - F.col("l_discount"))}, {"taxed": F.col("net") * (1 + F.col("l_tax"))}, {"big": F.col("taxed") > 50_000}])
    return x.groupBy("l_returnflag").agg(F.round(F.sum("net"), 2).alias("net"), F.round(F.sum("taxed"), 2).alias("taxed"), F.count_if("big").alias("big"))


@query("c17_partition_files", f"WITH {BARS} SELECT instrument, count(*) AS n, max(close) AS high FROM bars WHERE year(day) BETWEEN 1995 AND 1996 GROUP BY 1")
def c17(spark, d):
    root = scratch(spark)
    write_partitioned(bars(spark, d).select("instrument", "day", "close", F.year("day").alias("part")), root, "part")
    held = spark.read.schema("instrument long, day date, close double, part int").parquet(root).where("part between 1995 and 1996")
    return held.groupBy("instrument").agg(F.count("*").alias("n"), F.max("close").alias("high"))


def _digests(spark, root):
    """(path, sha256) of the files below a folder; their contents stay on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


@query("a2_pinned_price_read", f"WITH {BARS} SELECT instrument, day, close, TRUE AS verified, count(*) OVER () > 500 AS truncated FROM (SELECT * FROM bars WHERE close > 50000 ORDER BY day, instrument LIMIT 501) ORDER BY day, instrument LIMIT 500")
def a2(spark, d):
    """Prices of a pinned catalog: digests hold before and after the read, one row over the limit
    tells truncation."""
    root = scratch(spark)
    bars(spark, d).select("instrument", "day", "close").write.parquet(root)
    pins = _digests(spark, root)
    pinned = pins.agg(F.sort_array(F.collect_list("sha256")).alias("p")).first()["p"]  # one digest a file of the catalog
    rows = spark.read.schema("instrument long, day date, close double").parquet(root).where("close > 50000").orderBy("day", "instrument").limit(501)
    again = _digests(spark, root).agg((F.sort_array(F.collect_list("sha256")) == F.array(*[F.lit(p) for p in pinned])).alias("verified"))
    counted = rows.agg((F.count("*") > 500).alias("truncated"))
    return rows.orderBy("day", "instrument").limit(500).join(F.broadcast(again), F.lit(True)).join(F.broadcast(counted), F.lit(True))  # one row each


_ROW = "md5(concat_ws('|', " + ", ".join(f"length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR)" for c in ("l_orderkey", "l_linenumber", "l_returnflag")) + "))"


@query("b6_table_receipts", f"SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(concat('0x', substr({_ROW}, 1, 10)) AS BIGINT)) AS DECIMAL(38,0)) AS checksum FROM lineitem GROUP BY 1")
def b6(spark, d):
    return Q.receipts(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], ["l_returnflag"])


@query("a7_resolved_sources", "SELECT l_returnflag AS source, l_returnflag <> 'R' AS matches FROM lineitem GROUP BY 1")
def a7(spark, d):
    """Stored tables digested again and compared with their pins; one had a row changed."""
    columns = ["l_orderkey", "l_linenumber", "l_quantity"]
    li = read(spark, d, "lineitem")
    pins = Q.receipts(li, columns, ["l_returnflag"])
    last = li.agg(F.max(F.when(F.col("l_returnflag") == "R", F.struct("l_orderkey", "l_linenumber"))).alias("m"))
    held = li.join(F.broadcast(last), F.lit(True)).withColumn("l_quantity", F.when((F.col("l_returnflag") == "R") & (F.struct("l_orderkey", "l_linenumber") == F.col("m")), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))  # one row
    now = Q.receipts(held, columns, ["l_returnflag"]).select(F.col("l_returnflag").alias("source"), F.col("n").alias("n2"), F.col("checksum").alias("c2"))
    return pins.join(now, F.col("l_returnflag") == F.col("source")).select("source", ((F.col("n") == F.col("n2")) & (F.col("checksum") == F.col("c2"))).alias("matches"))


@query("b5_result_tables", f"WITH {MONTHS} SELECT t, count(*) AS n FROM (SELECT 'decisions' AS t FROM months UNION ALL SELECT 'positions' FROM months WHERE close > 30000 UNION ALL SELECT 'metrics' FROM (SELECT DISTINCT asset FROM months)) GROUP BY 1")
def b5(spark, d):
    """Result tables of a run written apart and read back once every one has its marker."""
    m, root = month_ends(spark, d), scratch(spark)
    tables = {"decisions": m.select("asset", "month"), "positions": m.where("close > 30000").select("asset", "month"), "metrics": m.select("asset", F.lit(None).cast("date").alias("month")).distinct()}
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/t={name}")
    return spark.read.schema("asset long, month date, t string").parquet(root).groupBy("t").agg(F.count("*").alias("n"))


_PRICES = "struct<symbol:string,rows:array<struct<day:date,close:double>>>"


@query("a18_import_envelope", f"WITH {BARS} SELECT instrument, count(*) AS n, round(sum(close), 2) AS total FROM bars GROUP BY 1")
def a18(spark, d):
    """Typed envelopes: one JSON document a symbol, read with a schema and validated."""
    b = bars(spark, d).groupBy("instrument").agg(F.collect_list(F.struct("day", "close")).alias("rows"))
    sent = b.select(F.to_json(F.struct(F.col("instrument").cast("string").alias("symbol"), "rows")).alias("raw"))
    got = sent.select(F.from_json("raw", _PRICES, {"mode": "FAILFAST"}).alias("x")).select(F.col("x.symbol").cast("long").alias("instrument"), F.explode("x.rows").alias("r"))
    return got.groupBy("instrument").agg(F.count("*").alias("n"), F.round(F.sum("r.close"), 2).alias("total"))


@query("a24_nested_history", f"WITH {BARS} SELECT instrument, min(day) AS first, max(close) AS high FROM bars GROUP BY 1")
def a24(spark, d):
    """JSON within JSON: the outer document's text field is itself a document."""
    b = bars(spark, d).groupBy("instrument").agg(F.to_json(F.collect_list(F.struct("day", "close"))).alias("d"))
    sent = b.select("instrument", F.to_json(F.struct("d")).alias("raw"))
    inner = sent.select("instrument", F.from_json("raw", "struct<d:string>").alias("o")).select("instrument", F.explode(F.from_json("o.d", "array<struct<day:date,close:double>>")).alias("r"))
    return inner.groupBy("instrument").agg(F.min("r.day").alias("first"), F.max("r.close").alias("high"))


@query("a11_history_manifest", "WITH plan AS (SELECT s_suppkey AS series, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1), held AS (SELECT l_suppkey AS series, count(*) AS n FROM lineitem WHERE l_linenumber < 7 GROUP BY 1) SELECT p.series, p.n AS planned, coalesce(h.n, 0) AS held, CASE WHEN h.n IS NULL THEN 'absent' WHEN h.n < p.n THEN 'short' ELSE 'whole' END AS state FROM plan p LEFT JOIN held h USING (series)")
def a11(spark, d):
    """An export's series files reconciled with what its batch manifests promise."""
    li, root = read(spark, d, "lineitem"), scratch(spark)
    plan = read(spark, d, "supplier").join(li, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_suppkey").alias("series")).agg(F.count("*").alias("planned"))
    li.where("l_linenumber < 7").select(F.col("l_suppkey").alias("series"), "l_orderkey").write.option("header", True).csv(root)
    held = spark.read.option("header", True).schema("series long, l_orderkey long").csv(root).groupBy("series").agg(F.count("*").alias("h"))
    state = F.when(F.col("h").isNull(), "absent").when(F.col("h") < F.col("planned"), "short").otherwise("whole")
    return plan.join(held, "series", "left").select("series", "planned", F.coalesce("h", F.lit(0)).alias("held"), state.alias("state"))


@query("e24_size_admission", "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(strlen(text)) AS BIGINT) AS largest, sum(strlen(text)) <= 200000 AS admitted FROM documents GROUP BY 1")
def e24(spark, d):
    return P.admitted(read(spark, d, "documents"), ["source"], F.octet_length("text").cast("long"), 200_000)


@query("g4_keyset_pages", "SELECT page, count(*) AS n, min(day) AS first_day, max(o_orderkey) FILTER (WHERE k = last) AS last_key FROM (SELECT *, max(k) OVER (PARTITION BY page) AS last FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS k, (row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1) // 500 AS page FROM orders)) GROUP BY 1")
def g4(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    return P.pages(o, ["day", "o_orderkey"], 500).select("page", "n", F.col("first.day").alias("first_day"), F.col("last.o_orderkey").alias("last_key"))


_SPANS = "s AS (SELECT o_custkey AS key, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders GROUP BY 1)"


def order_spans(spark, d):
    day = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.min(day).alias("a"), F.max(day).alias("z"))


@query("j4_window_chunks", f"WITH {_SPANS}, w AS (SELECT key, z, unnest(generate_series(a, z, INTERVAL 400 DAYS))::DATE AS first FROM s) SELECT key, first, least(first + 399, z) AS last FROM w")
def j4(spark, d):
    return P.window_chunks(order_spans(spark, d), "a", "z", 400)


@query("j4_split_windows", f"WITH {_SPANS}, w AS (SELECT key, z, unnest(generate_series(a, z, INTERVAL 400 DAYS))::DATE AS first FROM s), c AS (SELECT key, first, least(first + 399, z) AS last FROM w), n AS (SELECT c.key, c.first, c.last, count(o_orderkey) AS n FROM c LEFT JOIN orders ON o_custkey = c.key AND CAST(o_orderdate AS DATE) BETWEEN c.first AND c.last GROUP BY ALL), h AS (SELECT *, n >= 3 AND last > first AS cut, first + CAST((last - first) // 2 AS INTEGER) AS mid FROM n) SELECT key, n, first, CASE WHEN cut THEN mid ELSE last END AS last FROM h UNION ALL SELECT key, n, mid + 1, last FROM h WHERE cut")
def j4_split(spark, d):
    w = P.window_chunks(order_spans(spark, d), "a", "z", 400)
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("date").alias("day"))
    hit = w.join(o, "key", "left").groupBy("key", "first", "last").agg(F.count_if(F.col("day").between(F.col("first"), F.col("last"))).alias("n"))
    return P.halved(hit, F.col("n"), 3)


@query("j1_collection_watermark", "SELECT event_type, event_id, coalesce(ok AND (before IS NULL OR day > before), FALSE) AS advanced, max(CASE WHEN ok THEN day END) OVER (PARTITION BY event_type ORDER BY event_id) AS watermark FROM (SELECT *, max(CASE WHEN ok THEN day END) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT event_type, event_id, CAST(ts AS DATE) - CAST(event_id % 3 AS INTEGER) AS day, event_id % 5 <> 0 AS ok FROM events))")
def j1(spark, d):
    e = read(spark, d, "events").select("event_type", "event_id", F.date_sub(F.col("ts").cast("date"), (F.col("event_id") % 3).cast("int")).alias("day"), (F.col("event_id") % 5 != 0).alias("ok"))
    return P.advances(e, "event_type", ["event_id"], "day", F.col("ok")).select("event_type", "event_id", "advanced", "watermark")


@query("j3_revalidated_days", f"WITH {BARS} SELECT instrument, min(day) AS from_day, max(day) AS watermark, count(*) AS n FROM (SELECT instrument, day, row_number() OVER (PARTITION BY instrument ORDER BY day DESC) AS r FROM bars) WHERE r <= 5 GROUP BY 1")
def j3(spark, d):
    return P.revalidated(bars(spark, d), "instrument", "day", 5)


@query("i27_backfill_steps", "SELECT lineage, part, n, row_number() OVER (PARTITION BY lineage ORDER BY part) AS step, CAST(coalesce(sum(n) OVER (PARTITION BY lineage ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS published FROM (SELECT l_returnflag AS lineage, CAST(year(l_shipdate) AS INTEGER) AS part, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def i27(spark, d):
    return P.backfill_steps(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("lineage"), F.year("l_shipdate").alias("part")), "lineage", "part")


@query("n9_route_candidates", "SELECT l_suppkey, count(*) AS n, count_if(l_linenumber <= 7 AND l_quantity < 50) AS n_fit, bool_or(l_suppkey % 9 = 0) AS done, CASE WHEN bool_or(l_suppkey % 9 = 0) THEN 'done' WHEN count_if(l_linenumber <= 7 AND l_quantity < 50) = 0 THEN 'empty' WHEN count_if(l_linenumber <= 7 AND l_quantity < 50) < count(*) THEN 'mixed' ELSE 'candidate' END AS state FROM lineitem GROUP BY 1")
def n9(spark, d):
    return P.candidates(read(spark, d, "lineitem"), "l_suppkey", (F.col("l_linenumber") <= 7) & (F.col("l_quantity") < 50), F.col("l_suppkey") % 9 == 0)


@query("n12_dataset_catalog", "SELECT p_brand AS dataset, count(*) AS versions, arg_max(p_partkey, (p_size, p_partkey)) AS latest FROM part GROUP BY 1")
def n12(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("dataset")).agg(F.count("*").alias("versions"), F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("latest"))


@query("l20_membership_parts", "SELECT c_nationkey, part, count(*) AS members, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT c_nationkey, size, (sum(size) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - size) // 512 AS part FROM (SELECT c_nationkey, c_custkey, strlen(c_name) + 1 AS size FROM customer)) GROUP BY 1, 2")
def l20(spark, d):
    c = read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name")
    return P.byte_parts(c, "c_nationkey", ["c_custkey"], F.octet_length("c_name") + 1, 512).groupBy("c_nationkey", "part").agg(F.count("*").alias("members"), F.sum("_size").cast("long").alias("bytes"))


@query("f24_seam_continuity", f"WITH {BARS}, s AS (SELECT instrument, arg_max(close, day) FILTER (WHERE day < DATE '1998-07-01') AS before, arg_min(close, day) FILTER (WHERE day >= DATE '1998-07-01') AS after FROM bars GROUP BY 1) SELECT instrument, round(after / before, 8) AS ratio, CASE WHEN before IS NULL OR after IS NULL OR before = 0 THEN 'unknown' WHEN abs(after / before - 1) <= 0.4 THEN 'continuous' ELSE 'broken' END AS verdict FROM s")
def f24(spark, d):
    old = F.col("day") < F.to_date(F.lit("1998-07-01"))
    s = bars(spark, d).groupBy("instrument").agg(F.max_by("close", F.when(old, F.col("day"))).alias("before"), F.min_by("close", F.when(~old, F.col("day"))).alias("after"))
    return P.seam_checks(s, 0.4).select("instrument", F.round("ratio", 8).alias("ratio"), "verdict")


@query("d29_next_open_fill", f"WITH {BARS} SELECT instrument, day AS decision, lead(day) OVER w AS fill, lead(open) OVER w AS price FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY day) QUALIFY fill IS NOT NULL")
def d29(spark, d):
    w = W.partitionBy("instrument").orderBy("day")
    return bars(spark, d).select("instrument", F.col("day").alias("decision"), F.lead("day").over(w).alias("fill"), F.lead("open").over(w).alias("price")).where("fill is not null")


@query("g2_read_order", f"WITH {REVISIONS} SELECT pin, record_id, row_number() OVER (PARTITION BY pin ORDER BY record_id) AS place FROM {heads_sql('revisions', 'pin, record_id')}")
def g2(spark, d):
    from tidemark.operators.temporal import project_heads
    from tidemark.sources.sharding import ordinals

    placed = ordinals(project_heads(revisions(spark, d), CUTOFF, INGESTED, keys=("pin", "record_id")).select("pin", "record_id"), ["pin", "record_id"])
    first = placed.groupBy("pin").agg(F.min("ordinal").alias("_f"))
    return placed.join(first, "pin").select("pin", "record_id", (F.col("ordinal") - F.col("_f") + 1).alias("place"))


@query("g10_union_all_by_name", "SELECT kind, name, nation FROM (SELECT s_name AS name, s_nationkey AS nation, 'supplier' AS kind FROM supplier UNION ALL BY NAME SELECT 'customer' AS kind, c_name AS name FROM customer)")
def g10(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return s.unionByName(read(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name")), allowMissingColumns=True).select("kind", "name", "nation")


@query("i25_market_audit", "SELECT 'orphans' AS check, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'duplicates', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1) UNION ALL SELECT 'prices', count_if(l_extendedprice <= 0 OR l_extendedprice IS NULL) FROM lineitem UNION ALL SELECT 'clocks', count_if(l_shipdate < o_orderdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def i25(spark, d):
    """The whole-store audit: one row a check, all checks in one job."""
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    count = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    on = F.col("l_orderkey") == F.col("o_orderkey")
    parts = [
        count("orphans", o.join(li.select("l_orderkey").distinct(), on, "left_anti")), count("duplicates", li.groupBy("l_orderkey", "l_partkey").count().where("count > 1")),
        count("prices", li.where("l_extendedprice <= 0 or l_extendedprice is null")), count("clocks", li.join(o, on).where("l_shipdate < o_orderdate")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("l14_minimum_history", "SELECT p_brand AS strategy, max(greatest(1, p_size + 1, CASE WHEN p_type LIKE '%STEEL%' THEN p_size + 10 END)) AS months, count(DISTINCT p_type) AS inputs FROM part GROUP BY 1")
def l14(spark, d):
    """Required inputs and history of a strategy: its longest return horizon or average, and one."""
    need = F.greatest(F.lit(1), F.col("p_size") + 1, F.when(F.col("p_type").contains("STEEL"), F.col("p_size") + 10))
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("strategy")).agg(F.max(need).alias("months"), F.countDistinct("p_type").alias("inputs"))


@query("n16_requirement_rows", "SELECT p_brand AS strategy, p_type AS input, 'price' AS kind FROM part GROUP BY 1, 2 UNION ALL SELECT p_brand, 'macro', 'macro' FROM part GROUP BY 1")
def n16(spark, d):
    c = read(spark, d, "part").groupBy(F.col("p_brand").alias("strategy")).agg(F.collect_set("p_type").alias("assets"))
    price = c.select("strategy", F.explode("assets").alias("input"), F.lit("price").alias("kind"))
    return price.unionByName(c.select("strategy", F.lit("macro").alias("input"), F.lit("macro").alias("kind")))


@query("l16_price_points", f"WITH {BARS}, {FIXINGS}, dec AS (SELECT instrument, last_day(day) AS decision, arg_max(close, day) AS signal FROM bars GROUP BY 1, 2), fx AS (SELECT currency, last_day(day) AS decision, arg_max(rate, day) AS rate FROM fixings GROUP BY 1, 2), o AS (SELECT dec.*, lead(signal) OVER (PARTITION BY instrument ORDER BY decision) AS outcome FROM dec) SELECT o.instrument, o.decision, o.signal, o.outcome, round(o.signal / fx.rate, 8) AS converted FROM o ASOF LEFT JOIN fx ON fx.currency = o.instrument % 25 AND o.decision >= fx.decision")
def l16(spark, d):
    """Signals at each decision, the outcome at the next, and the signal in another currency."""
    end = F.last_day("day")
    own = bars(spark, d).groupBy("instrument", end.alias("decision")).agg(F.max_by("close", "day").alias("signal"))
    own = own.withColumn("outcome", F.lead("signal").over(W.partitionBy("instrument").orderBy("decision"))).withColumn("currency", F.col("instrument") % 25)
    fx = fixings(spark, d).groupBy("currency", end.alias("decision")).agg(F.max_by("rate", "day").alias("rate"))
    j = A.asof_backward(own, fx, "currency", "decision", "decision", ["rate"])
    return j.select("instrument", "decision", "signal", "outcome", F.round(F.col("signal") / F.col("rate"), 8).alias("converted"))


@query("l17_two_sleeves", f"WITH {MONTHS}, r AS (SELECT asset, month, close / lag(close) OVER (PARTITION BY asset ORDER BY month) - 1 AS ret FROM months), s AS (SELECT month, avg(ret) FILTER (WHERE asset % 2 = 0) AS a, avg(ret) FILTER (WHERE asset % 2 = 1) AS b, avg(ret) AS master FROM r WHERE ret IS NOT NULL GROUP BY 1) SELECT month, CASE WHEN lag(master) OVER (ORDER BY month) < 0 THEN 'b' ELSE 'a' END AS sleeve, round(CASE WHEN lag(master) OVER (ORDER BY month) < 0 THEN b ELSE a END, 8) AS ret FROM s")
def l17(spark, d):
    """Two sleeves and a master switch: last month's sign chooses this month's sleeve."""
    w = W.partitionBy("asset").orderBy("month")
    r = month_ends(spark, d).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).where("ret is not null")
    even = F.col("asset") % 2 == 0
    s = r.groupBy("month").agg(F.avg(F.when(even, F.col("ret"))).alias("a"), F.avg(F.when(~even, F.col("ret"))).alias("b"), F.avg("ret").alias("master"))
    low = F.coalesce(F.lag("master").over(W.orderBy("month")) < 0, F.lit(False))  # one row a month
    return s.select("month", F.when(low, "b").otherwise("a").alias("sleeve"), F.round(F.when(low, F.col("b")).otherwise(F.col("a")), 8).alias("ret"))


_RULES = {"cents": lambda c: F.round(c, 2), "whole": lambda c: F.floor(c).cast("double"), "signed": lambda c: -c}


@query("k6_named_rules", "SELECT l_shipmode_rule AS rule, round(sum(CASE l_shipmode_rule WHEN 'cents' THEN round(l_extendedprice * (1 - l_discount), 2) WHEN 'whole' THEN floor(l_extendedprice * (1 - l_discount)) ELSE -(l_extendedprice * (1 - l_discount)) END), 0) AS total FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'cents' WHEN 1 THEN 'whole' ELSE 'signed' END AS l_shipmode_rule FROM lineitem) GROUP BY 1")
def k6(spark, d):
    """Rules by name and version: a row names its rule, and each rule is one expression."""
    rule = F.when(F.col("l_linenumber") % 3 == 0, "cents").when(F.col("l_linenumber") % 3 == 1, "whole").otherwise("signed")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    value = F.coalesce(*[F.when(F.col("rule") == name, make(net)) for name, make in _RULES.items()])
    return read(spark, d, "lineitem").withColumn("rule", rule).groupBy("rule").agg(F.round(F.sum(value), 0).alias("total"))


@query("l19_registration_plan", "SELECT CASE WHEN s_name IS NULL THEN 'new' WHEN s_nationkey <> c_nationkey THEN 'moved' ELSE 'same' END AS action, count(*) AS n FROM customer LEFT JOIN supplier ON right(s_name, 9) = right(c_name, 9) GROUP BY 1")
def l19(spark, d):
    """What registering a registry document would do to the known identities."""
    c = read(spark, d, "customer").select(F.right("c_name", F.lit(9)).alias("token"), "c_nationkey")
    s = read(spark, d, "supplier").select(F.right("s_name", F.lit(9)).alias("token"), "s_nationkey")
    action = F.when(F.col("s_nationkey").isNull(), "new").when(F.col("s_nationkey") != F.col("c_nationkey"), "moved").otherwise("same")
    return c.join(s, "token", "left").groupBy(action.alias("action")).agg(F.count("*").alias("n"))
