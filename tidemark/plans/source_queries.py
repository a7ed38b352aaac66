"""Sources and sinks, each read back after it is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import changes as C
from tidemark.plans.inputs import read
from tidemark.plans.registry import query
from tidemark.sources import formats, sharding, storage


@query("a1_partitioned_scan", "SELECT l_returnflag AS basis, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, round(sum(l_quantity), 2) AS volume FROM lineitem WHERE l_returnflag = 'A' AND year(l_shipdate) = 1998 GROUP BY 1, 2")
def a1(spark, d):
    path = storage.scratch(spark)
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("basis"), F.year("l_shipdate").alias("year"), "l_quantity", "l_extendedprice")
    storage.write_partitioned(rows.repartition("basis", "year"), path, "basis", "year")
    own = spark.read.parquet(path).where("basis = 'A' and year = 1998")
    return own.groupBy("basis", "year").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("volume"))


@query("a3_ordinal_ingest", "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal, o_orderkey FROM orders")
def a3(spark, d):
    return sharding.ordinals(read(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("ordinal", "o_orderkey")


@query("a9_text_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def a9(spark, d):
    path = storage.scratch(spark)
    cols = ["s_suppkey", "s_name", "s_nationkey"]
    read(spark, d, "supplier").select(*[F.col(c).cast("string").alias(c) for c in cols]).write.option("header", True).csv(path)
    return formats.text_csv(spark, path, cols)


@query("a10_exact_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_keys(props) = ['k']")
def a10(spark, d):
    return formats.exact_json(read(spark, d, "events").select("event_id", "props"), "props", {"k": "bigint"}).where("_fault is null").select("event_id", "k")


@query("a15_parallel_arrays", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def a15(spark, d):
    pair = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    wide = read(spark, d, "orders").groupBy("o_custkey").agg(pair.alias("p"))
    wide = wide.select("o_custkey", F.col("p.o_orderkey").alias("o_orderkey"), F.col("p.o_totalprice").alias("o_totalprice"))
    return formats.parallel_rows(wide, ["o_orderkey", "o_totalprice"], ["o_custkey"])


@query("a21_typed_records", "SELECT count(*) FILTER (WHERE event_id % 10 <> 0) AS typed, count(*) FILTER (WHERE event_id % 10 = 0) AS held FROM events")
def a21(spark, d):
    text = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string"))
    good, held = formats.typed(read(spark, d, "events").select("event_id", text.alias("value")), {"value": "double"})
    return good.agg(F.count("*").alias("typed")).crossJoin(held.agg(F.count("*").alias("held")))  # one row each


@query("a22_nested_facts", "SELECT n_regionkey, 'geo' AS taxonomy, n_name AS tag, 'K' AS unit, '2024-01-0' || CAST(1 + n_nationkey % 3 AS VARCHAR) AS \"end\", CAST(n_nationkey * 1.5 AS VARCHAR) AS val FROM nation")
def a22(spark, d):
    fact = F.array(F.struct(F.concat(F.lit("2024-01-0"), (1 + F.col("n_nationkey") % 3).cast("string")).alias("end"), (F.col("n_nationkey") * 1.5).cast("string").alias("val")))
    inner = F.map_from_entries(F.collect_list(F.struct("n_name", F.create_map(F.lit("K"), fact))))
    docs = read(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.create_map(F.lit("geo"), inner)).alias("doc"))
    return formats.nested_facts(docs, "doc", ["n_regionkey"])


@query("a23_observations", "SELECT user_id, CAST(ts AS DATE) AS day, event_id, CASE WHEN event_id % 12 <> 0 THEN value END AS value FROM events WHERE event_type = 'view'")
def a23(spark, d):
    text = F.when(F.col("event_id") % 12 == 0, ".").otherwise(F.col("value").cast("string"))
    e = read(spark, d, "events").where("event_type = 'view'").withColumn("text", text)
    return e.select("user_id", F.col("ts").cast("date").alias("day"), "event_id", F.nullif("text", F.lit(".")).cast("double").alias("value"))


@query("a28_manifest_items", "SELECT conv_id, turn, unnest(string_split(text, ' '))[1:1] AS letter FROM conversations")
def a28(spark, d):
    c = read(spark, d, "conversations")
    items = F.to_json(F.split("text", " "))
    return c.select("conv_id", "turn", F.explode(F.from_json(items, "array<string>")).alias("i")).select("conv_id", "turn", F.substring("i", 1, 1).alias("letter"))


@query("a29_staged_sources", "SELECT pin, ordinal, key FROM (SELECT 0 AS pin, row_number() OVER (ORDER BY s_suppkey) - 1 AS ordinal, s_name AS key FROM supplier UNION ALL SELECT 1, row_number() OVER (ORDER BY n_nationkey) - 1, n_name FROM nation)")
def a29(spark, d):
    a = sharding.ordinals(read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("key")), ["s_suppkey"]).select(F.lit(0).alias("pin"), "ordinal", "key")
    b = sharding.ordinals(read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("key")), ["n_nationkey"]).select(F.lit(1).alias("pin"), "ordinal", "key")
    return a.unionByName(b)


def _chain(spark, d):
    chain = storage.Chain(spark, storage.scratch(spark))
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for i, status in enumerate(("F", "O", "P")):
        chain.publish(o.where(F.col("o_orderstatus") == status), i)
    return chain


@query("b1_publish_generations", "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS sequence, count(*) AS n FROM orders GROUP BY 1")
def b1(spark, d):
    return _chain(spark, d).read().groupBy(F.col("sequence").cast("int").alias("sequence")).agg(F.count("*").alias("n"))


@query("b2_read_up_to", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')")
def b2(spark, d):
    return _chain(spark, d).read(upto=2).select("o_orderkey")


@query("b7_partitioned_sink", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def b7(spark, d):
    path = storage.scratch(spark)
    storage.write_partitioned(read(spark, d, "customer").select("c_custkey", "c_mktsegment").repartition("c_mktsegment"), path, "c_mktsegment")
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("b9_compaction_compare", "SELECT 0 AS differing")
def b9(spark, d):
    chain = _chain(spark, d)
    compact = storage.scratch(spark)
    chain.read().write.parquet(compact)
    return C.both_ways(chain.read(), spark.read.parquet(compact)).agg(F.count("*").cast("int").alias("differing"))


@query("a5_content_digest", "SELECT p_brand, count(*) AS n, min(sha256(p_name)) AS low FROM part GROUP BY 1")
def a5(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min(F.sha2(F.col("p_name").cast("binary"), 256)).alias("low"))


@query("a6_source_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01'")
def a6(spark, d):
    return read(spark, d, "orders").where(F.col("o_orderdate") < F.expr("timestamp_ntz'1995-03-01 00:00:00'")).select("o_orderkey", "o_custkey")
