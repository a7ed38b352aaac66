"""Scalar functions of text, time, numbers, lists, JSON and digests, over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar as CAL
from tidemark.functions import hashing
from tidemark.operators.quality import finite
from tidemark.plans.inputs import micros, read
from tidemark.plans.registry import query


@query("h1_text_functions", r"""SELECT p_partkey, concat_ws('/', p_brand, nullif(p_type, p_brand), CASE WHEN p_size % 2 = 0 THEN p_name END) AS path, left(p_name, 3) || right(p_name, 2) AS ends, rtrim(p_size || '.500', '0') AS trimmed,
  repeat('x', p_size % 4) AS bars, replace(lower(p_brand), 'brand', chr(66)) AS swapped, contains(p_type, 'STEEL') AS steel, CAST(strlen(p_name || 'é') AS INTEGER) AS bytes,
  regexp_extract(p_size || '.25e-3', '([0-9]+)\.([0-9]+)e([-+]?)([0-9]+)', 4) AS exponent, regexp_extract(p_name, '([0-9]{9})', 1) AS none FROM part""")
def h1_text(spark, d):
    size = F.col("p_size").cast("string")
    number = F.concat(size, F.lit(".25e-3"))
    return read(spark, d, "part").select(
        "p_partkey", F.concat_ws("/", "p_brand", F.nullif("p_type", "p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_name"))).alias("path"),
        F.concat(F.left("p_name", F.lit(3)), F.right("p_name", F.lit(2))).alias("ends"), F.rtrim(F.concat(size, F.lit(".500")), F.lit("0")).alias("trimmed"),
        F.expr("repeat('x', p_size % 4)").alias("bars"), F.replace(F.lower("p_brand"), F.lit("brand"), F.char(F.lit(66))).alias("swapped"), F.contains("p_type", F.lit("STEEL")).alias("steel"),
        F.octet_length(F.concat("p_name", F.lit("é"))).alias("bytes"), F.regexp_extract(number, r"([0-9]+)\.([0-9]+)e([-+]?)([0-9]+)", 4).alias("exponent"), F.regexp_extract("p_name", "([0-9]{9})", 1).alias("none"),
    )


@query("h2_instants", """SELECT event_id, epoch_us(make_timestamp(epoch_us(ts))) AS us, CAST(timezone('Asia/Seoul', timezone('UTC', ts)) AS DATE) AS local_day, date_trunc('day', ts) = ts AS midnight, CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS INTEGER) AS span,
  CAST(try_strptime(CASE WHEN event_id % 3 = 0 THEN '20240230' ELSE '20240229' END, '%Y%m%d') AS DATE) AS compact, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'soon' ELSE '2024-05-06' END AS DATE) AS guarded,
  last_day(make_date(CAST(year(ts) AS BIGINT), 1 + event_id % 12, 1)) AS ends, CAST(ts AS DATE) + CASE dayofweek(CAST(ts AS DATE)) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS weekday FROM events""")
def h2_instants(spark, d):
    k, day = F.col("event_id"), F.col("ts").cast("date")
    us = micros("ts")
    step = F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1)
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), F.col("ts").cast("timestamp_ntz")).cast("date")
    return read(spark, d, "events").select(
        "event_id", F.unix_micros(F.timestamp_micros(us)).alias("us"), local.alias("local_day"), (F.col("ts").cast("date").cast("timestamp_ntz") == F.col("ts").cast("timestamp_ntz")).alias("midnight"),
        F.datediff(day, F.lit("2023-12-31").cast("date")).alias("span"), F.try_to_date(F.when(k % 3 == 0, "20240230").otherwise("20240229"), "yyyyMMdd").alias("compact"),
        F.when(k % 4 == 0, "soon").otherwise("2024-05-06").try_cast("date").alias("guarded"), CAL.month_end(F.make_date(F.year("ts"), (1 + k % 12).cast("int"), F.lit(1))).alias("ends"),
        F.date_add(day, step).alias("weekday"),
    )


@query("h3_numeric", """SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS distance, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS thousands, CAST(ceil(l_tax * 100 - 0.5) AS BIGINT) AS up, round(log2(l_quantity + 1), 9) AS bits, pow(2, l_linenumber) AS power,
  greatest(l_quantity, l_linenumber * 10) AS most, least(l_quantity, l_linenumber * 10) AS fewest, l_orderkey // nullif(l_linenumber - 1, 0) AS whole, l_orderkey % nullif(l_linenumber - 1, 0) AS rest,
  isfinite(CASE l_linenumber % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE ELSE l_quantity END) AS is_finite FROM lineitem""")
def h3_numeric(spark, d):
    n, ten = F.col("l_linenumber"), F.col("l_linenumber") * 10.0
    odd = F.when(n % 4 == 0, F.lit(float("nan"))).when(n % 4 == 1, F.lit(float("-inf"))).otherwise(F.col("l_quantity"))
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(F.col("l_quantity") - 25).alias("distance"), F.floor(F.col("l_extendedprice") / 1000).alias("thousands"), F.ceil(F.col("l_tax") * 100 - 0.5).alias("up"),
        F.round(F.log2(F.col("l_quantity") + 1), 9).alias("bits"), F.pow(F.lit(2.0), n).alias("power"), F.greatest("l_quantity", ten).alias("most"), F.least("l_quantity", ten).alias("fewest"),
        F.expr("l_orderkey div nullif(l_linenumber - 1, 0)").alias("whole"), F.expr("l_orderkey % nullif(l_linenumber - 1, 0)").alias("rest"), finite(odd).alias("is_finite"),
    )


@query("h4_lists", """WITH g AS (SELECT user_id, list_sort(list(event_id)) AS ids FROM events WHERE event_id % 3 <> 0 GROUP BY 1), u AS (SELECT DISTINCT e.user_id, CASE WHEN e.user_id % 5 = 0 THEN [NULL] ELSE ids END AS ids FROM events e LEFT JOIN g USING (user_id)),
x AS (SELECT user_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS place, list_contains(ids, user_id) AS own FROM u) SELECT user_id, id, CASE WHEN id IS NOT NULL THEN CAST(place AS INTEGER) END AS place, CASE WHEN id IS NOT NULL THEN own END AS own FROM x""")
def h4_lists(spark, d):
    """Positions of a list; users without one, and refused ones, keep a row of nulls."""
    e = read(spark, d, "events")
    ids = F.when(F.col("user_id") % 5 != 0, F.array_sort("held"))
    g = e.groupBy("user_id").agg(F.collect_list(F.when(F.col("event_id") % 3 != 0, F.col("event_id"))).alias("held")).select("user_id", ids.alias("ids"))
    return g.select("user_id", "ids", F.posexplode_outer("ids").alias("place", "id")).select("user_id", "id", (F.col("place") + 1).alias("place"), F.when(F.col("id").isNotNull(), F.array_contains("ids", F.col("user_id"))).alias("own"))


_DOC = """CASE event_id % 5 WHEN 0 THEN '{"k":' WHEN 1 THEN '{"k":"7","z":[1,2]}' WHEN 2 THEN '{"k":7}' WHEN 3 THEN '{"k":null}' ELSE '{"k":7.5,"z":[]}' END"""


@query("h5_json_types", f"""WITH e AS (SELECT event_id, {_DOC} AS doc FROM events), v AS (SELECT *, CASE WHEN json_valid(doc) THEN doc END AS j FROM e)
SELECT event_id, j IS NOT NULL AS valid, CASE json_type(j, '$.k') WHEN 'VARCHAR' THEN 'text' WHEN 'NULL' THEN 'null' WHEN 'UBIGINT' THEN 'whole' WHEN 'DOUBLE' THEN 'decimal' END AS kind, CAST(json_extract_string(j, '$.k') AS DOUBLE) AS k, CAST(json_array_length(j, '$.z') AS INTEGER) AS n FROM v""")
def h5_types(spark, d):
    e = read(spark, d, "events").select("event_id", F.try_parse_json(F.expr(_DOC)).alias("v"))
    kind = F.expr("schema_of_variant(variant_get(v, '$.k', 'variant'))")
    named = F.when(kind == "STRING", "text").when(kind == "VOID", "null").when(kind == "BIGINT", "whole").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "decimal")
    return e.select("event_id", F.col("v").isNotNull().alias("valid"), named.alias("kind"), F.expr("try_variant_get(v, '$.k', 'double')").alias("k"), F.expr("size(try_variant_get(v, '$.z', 'array<bigint>'))").alias("_n")).withColumn("n", F.when(F.col("_n") >= 0, F.col("_n"))).drop("_n")


@query("h6_encodings", """SELECT o_orderkey, hex(encode(o_orderpriority)) AS hexed, base64(encode(o_orderpriority)) AS coded, sha256('[["name","' || o_orderstatus || '"],["priority","' || o_orderpriority || '"]]') AS dimensions FROM orders""")
def h6_encodings(spark, d):
    p = F.col("o_orderpriority")
    pair = lambda n, c: F.concat(F.lit(f'["{n}",'), hashing.quoted(c), F.lit("]"))
    pairs = F.concat(F.lit("["), F.concat_ws(",", pair("name", F.col("o_orderstatus")), pair("priority", p)), F.lit("]"))
    back = F.unhex(F.hex(p.cast("binary"))).cast("string")
    return read(spark, d, "orders").select("o_orderkey", F.hex(p.cast("binary")).alias("hexed"), F.base64(back.cast("binary")).alias("coded"), F.sha2(pairs.cast("binary"), 256).alias("dimensions"))
