"""Mappers of held, encoded, cross-checked and inferred rows, over driver tables in their shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import provider_mappers  # noqa: F401 -- registers its mappers
from tidemark.operators.mappers import apply_mapper
from tidemark.plans.inputs import BARS, HOUR, bars, micros, read
from tidemark.plans.registry import query

AS_OF = "2024-06-30"


def _day(name: str) -> Column:
    return F.col(name).cast("date")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _json(**fields: Column) -> Column:
    """JSON text from parts that are JSON already; a null part leaves its field out."""
    parts = [F.concat(F.lit(f'"{n}":'), c) for n, c in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quote(c: Column | str) -> Column:
    return F.concat(F.lit('"'), _text(c), F.lit('"'))


@query(
    "k1_declared_sessions",
    """WITH s AS (SELECT o_orderpriority AS venue, CASE WHEN o_custkey % 2 = 0 THEN 'Asia/Seoul' ELSE 'America/New_York' END AS zone, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k,
  CASE o_orderkey % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'holiday' ELSE 'open' END AS status FROM orders),
t AS (SELECT *, status = 'open' AND k % 7 <> 0 AS is_open, epoch_us(timezone(zone, day + INTERVAL 9 HOUR)) AS a, epoch_us(timezone(zone, day + INTERVAL 16 HOUR)) AS z,
  epoch_us(CAST(day AS TIMESTAMP)) + (k % 40) * 3600000000 AS declared, epoch_us(timezone(zone, CAST(day + 1 AS TIMESTAMP))) - 1 AS ends FROM s)
SELECT venue, day, CASE WHEN is_open THEN 'open' WHEN status = 'closed' THEN 'closed' END AS status, CASE WHEN is_open THEN a END AS open_us, CASE WHEN is_open THEN z END AS close_us,
  CASE WHEN is_open THEN least(declared, z) WHEN status = 'closed' THEN least(declared, ends) END AS public_us FROM t""",
)
def declared(spark, d):
    k, day = F.col("o_orderkey"), _day("o_orderdate")
    at = lambda h: F.expr(f"CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP_NTZ) + INTERVAL {h} HOUR")
    status = F.when(k % 5 == 0, "closed").when(k % 5 == 1, "holiday").otherwise("open")
    s = read(spark, d, "orders").select(
        F.col("o_orderpriority").alias("venue"), F.when(F.col("o_custkey") % 2 == 0, "Asia/Seoul").otherwise("America/New_York").alias("zone"), day.alias("day"), status.alias("status"),
        F.when(status != "closed", at(9)).alias("opens"), F.when(status != "closed", F.when(k % 7 == 0, at(8)).otherwise(at(16))).alias("closes"),
        (micros("CAST(o_orderdate AS DATE)") + (k % 40) * HOUR).alias("declared"),
    )
    return apply_mapper("calendar.declared@1", s)


def _responses(spark, d) -> DataFrame:
    """A base64 JSON response an order, its line items as statement lines."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    number = F.concat(F.date_format(_day("o_orderdate"), "yyyyMMdd"), F.lpad(_text("o_orderkey"), 6, "0"))
    sheet = F.when(F.col("l_returnflag") == "A", "BS").when(F.col("l_returnflag") == "N", "IS").otherwise("CIS")
    line = F.struct(
        sheet.alias("sheet"), F.col("l_linestatus").alias("account"), _text("l_linenumber").alias("ord"), number.alias("accession"),
        _text(F.col("l_quantity").cast("decimal(12,2)")).alias("term"), F.when(F.col("l_linenumber") > 2, _text(F.col("l_linenumber") * 10)).alias("added"),
    )
    k = F.col("o_orderkey")
    report = F.when(k % 4 == 0, "11011").when(k % 4 == 1, "11013").when(k % 4 == 2, "11012").otherwise("11014")
    per = li.join(o, F.col("l_orderkey") == k).groupBy(k, "o_custkey", "o_orderdate").agg(F.collect_list(line).alias("lines"))
    body = F.to_json(F.struct(F.when(k % 9 == 0, "failed").otherwise("completed").alias("outcome"), _text(F.year("o_orderdate")).alias("year"), report.alias("report"), "lines"))
    return per.select(F.col("o_custkey").alias("token"), k.alias("receipt"), F.base64(body.cast("binary")).alias("body"))


@query(
    "k1_encoded_statements",
    """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 4 AS r, year(o_orderdate) AS y, CASE l_returnflag WHEN 'A' THEN 'BS' WHEN 'N' THEN 'IS' ELSE 'CIS' END AS sheet, l_quantity AS term,
  CASE WHEN l_linenumber > 2 THEN l_linenumber * 10.0 END AS added, row_number() OVER (PARTITION BY o_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber) AS occurrence,
  CASE o_orderkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 9 END AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 9 <> 0),
e AS (SELECT *, 'term' AS span, CAST(term AS DOUBLE) AS value, sheet <> 'BS' AS q FROM x UNION ALL SELECT *, 'cumulative', CAST(added AS DOUBLE), FALSE FROM x WHERE sheet <> 'BS' AND r IN (2, 3) AND added IS NOT NULL)
SELECT sheet, span, CASE WHEN r = 0 THEN 'FY' WHEN r = 1 THEN 'Q1' WHEN r = 2 THEN CASE WHEN q THEN 'Q2' ELSE 'H1' END ELSE CASE WHEN q THEN 'Q3' ELSE '9M' END END AS fiscal_period,
  make_date(y, m, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS period_end, min(CASE WHEN sheet = 'BS' THEN NULL WHEN q AND r <> 0 THEN make_date(y, m - 2, 1) ELSE make_date(y, 1, 1) END) AS period_start,
  count(*) AS n, CAST(sum(occurrence) AS BIGINT) AS places, round(sum(value), 2) AS total FROM e GROUP BY 1, 2, 3, 4""".replace("make_date(y, m, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY", "last_day(make_date(y, m, 1))"),
)
def encoded(spark, d):
    rows = apply_mapper("statements.encoded@1", _responses(spark, d))
    return rows.groupBy("sheet", "span", "fiscal_period", "period_end").agg(
        F.min("period_start").alias("period_start"), F.count("*").alias("n"), F.sum(F.col("occurrence").cast("bigint")).alias("places"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total")
    )


@query("k1_response_filings", "SELECT o_custkey AS token, strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS accession, CASE o_orderkey % 4 WHEN 0 THEN '11011' WHEN 1 THEN '11013' WHEN 2 THEN '11012' ELSE '11014' END AS form, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def response_filings(spark, d):
    return apply_mapper("statements.filings@1", _responses(spark, d))


@query("k1_held_bars", "WITH j AS (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 <> 0) SELECT s_name AS token, value_state, count(*) AS n, count(day) AS dated, min(day) AS first FROM (SELECT *, 'invalid' AS value_state, CASE WHEN l_linenumber % 3 < 2 AND l_quantity <= 45 THEN CAST(l_shipdate AS DATE) END AS day FROM lineitem) LEFT JOIN j ON s_suppkey = l_suppkey GROUP BY 1, 2")
def held_bars(spark, d):
    n = F.col("l_linenumber")
    reason = F.when(n % 3 == 0, "invalid_price_or_volume").when(n % 3 == 1, "inconsistent_ohlc").otherwise("unknown_symbol")
    day = F.when(F.col("l_quantity") > 45, _quote(F.lit("n/a"))).otherwise(_quote(F.date_format("l_shipdate", "yyyy-MM-dd")))
    held = read(spark, d, "lineitem").select(_text("l_suppkey").alias("fingerprint"), reason.alias("reason"), _json(date=day, close=F.lit("0")).alias("row_json"))
    s = read(spark, d, "supplier").select(_text("s_suppkey").alias("fingerprint"), F.col("s_name").alias("symbol"))
    jobs = s.unionByName(s.where("fingerprint % 5 = 0"))
    return apply_mapper("bars.held@1", held, jobs=jobs).groupBy("token", "value_state").agg(F.count("*").alias("n"), F.count("day").alias("dated"), F.min("day").alias("first"))


def _bulk_rows(spark, d) -> DataFrame:
    k = F.col("event_id")
    price = _text(k % 100 + 1)
    whole = _json(
        code=_quote("event_type"), exchange=_quote(F.lit("US")), date=_quote(F.date_format("ts", "yyyy-MM-dd")), open=F.when(k % 6 == 1, _quote(price)).otherwise(price), high=F.lit("101.5"), low=F.lit("1"),
        close=price, volume=F.when(k % 4 != 0, F.lit("1e3")), adjusted_close=F.when(k % 10 == 0, "null").otherwise(price),
    )
    return read(spark, d, "events").select(F.when(k % 3 == 0, "duplicate").otherwise("partial_response").alias("reason"), F.when(k % 11 == 0, F.lit('{"code":')).otherwise(whole).alias("row_json"))


_BULK = "SELECT CASE WHEN event_id % 11 <> 0 THEN event_type || '.US' END AS token, {state} AS value_state, event_id % 3 <> 0 AS partial_response, count(*) AS n, count(CASE WHEN event_id % 3 <> 0 AND event_id % 11 <> 0 THEN 1 END) AS dated, CAST(sum({close}) AS DOUBLE) AS total FROM events GROUP BY 1, 2, 3"


def _bulk_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("token", "value_state", "partial_response").agg(F.count("*").alias("n"), F.count("day").alias("dated"), F.sum("close").alias("total"))


@query("k1_bulk_held", _BULK.format(state="CASE WHEN event_id % 11 = 0 OR event_id % 6 = 1 THEN 'invalid' WHEN event_id % 4 = 0 THEN 'partial' ELSE 'present' END", close="CASE WHEN event_id % 11 <> 0 THEN event_id % 100 + 1 END"))
def bulk_held(spark, d):
    return _bulk_sums(apply_mapper("bars.bulk_held@1", _bulk_rows(spark, d)))


@query("k1_bulk_held_adjusted", _BULK.format(state="CASE WHEN event_id % 11 = 0 THEN 'invalid' WHEN event_id % 10 = 0 THEN 'missing' ELSE 'present' END", close="CASE WHEN event_id % 11 <> 0 AND event_id % 10 <> 0 THEN event_id % 100 + 1 END"))
def bulk_held_adjusted(spark, d):
    return _bulk_sums(apply_mapper("bars.bulk_held_adjusted@1", _bulk_rows(spark, d)))


def _held_actions(spark, d, **fields: Column) -> DataFrame:
    text = _json(code=_quote("p_brand"), exchange=_quote(F.lit("US")), date=F.when(F.col("p_partkey") % 8 == 0, F.lit("20240102")).otherwise(_quote(F.lit("2024-01-02"))), **fields)
    return read(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, "duplicate").otherwise("partial_response").alias("reason"), text.alias("row_json"))


_HELD_DAY = "CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 8 <> 0 THEN DATE '2024-01-02' END AS day"


@query("k1_splits_held", f"SELECT p_brand || '.US' AS token, {_HELD_DAY}, CASE WHEN p_size % 5 > 0 THEN round((1 + p_partkey % 3) / (p_size % 5)::DOUBLE, 8) END AS ratio, CASE WHEN p_size % 5 > 0 THEN 'present' ELSE 'invalid' END AS value_state FROM part")
def splits_held(spark, d):
    ratio = F.concat(_text(1 + F.col("p_partkey") % 3), F.lit("/"), _text(F.col("p_size") % 5))
    return apply_mapper("splits.held@1", _held_actions(spark, d, split=_quote(ratio))).select("token", "day", F.round("ratio", 8).alias("ratio"), "value_state")


_PAID = "p_size % 4 <> 0 AND p_size % 6 <> 0 AND p_size % 7 <> 0 AND p_size % 9 <> 0"


@query("k1_dividends_held", f"SELECT p_brand || '.US' AS token, {_HELD_DAY}, CASE WHEN {_PAID} THEN p_size || '.25' END AS amount, CASE WHEN {_PAID} THEN 'USD' END AS currency, CASE WHEN {_PAID} THEN 'present' ELSE 'invalid' END AS value_state FROM part")
def dividends_held(spark, d):
    n = F.col("p_size")
    paid = F.when(n % 4 == 0, _quote(F.lit("-1"))).when(n % 6 == 0, F.lit("2.5")).when(n % 9 == 0, _quote(F.lit("0.00"))).otherwise(_quote(F.concat(_text(n), F.lit(".25"))))
    rows = _held_actions(spark, d, unadjusted=paid, currency=F.when(n % 7 == 0, _quote(F.lit("usd"))).otherwise(_quote(F.lit("USD"))))
    return apply_mapper("dividends.held@1", rows).select("token", "day", "amount", "currency", "value_state")


_REVISED = """WITH e AS (SELECT user_id AS token, event_id % 5 AS day, event_type AS kind, event_id % 3 AS amount, event_id // 2 AS moment FROM events),
t AS (SELECT DISTINCT token, day, kind FROM e GROUP BY token, day, kind, moment HAVING count(DISTINCT amount) > 1),
r AS (SELECT *, CASE WHEN amount = lag(amount) OVER (PARTITION BY token, day, kind ORDER BY moment, amount) THEN 0 ELSE 1 END AS new FROM e)
SELECT token, day, kind AS action_type, amount, CAST(sum(new) OVER (PARTITION BY token, day, kind ORDER BY moment, amount ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision, new FROM r WHERE (token, day, kind) NOT IN (SELECT (token, day, kind) FROM t)"""


@query("k1_actions_revised", f"SELECT token, day, action_type, amount, revision FROM ({_REVISED}) WHERE new = 1")
def actions_revised(spark, d):
    k = F.col("event_id")
    e = read(spark, d, "events").select(F.col("user_id").alias("token"), (k % 5).alias("day"), F.col("event_type").alias("action_type"), (k % 3).alias("amount"), F.floor(k / 2).alias("retrieved"))
    return apply_mapper("actions.revised@1", e).withColumn("revision", F.col("revision").cast("bigint"))


@query("k1_bars_revised", "WITH e AS (SELECT user_id AS token, event_id % 50 AS day, event_id % 3 AS v, event_id // 2 AS moment FROM events), r AS (SELECT *, v = lag(v) OVER (PARTITION BY token, day ORDER BY moment, v) AS same FROM e WHERE (token, day) NOT IN (SELECT (token, day) FROM (SELECT DISTINCT token, day FROM e GROUP BY token, day, moment HAVING count(DISTINCT v) > 1))) SELECT token, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM r WHERE same IS NOT TRUE GROUP BY 1")
def bars_revised(spark, d):
    k, v = F.col("event_id"), (F.col("event_id") % 3).cast("double")
    e = read(spark, d, "events").select(F.col("user_id").alias("token"), (k % 50).alias("day"), *[v.alias(c) for c in ("open", "high", "low", "close", "volume")], F.floor(k / 2).alias("retrieved"))
    return apply_mapper("bars.revised@1", e).groupBy("token").agg(F.count("*").alias("n"), F.sum("close").alias("total"))


@query("k1_dividends_next_session", f"WITH {BARS} SELECT token, day, 'present' AS value_state, amount FROM (SELECT instrument AS token, lead(day) OVER (PARTITION BY instrument ORDER BY day) AS day, CAST(n - 1 AS DOUBLE) AS amount FROM bars) WHERE amount <> 0 AND day IS NOT NULL")
def dividends_next(spark, d):
    b = bars(spark, d).select(F.col("instrument").alias("token"), "day", (F.col("n") - 1).cast("double").alias("amount"))
    return apply_mapper("dividends.next_session@1", b).select("token", "day", "value_state", "amount")


@query("k1_bars_float32", f"WITH {BARS} SELECT instrument AS token, 'adjusted' AS basis, 'present' AS value_state, count(*) AS n, max(CAST(CAST(CAST(close AS FLOAT) AS VARCHAR) AS DOUBLE)) AS high FROM bars GROUP BY 1")
def bars_float32(spark, d):
    m = apply_mapper("bars.float32@1", bars(spark, d).withColumnRenamed("instrument", "token"))
    return m.groupBy("token", "basis", "value_state").agg(F.count("*").alias("n"), F.max("close").alias("high"))


@query("k1_fx_pair_history", "SELECT 'USD' AS base, 'KRW' AS quote, epoch_us(timezone('America/New_York', CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP))) - 1 AS fixing_us, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN o_totalprice END AS rate, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 17 = 0 THEN 'invalid' ELSE 'present' END AS value_state FROM orders WHERE o_custkey % 3 = 0")
def fx_pair(spark, d):
    k = F.col("o_orderkey")
    close = F.when(k % 13 != 0, F.when(k % 17 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")))
    rows = read(spark, d, "orders").select(F.when(F.col("o_custkey") % 3 == 0, "USDKRW").otherwise("EURUSD").alias("symbol"), _day("o_orderdate").alias("day"), close.alias("close"))
    return apply_mapper("fx.pair_history@1", rows, pair="USDKRW", zone="America/New_York")


@query("k1_fx_checked_closes", "SELECT value_state, count(*) AS n, CAST(sum(CASE WHEN value_state = 'present' THEN o_custkey END) AS DOUBLE) AS total FROM (SELECT o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'invalid' WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 OR o_custkey <= 0 THEN 'invalid' ELSE 'present' END AS value_state FROM orders) GROUP BY 1")
def fx_checked(spark, d):
    k, none = F.col("o_orderkey"), F.col("o_orderkey") % 13 == 0
    day = F.when(k % 11 == 0, F.lit("2024-1-1")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    text = F.concat(_text(F.col("o_custkey") + F.when(k % 7 == 0, 1).otherwise(0)), F.lit(".0"))
    raw = _json(Date=_quote(day), Close=F.when(none, _quote(F.lit(""))).otherwise(_quote(text)))
    rows = read(spark, d, "orders").select(F.lit("USDKRW").alias("symbol"), _day("o_orderdate").alias("day"), F.when(~none, F.col("o_custkey").cast("double")).alias("close"), raw.alias("row_json"))
    return apply_mapper("fx.checked_closes@1", rows).groupBy("value_state").agg(F.count("*").alias("n"), F.sum(F.col("rate").cast("double")).alias("total"))


@query("k1_fx_series", "SELECT o_custkey AS token, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '1e3' ELSE o_custkey || '.5' END AS value, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'invalid' ELSE 'present' END AS value_state FROM orders")
def fx_series(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 9 == 0, ".").when(k % 5 == 0, "1e3").otherwise(F.concat(_text("o_custkey"), F.lit(".5")))
    return apply_mapper("fx.series@1", read(spark, d, "orders").select(F.col("o_custkey").alias("token"), _day("o_orderdate").alias("day"), text.alias("value")))


@query("k1_vintage_spans", "SELECT user_id AS token, CAST(ts AS DATE) AS day, CASE WHEN event_id % 9 <> 0 THEN '-' || event_id END AS value, CASE WHEN event_id % 9 = 0 THEN 'missing' ELSE 'present' END AS value_state, v AS vintage_start, lead(v) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY v) - 1 AS vintage_end FROM (SELECT *, DATE '2020-01-01' + CAST(event_id AS INTEGER) AS v FROM events)")
def vintage_spans(spark, d):
    k = F.col("event_id")
    rows = read(spark, d, "events").select(F.col("user_id").alias("token"), _day("ts").alias("day"), F.when(k % 9 == 0, ".").otherwise(F.concat(F.lit("-"), _text(k))).alias("value"), F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")).alias("vintage"))
    return apply_mapper("macro.vintage_spans@1", rows)


_PERIODS = ("2024", "2024-03", "2024-Q2", "2024-02-30", "2024-05-17", "20240101", "2024-13")
_PERIOD_DAYS = "CASE p_partkey % 7 WHEN 0 THEN DATE '2024-01-01' WHEN 1 THEN DATE '2024-03-01' WHEN 2 THEN DATE '2024-04-01' WHEN 4 THEN DATE '2024-05-17' {more} END"


def _period_text() -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in _PERIODS]), (F.col("p_partkey") % 7).cast("int") + 1)


@query("k1_macro_periods", f"SELECT p_partkey AS token, {_PERIOD_DAYS.format(more="WHEN 5 THEN DATE '2024-01-01'")} AS day, CASE WHEN p_partkey % 7 IN (3, 6) THEN 'invalid' ELSE 'present' END AS value_state FROM part")
def macro_periods(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("token"), _period_text().alias("period"), _text("p_size").alias("value"))
    return apply_mapper("macro.periods@1", rows).select("token", "day", "value_state")


@query("k1_composed_units", f"SELECT p_partkey AS token, {_PERIOD_DAYS.format(more='')} AS day, CASE WHEN p_size % 5 <> 0 THEN p_brand || CASE WHEN p_size % 3 = 0 THEN ';base=2020' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ';multiplier=6' ELSE '' END || ';regime=' || p_type END AS unit, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS VARCHAR) END AS value, CASE WHEN p_size % 4 = 0 THEN 'invalid' ELSE 'present' END AS value_state FROM part")
def composed_units(spark, d):
    n = F.col("p_size")
    rows = read(spark, d, "part").select(
        F.col("p_partkey").alias("token"), _period_text().alias("period"), F.when(n % 4 == 0, "n.a.").otherwise(_text(n)).alias("value"), F.when(n % 5 == 0, "").otherwise(F.col("p_brand")).alias("units"),
        F.when(n % 2 == 0, "6").otherwise("").alias("multiplier"), F.when(n % 3 == 0, "2020").alias("base_period"), F.col("p_type").alias("regime"),
    )
    return apply_mapper("macro.composed_units@1", rows)


@query("k1_classification_path", """SELECT CASE WHEN p_partkey % 6 <> 0 THEN 'ins-' || sha256('["tidemark-id-1","asset","' || p_partkey || '"]') END AS subject, CASE WHEN ok THEN concat_ws('/', l1, l2, l3) END AS code, CASE WHEN ok THEN coalesce(l3, l2, l1) END AS label, DATE '2024-06-30' AS effective_from FROM (SELECT *, coalesce(l1 <> '', FALSE) AND (l2 IS NULL OR l2 <> '') AND (l3 IS NULL OR (l3 <> '' AND l2 IS NOT NULL)) AS ok FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS l1, CASE WHEN p_size % 3 <> 0 THEN p_type END AS l2, CASE WHEN p_size % 2 = 0 THEN p_name END AS l3 FROM part))""")
def classification_path(spark, d):
    n, k = F.col("p_size"), F.col("p_partkey")
    rows = read(spark, d, "part").select(
        k.alias("token"), F.when(n % 5 == 0, "").otherwise(F.col("p_brand")).alias("level1"), F.when(n % 3 != 0, F.col("p_type")).alias("level2"), F.when(n % 2 == 0, F.col("p_name")).alias("level3"),
        F.lit("2000-01-01").cast("date").alias("first"), F.when(k % 6 == 0, F.lit("2024-07-01").cast("date")).alias("last"),
    )
    return apply_mapper("classification.path@1", rows, as_of=AS_OF)


@query("k1_industry_code", """SELECT CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 8 <> 0 THEN 'iss-' || sha256('["tidemark-id-1","cik","' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || '"]') END AS subject, CASE WHEN c_nationkey >= 10 THEN CAST(c_nationkey * 100 AS VARCHAR) END AS code, c_mktsegment AS label FROM customer WHERE c_custkey % 9 <> 0""")
def industry_code(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(
        F.concat(F.lit("CIK"), F.lpad(_text(k), 10, "0"), F.lit(".json")).alias("member"), _text(F.when(k % 5 == 0, k + 1).otherwise(k)).alias("cik"), _text(F.col("c_nationkey") * 100).alias("sic"),
        F.when(k % 9 == 0, "").otherwise(F.col("c_mktsegment")).alias("label"), F.when(k % 8 == 0, F.lit("2024-07-01").cast("date")).alias("latest"),
    )
    return apply_mapper("classification.industry_code@1", rows, as_of=AS_OF)


def _snapshots(spark, d) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("token"), F.col("o_orderpriority").alias("industry"), F.year("o_orderdate").alias("seen"))


@query("k1_industries_observed", "SELECT token, count(*) AS n, max(code) AS code FROM (SELECT o_custkey AS token, o_orderpriority AS code FROM orders) GROUP BY 1")
def industries(spark, d):
    return apply_mapper("classification.observed@1", _snapshots(spark, d)).groupBy("token").agg(F.count("*").alias("n"), F.max("code").alias("code"))


@query("k1_industries_once", "SELECT DISTINCT o_custkey AS token, o_orderpriority AS code, CAST(year(o_orderdate) AS INTEGER) AS seen FROM orders")
def industries_once(spark, d):
    return apply_mapper("classification.observed@2", _snapshots(spark, d))


@query("k1_observed_listings", "SELECT DISTINCT o_custkey AS token, 'listed' AS status, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, o_orderpriority AS seen FROM orders")
def observed_listings(spark, d):
    text = F.when(F.col("o_orderkey") % 4 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return apply_mapper("status.observed@1", read(spark, d, "orders").select(F.col("o_custkey").alias("token"), text.alias("listed_on"), F.col("o_orderpriority").alias("seen")))


@query("k1_vanished", """WITH s AS (SELECT o_custkey AS token, o_orderstatus = 'F' AS gone, CAST(date_trunc('year', o_orderdate) AS DATE) AS seen FROM orders), t AS (SELECT gone, max(seen) AS top FROM s GROUP BY 1),
g AS (SELECT token, bool_or(gone AND seen = top) AS lg, bool_or(NOT gone AND seen = top) AS live, bool_or(NOT gone) AS was, max(seen) AS seen FROM s JOIN t USING (gone) GROUP BY 1),
b AS (SELECT l_suppkey AS token, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1)
SELECT token, 'delisted' AS status, coalesce(last + 1, seen) AS day, CASE WHEN lg THEN 'observed' ELSE 'inferred' END AS evidence, last IS NULL AS unverified FROM g LEFT JOIN b USING (token) WHERE lg OR (was AND NOT live)""")
def vanished(spark, d):
    lists = read(spark, d, "orders").select(F.col("o_custkey").alias("token"), (F.col("o_orderstatus") == "F").alias("gone"), F.trunc(_day("o_orderdate"), "year").alias("seen"))
    return apply_mapper("status.vanished@1", lists, bars=read(spark, d, "lineitem").select(F.col("l_suppkey").alias("token"), _day("l_shipdate").alias("day")))


@query("k1_absent", """WITH s AS (SELECT o_orderpriority AS market, o_custkey AS token, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS seen FROM orders), t AS (SELECT max(seen) AS today FROM s),
p AS (SELECT market, max(seen) AS before FROM s, t WHERE seen < today AND market IN (SELECT market FROM s, t WHERE seen = today) GROUP BY 1),
b AS (SELECT l_suppkey AS token, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1),
g AS (SELECT DISTINCT token FROM s JOIN p USING (market) WHERE seen = before AND token NOT IN (SELECT token FROM s, t WHERE seen = today))
SELECT token, 'delisted' AS status, coalesce(last + 1, today) AS day, 'absent' AS evidence, last IS NULL AS unverified FROM g CROSS JOIN t LEFT JOIN b USING (token)""")
def absent(spark, d):
    lists = read(spark, d, "orders").select(F.col("o_orderpriority").alias("market"), F.col("o_custkey").alias("token"), F.trunc(_day("o_orderdate"), "quarter").alias("seen"))
    return apply_mapper("status.absent@1", lists, bars=read(spark, d, "lineitem").select(F.col("l_suppkey").alias("token"), _day("l_shipdate").alias("day")))


@query("k1_accepted_facts", """WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN epoch_us(o_orderdate) END AS accepted FROM orders)
SELECT l_suppkey AS token, l_returnflag AS tag, CASE WHEN l_linenumber % 3 = 0 THEN 'instant' ELSE 'P' || (l_linenumber * 30 + 1) || 'D' END AS span, CASE WHEN l_linenumber % 2 = 0 THEN 'missing' ELSE 'present' END AS value_state, count(*) AS n, count(accepted) AS accepted, max(accepted) AS latest FROM lineitem LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4""")
def accepted_facts(spark, d):
    n, day, k = F.col("l_linenumber"), _day("l_shipdate"), F.col("o_orderkey")
    facts = read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("token"), F.col("l_returnflag").alias("tag"), F.col("l_orderkey").alias("accession"), F.when(n % 3 != 0, F.date_sub(day, n * 30)).alias("start"), day.alias("stop"),
        F.when(n % 2 == 0, "").otherwise(_text(F.col("l_quantity").cast("decimal(12,2)"))).alias("value"),
    )
    o = read(spark, d, "orders").select(k.alias("accession"), F.when(k % 7 != 0, micros("o_orderdate")).alias("accepted"))
    again = o.where("accession % 5 = 0").withColumn("accepted", F.col("accepted") + 1)
    rows = apply_mapper("facts.accepted@1", facts, filings=o.unionByName(again))
    return rows.groupBy("token", "tag", "span", "value_state").agg(F.count("*").alias("n"), F.count("accepted").alias("accepted"), F.max("accepted").alias("latest"))


@query("k1_bars_text", "SELECT user_id AS token, CASE WHEN event_id % 7 = 0 THEN 'invalid' WHEN event_id % 5 = 0 THEN 'partial' ELSE 'present' END AS value_state, count(*) AS n FROM events GROUP BY 1, 2")
def bars_text(spark, d):
    k = F.col("event_id")
    price = _text(k % 90 + 1)
    rows = read(spark, d, "events").select(F.col("user_id").alias("token"), _day("ts").alias("day"), price.alias("open"), price.alias("high"), F.when(k % 7 == 0, "1,5").otherwise(price).alias("low"), price.alias("close"), F.when(k % 5 == 0, "").otherwise("10").alias("volume"))
    return apply_mapper("bars.text@1", rows).groupBy("token", "value_state").agg(F.count("*").alias("n"))


@query("k1_bars_reference", f"WITH {BARS} SELECT instrument AS token, price_role, count(*) AS n, max(close) AS high FROM (SELECT *, 'reference' AS price_role FROM bars) GROUP BY 1, 2")
def bars_reference(spark, d):
    m = apply_mapper("bars.reference@1", bars(spark, d).withColumnRenamed("instrument", "token"))
    return m.where("value_state = 'present' AND open IS NULL").groupBy("token", "price_role").agg(F.count("*").alias("n"), F.max("close").alias("high"))


@query("k1_dividends_amount", "SELECT s_name AS token, 'cash_dividend' AS action_type, CASE WHEN s_suppkey % 10 <> 0 THEN s_acctbal END AS amount, CASE WHEN s_suppkey % 10 = 0 THEN 'missing' WHEN s_acctbal > 0 THEN 'present' ELSE 'invalid' END AS value_state FROM supplier")
def dividends_amount(spark, d):
    rows = read(spark, d, "supplier").select(F.col("s_name").alias("token"), F.lit("2024-01-02").cast("date").alias("day"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_acctbal")).alias("amount"))
    return apply_mapper("dividends.amount@1", rows).select("token", "action_type", "amount", "value_state")


@query("k1_filings_submissions", "SELECT o_custkey AS token, o_orderkey AS accession, o_orderstatus AS form, CASE WHEN o_orderkey % 3 <> 0 THEN epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + (o_orderkey % 3) * 3600000000 END AS accepted_us FROM orders")
def submissions(spark, d):
    k = F.col("o_orderkey")
    at = F.expr("CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(o_orderkey % 3 AS INT), 0, 0)")
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("token"), k.alias("accession"), F.col("o_orderstatus").alias("form"), at.alias("accepted"))
    listed = apply_mapper("filings.submissions@1", rows.unionByName(rows.where("accession % 4 = 0")))
    return listed.select("token", "accession", "form", micros("accepted").alias("accepted_us"))
