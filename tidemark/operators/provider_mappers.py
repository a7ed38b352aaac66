"""Mappers of held, encoded, cross-checked and inferred provider rows.

They register beside the plain ones of ``mappers``. Some read a second relation (bars, jobs,
filings) or an option, which ``apply_mapper`` hands on by name. JSON is read as variants, so a
number is told from text that looks like one without leaving the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import period_date
from tidemark.functions.hashing import minted
from tidemark.operators.asof import revision_runs
from tidemark.operators.mappers import PRICES, mapper, splits_text
from tidemark.operators.quality import bar_state, decimal_state, finite

# Report code -> label of the quarter, label of the year to date, last month.
REPORTS = {"11013": ("Q1", "Q1", 3), "11012": ("Q2", "H1", 6), "11014": ("Q3", "9M", 9), "11011": ("FY", "FY", 12)}
INCOME_SHEETS = ("IS", "CIS")
CUMULATIVE_REPORTS = ("11012", "11014")
# Reasons for which a row is held.
PARTIAL = "partial_response"
HELD_INVALID = ("invalid_price_or_volume", "inconsistent_ohlc")

_VALUES = ("open", "high", "low", "close", "volume")
_ISO = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
_LINES = "outcome string, year string, report string, lines array<struct<sheet: string, account: string, ord: string, accession: string, term: string, added: string>>"


def instant(local: Column, zone: Column | str) -> Column:
    """Microseconds of a local wall time, whatever the session's zone."""
    at = F.convert_timezone(F.lit(zone) if isinstance(zone, str) else zone, F.lit("UTC"), local.cast("timestamp_ntz"))
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def day_end(day: Column, zone: Column | str) -> Column:
    """The local day's last microsecond."""
    return instant(F.date_add(day, 1), zone) - 1


def iso_day(text: Column) -> Column:
    """A date written YYYY-MM-DD, else null."""
    return F.when(text.rlike(_ISO), F.try_to_date(text, "yyyy-MM-dd"))


def _field(name: str, kind: str = "string", doc: str = "_v") -> Column:
    """A JSON field of the wanted kind; a field of the other kind is null."""
    stored = f"schema_of_variant(variant_get({doc}, '$.{name}', 'variant'))"
    test = f"{stored} = 'STRING'" if kind == "string" else f"{stored} RLIKE '{_NUMBER}'"
    return F.expr(f"CASE WHEN {test} THEN try_variant_get({doc}, '$.{name}', '{kind}') END")


def _absent(name: str) -> Column:
    """A field that well-formed JSON lacks or holds as null."""
    return F.expr(f"_v IS NOT NULL AND (variant_get(_v, '$.{name}', 'variant') IS NULL OR is_variant_null(variant_get(_v, '$.{name}', 'variant')))")


def _parsed(df: DataFrame, text: str = "row_json") -> DataFrame:
    return df.withColumn("_v", F.try_parse_json(F.col(text)))


def _state(x: Column, absent: Column) -> Column:
    return F.when(finite(x), "present").when(absent, "missing").otherwise("invalid")


@mapper("calendar.declared", 1, "calendar_sessions", ("venue", "zone", "day", "status", "opens", "closes", "declared"))
def declared_sessions(df: DataFrame) -> DataFrame:
    """Sessions from local wall times. An open day has both times, on the day and in order, a
    closed day neither; other rows have no status. A row is public when declared (microseconds),
    at the latest when the session, or the closed day, ends."""
    opens, closes = F.col("opens"), F.col("closes")
    ordered = (opens.cast("date") == F.col("day")) & (closes.cast("date") == F.col("day")) & (opens < closes)
    is_open = F.coalesce((F.col("status") == "open") & ordered, F.lit(False))
    is_closed = F.coalesce(F.col("status") == "closed", F.lit(False)) & opens.isNull() & closes.isNull()
    start, stop = instant(opens, F.col("zone")), instant(closes, F.col("zone"))
    public = F.when(is_open, F.least("declared", stop)).when(is_closed, F.least(F.col("declared"), day_end(F.col("day"), F.col("zone"))))
    return df.select(
        "venue", "day", F.when(is_open, "open").when(is_closed, "closed").alias("status"),
        F.when(is_open, start).alias("open_us"), F.when(is_open, stop).alias("close_us"), public.alias("public_us"),
    )


def _response(df: DataFrame) -> DataFrame:
    return df.withColumn("_r", F.from_json(F.unbase64("body").cast("string"), _LINES))


def _filed(accession: Column) -> Column:
    return F.when(accession.rlike(r"\A[0-9]{14}\z"), F.try_to_date(F.substring(accession, 1, 8), "yyyyMMdd"))


def _by_report(place: int) -> Column:
    return reduce(lambda c, r: c.when(F.col("report") == r, F.lit(REPORTS[r][place])), REPORTS, F.when(F.lit(False), F.lit(REPORTS["11011"][place])))


@mapper("statements.encoded", 1, "fundamentals", ("token", "receipt", "body"), expands=True)
def encoded_statements(df: DataFrame) -> DataFrame:
    """Lines of base64 JSON responses, for the term and, in half-year and third-quarter income
    statements, the year to date. Lines of one account are numbered in the provider's order."""
    r = _response(df).where("_r.outcome = 'completed'")
    lines = r.select("token", "receipt", "_r.year", "_r.report", F.posexplode("_r.lines").alias("place", "line")).select("token", "receipt", "year", "report", "place", "line.*")
    order = W.partitionBy("token", "receipt", "sheet", "account").orderBy(F.col("ord").try_cast("bigint").asc_nulls_last(), "place")
    income = F.col("sheet").isin(*INCOME_SHEETS)
    added = F.when(income & F.col("report").isin(*CUMULATIVE_REPORTS) & F.col("added").isNotNull(), F.struct(F.lit("cumulative").alias("span"), F.col("added").alias("amount")))
    both = F.array_compact(F.array(F.struct(F.lit("term").alias("span"), F.col("term").alias("amount")), added))
    each = lines.withColumn("occurrence", F.row_number().over(order)).withColumn("s", F.explode(both)).select("*", "s.span", "s.amount")
    month, year = _by_report(2), F.col("year").try_cast("int")
    quarter = income & (F.col("span") == "term")
    first = F.when(F.col("report") == "11011", 1).otherwise(month - 2)
    start = F.when(F.col("sheet") == "BS", None).when(quarter, F.make_date(year, first, F.lit(1))).otherwise(F.make_date(year, F.lit(1), F.lit(1)))
    state = decimal_state(F.col("amount"), signed=True)
    return each.select(
        "token", "receipt", "sheet", "account", "occurrence", "span", start.alias("period_start"), F.last_day(F.make_date(year, month, F.lit(1))).alias("period_end"),
        F.when(quarter, _by_report(0)).otherwise(_by_report(1)).alias("fiscal_period"), "accession", _filed(F.col("accession")).alias("filed"),
        F.when(state == "present", F.col("amount")).alias("value"), state.alias("value_state"),
    )


@mapper("statements.filings", 1, "filings", ("token", "receipt", "body"))
def response_filings(df: DataFrame) -> DataFrame:
    """One filing a completed response; its first line speaks for it."""
    r = _response(df).where("_r.outcome = 'completed' AND size(_r.lines) > 0")
    number = F.col("_r.lines")[0]["accession"]
    return r.select("token", number.alias("accession"), F.col("_r.report").alias("form"), _filed(number).alias("filed"))


def _bar_row(df: DataFrame, state: Column, basis: str, role: str = "primary") -> DataFrame:
    return df.withColumns({"basis": F.lit(basis), "value_state": state, "price_role": F.lit(role)})


@mapper("bars.held", 1, "prices", ("fingerprint", "reason", "row_json"))
def held_bars(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """Held history rows as invalid bars without values; the job's fingerprint names the symbol,
    if the manifest's ``jobs(fingerprint, symbol)`` names it once."""
    named = jobs.groupBy("fingerprint").agg(F.count("*").alias("_n"), F.min("symbol").alias("token")).where("_n = 1").drop("_n")
    rows = _parsed(df).join(named, "fingerprint", "left")
    day = F.when(F.col("reason").isin(*HELD_INVALID), iso_day(_field("date")))
    blank = {c: F.lit(None).cast("double") for c in _VALUES}
    return _bar_row(rows.withColumns({"day": day, **blank}), F.lit("invalid"), "unadjusted").select(*PRICES)


def _bulk(df: DataFrame, values: tuple[str, ...], adjusted: bool) -> DataFrame:
    part = F.col("reason") == PARTIAL
    rows = _parsed(df).withColumns({"token": F.concat(_field("code"), F.lit("."), _field("exchange")), "day": F.when(part, iso_day(_field("date")))})
    states = [_state(_field(c, "double"), _absent(c)) for c in values]
    close = _field("adjusted_close" if adjusted else "close", "double")
    numbers = {c: F.lit(None).cast("double") if adjusted else _field(c, "double") for c in _VALUES} | {"close": close}
    flagged = _bar_row(rows.withColumns(numbers), bar_state(states), "adjusted" if adjusted else "unadjusted", "reference" if adjusted else "primary")
    return flagged.select(*PRICES, F.coalesce(part, F.lit(False)).alias("partial_response"))


@mapper("bars.bulk_held", 1, "prices", ("reason", "row_json"))
def bulk_held(df: DataFrame) -> DataFrame:
    """Held rows of an exchange's daily download, flagged where the response was partial; only
    those have a day. Text in place of a number is invalid, an absent or null field missing."""
    return _bulk(df, _VALUES, adjusted=False)


@mapper("bars.bulk_held_adjusted", 1, "prices", ("reason", "row_json"))
def bulk_held_adjusted(df: DataFrame) -> DataFrame:
    """The same rows' adjusted closes as reference prices."""
    return _bulk(df, ("adjusted_close",), adjusted=True)


@mapper("splits.held", 1, "corporate_actions", ("reason", "row_json"))
def splits_held(df: DataFrame) -> DataFrame:
    """Held split rows read by the rule of the unheld ones."""
    day = F.when(F.col("reason") == PARTIAL, iso_day(_field("date")))
    return splits_text(_parsed(df).select(F.concat(_field("code"), F.lit("."), _field("exchange")).alias("token"), day.alias("day"), _field("split").alias("split")))


@mapper("dividends.held", 1, "corporate_actions", ("reason", "row_json"))
def dividends_held(df: DataFrame) -> DataFrame:
    """Held dividend rows: the unadjusted amount as text, present if positive and in a currency."""
    paid, money = _field("unadjusted"), _field("currency")
    good = F.coalesce((decimal_state(paid) == "present") & (paid.try_cast("double") > 0) & money.rlike(r"\A[A-Z]{3}\z"), F.lit(False))
    return _parsed(df).select(
        F.concat(_field("code"), F.lit("."), _field("exchange")).alias("token"), F.when(F.col("reason") == PARTIAL, iso_day(_field("date"))).alias("day"),
        F.lit("dividend").alias("action_type"), F.when(good, paid).alias("amount"), F.when(good, money).alias("currency"), F.when(good, "present").otherwise("invalid").alias("value_state"),
    )


@mapper("actions.revised", 1, "corporate_actions", ("token", "day", "action_type", "amount", "retrieved"))
def actions_revised(df: DataFrame) -> DataFrame:
    """Repeated downloads of actions as numbered revisions; keys with two answers at one moment go."""
    return revision_runs(df, ["token", "day", "action_type"], "retrieved", ["amount"]).where("not tied").select("token", "day", "action_type", "amount", F.col("run").alias("revision"))


@mapper("dividends.next_session", 1, "corporate_actions", ("token", "day", "amount"))
def dividends_next_session(df: DataFrame) -> DataFrame:
    """Dividends noted on the session before they go ex: the token's next day is the ex-date, and
    the last day, without a next one, isn't dated."""
    after = F.lead("day").over(W.partitionBy("token").orderBy("day"))
    state = F.when(finite(F.col("amount")) & (F.col("amount") > 0), "present").otherwise("invalid")
    return df.withColumn("ex", after).where("coalesce(amount, 0) <> 0 AND ex IS NOT NULL").select("token", F.col("ex").alias("day"), F.lit("dividend").alias("action_type"), "amount", state.alias("value_state"))


@mapper("bars.float32", 1, "prices", ("token", "day", *_VALUES))
def bars_float32(df: DataFrame) -> DataFrame:
    """Adjusted bars of single precision, widened by their shortest decimal text."""
    wide = {c: F.col(c).cast("float").cast("string").cast("double") for c in _VALUES}
    states = [_state(F.col(c), F.col(c).isNull()) for c in _VALUES]
    return _bar_row(df.withColumns(wide), bar_state(states), "adjusted", "reference").select(*PRICES)


@mapper("fx.pair_history", 1, "fx_rates", ("symbol", "day", "close"))
def fx_pair(df: DataFrame, pair: str, zone: str) -> DataFrame:
    """One pair's daily closes, fixed at the end of the local day."""
    state = F.when(F.col("close").isNull(), "missing").when(finite(F.col("close")) & (F.col("close") > 0), "present").otherwise("invalid")
    rate = F.when(state == "present", F.col("close"))
    return df.where(F.col("symbol") == pair).select(F.lit(pair[:3]).alias("base"), F.lit(pair[3:6]).alias("quote"), day_end(F.col("day"), zone).alias("fixing_us"), rate.alias("rate"), state.alias("value_state"))


@mapper("fx.checked_closes", 1, "fx_rates", ("symbol", "day", "close", "row_json"))
def fx_checked(df: DataFrame) -> DataFrame:
    """Closes whose source text says the same day and number; the text is the rate."""
    text = _field("Close")
    dated = F.coalesce(_field("Date") == F.date_format("day", "yyyy-MM-dd"), F.lit(False))
    agrees = F.coalesce((text.try_cast("double") == F.col("close")) & (F.col("close") > 0), F.lit(False))
    state = F.when(~dated, "invalid").when(F.col("close").isNull() & (decimal_state(text) == "missing"), "missing").when((decimal_state(text) == "present") & agrees, "present").otherwise("invalid")
    return _parsed(df).withColumns({"rate": text, "value_state": state}).select("symbol", "day", F.when(F.col("value_state") == "present", F.col("rate")).alias("rate"), "value_state")


@mapper("macro.vintage_spans", 1, "macro_observations", ("token", "day", "value", "vintage"))
def vintage_spans(df: DataFrame) -> DataFrame:
    """Observations with the span of vintages in which they stood; the latest is open."""
    after = F.lead("vintage").over(W.partitionBy("token", "day").orderBy("vintage"))
    text = F.nullif("value", F.lit("."))
    return df.select("token", "day", text.alias("value"), decimal_state(text, signed=True).alias("value_state"), F.col("vintage").alias("vintage_start"), F.date_sub(after, 1).alias("vintage_end"))


@mapper("macro.composed_units", 1, "macro_observations", ("token", "period", "value", "units", "multiplier", "base_period", "regime"))
def composed_units(df: DataFrame) -> DataFrame:
    """Observations dated by period text; the unit names its base, multiplier and regime."""
    extra = [F.when(F.col(c) != "", F.concat(F.lit(f";{label}="), F.col(c))) for c, label in (("base_period", "base"), ("multiplier", "multiplier"), ("regime", "regime"))]
    unit = F.when(F.col("units") != "", F.concat_ws("", "units", *extra))
    state = decimal_state(F.col("value"), signed=True)
    dated = F.when(~F.col("period").rlike(r"\A[0-9]{8}\z"), period_date(F.col("period")))
    return df.select("token", dated.alias("day"), unit.alias("unit"), F.when(state == "present", F.col("value")).alias("value"), state.alias("value_state"))


@mapper("classification.path", 1, "classifications", ("token", "level1", "level2", "level3", "first", "last"))
def classification_path(df: DataFrame, as_of: str) -> DataFrame:
    """A path of levels that are contiguous from the first; rows of after the day have no subject."""
    l1, l2, l3 = (F.col(f"level{i}") for i in (1, 2, 3))
    shaped = F.coalesce(l1 != "", F.lit(False)) & (l2.isNull() | (l2 != "")) & (l3.isNull() | ((l3 != "") & l2.isNotNull()))
    later = F.coalesce(F.col("first") > F.lit(as_of).cast("date"), F.lit(False)) | F.coalesce(F.col("last") > F.lit(as_of).cast("date"), F.lit(False))
    subject = F.when(~later, minted("ins-", "asset", F.col("token").cast("string")))
    return df.select(subject.alias("subject"), F.when(shaped, F.concat_ws("/", l1, l2, l3)).alias("code"), F.when(shaped, F.coalesce(l3, l2, l1)).alias("label"), F.lit(as_of).cast("date").alias("effective_from"))


@mapper("classification.industry_code", 1, "classifications", ("member", "cik", "sic", "label", "latest"))
def industry_code(df: DataFrame, as_of: str) -> DataFrame:
    """Four-digit industry codes of issuers whose padded number agrees with the archive member's."""
    number = F.substring("member", 4, 10)
    stated = F.col("member").rlike(r"\ACIK[0-9]{10}[.]json\z") & F.col("cik").rlike(r"\A[0-9]{1,10}\z") & (F.lpad("cik", 10, "0") == number)
    later = F.coalesce(F.col("latest") > F.lit(as_of).cast("date"), F.lit(False))
    return df.where("sic <> '' AND label <> ''").select(
        F.when(stated & ~later, minted("iss-", "cik", number)).alias("subject"), F.when(F.col("sic").rlike(r"\A[0-9]{4}\z"), F.col("sic")).alias("code"), "label",
    )


@mapper("classification.observed", 1, "classifications", ("token", "industry", "seen"))
def industries(df: DataFrame) -> DataFrame:
    """Every row of the snapshots."""
    return df.select("token", F.col("industry").alias("code"), "seen")


@mapper("classification.observed", 2, "classifications", ("token", "industry", "seen"))
def industries_once(df: DataFrame) -> DataFrame:
    """Each repeated row of the snapshots once."""
    return industries(df).distinct()


@mapper("status.observed", 1, "instrument_status", ("token", "listed_on", "seen"))
def observed_listings(df: DataFrame) -> DataFrame:
    """Listing days as the lists state them, repeated rows once."""
    return df.distinct().select("token", F.lit("listed").alias("status"), iso_day(F.col("listed_on")).alias("day"), "seen")


def _after_last_bar(gone: DataFrame, bars: DataFrame) -> DataFrame:
    """Delisted on the day after the token's last bar; unverified where it has none by then."""
    known = bars.join(gone.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.max("day").alias("_last"))
    return gone.join(known, "token", "left").select("token", F.lit("delisted").alias("status"), F.coalesce(F.date_add("_last", 1), F.col("seen")).alias("day"), "evidence", F.col("_last").isNull().alias("unverified"))


@mapper("status.vanished", 1, "instrument_status", ("token", "gone", "seen"), expands=True)
def vanished(df: DataFrame, bars: DataFrame) -> DataFrame:
    """Delistings from dated lists of live and gone tokens, read against ``bars(token, day)``: the
    latest gone list is observed; live once, but in neither latest list, is inferred."""
    tops = df.groupBy("gone").agg(F.max("seen").alias("_top"))  # two rows
    rows = df.join(F.broadcast(tops), "gone")
    by = rows.groupBy("token").agg(
        F.bool_or(F.col("gone") & (F.col("seen") == F.col("_top"))).alias("listed_gone"), F.bool_or(~F.col("gone") & (F.col("seen") == F.col("_top"))).alias("live"),
        F.bool_or(~F.col("gone")).alias("was_live"), F.max("seen").alias("seen"),
    )
    lost = by.where("listed_gone OR (was_live AND NOT live)").withColumn("evidence", F.when(F.col("listed_gone"), "observed").otherwise("inferred"))
    return _after_last_bar(lost, bars)


@mapper("status.absent", 1, "instrument_status", ("market", "token", "seen"), expands=True)
def absent(df: DataFrame, bars: DataFrame) -> DataFrame:
    """Delistings from whole-market lists: a token of a market's list before, and in no market's
    list of the latest day. Markets that have no list of the latest day tell nothing."""
    days = df.select("market", "seen").distinct()  # a row a list
    today = days.agg(F.max("seen").alias("_today"))  # one row
    before = days.join(F.broadcast(today), F.col("seen") < F.col("_today")).groupBy("market").agg(F.max("seen").alias("_before"))
    current = days.join(F.broadcast(today), F.col("seen") == F.col("_today")).select("market", "_today")
    rows = df.join(F.broadcast(today).withColumnRenamed("_today", "_t"), F.lit(True)).join(before.join(current, "market"), "market", "left")
    by = rows.groupBy("token").agg(F.bool_or(F.col("seen") == F.col("_t")).alias("now"), F.bool_or(F.col("seen") == F.col("_before")).alias("was"), F.max("_t").alias("seen"))
    return _after_last_bar(by.where("was AND NOT now").withColumn("evidence", F.lit("absent")), bars)


@mapper("facts.accepted", 1, "fundamentals", ("token", "tag", "accession", "start", "stop", "value"))
def accepted_facts(df: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts with their filing's acceptance, from ``filings(accession, accepted)``: an accession
    whose rows disagree, or of which one has no instant, gives none."""
    one = filings.groupBy("accession").agg(F.countDistinct("accepted").alias("_d"), F.count("accepted").alias("_k"), F.count("*").alias("_n"), F.min("accepted").alias("_a"))
    one = one.select("accession", F.when((F.col("_d") == 1) & (F.col("_k") == F.col("_n")), F.col("_a")).alias("accepted"))
    span = F.when(F.col("start").isNull(), "instant").otherwise(F.concat(F.lit("P"), (F.datediff("stop", "start") + 1).cast("string"), F.lit("D")))
    state = decimal_state(F.col("value"), signed=True)
    return df.join(one, "accession", "left").select("token", "tag", "accession", span.alias("span"), F.col("stop").alias("period_end"), F.when(state == "present", F.col("value")).alias("value"), state.alias("value_state"), "accepted")
