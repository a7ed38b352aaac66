"""Versioned mappers from provider shapes to domain rows.

A mapper names the source columns it needs, its domain and one function from a DataFrame to
the domain's columns; ``apply_mapper`` checks the source first. Values stay text or exact
decimals until the promotion's own rules type them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import calendar as CAL
from tidemark.operators.asof import revision_runs
from tidemark.operators.quality import admitted, bar_state, decimal_state, finite

PRICES = ("token", "day", "basis", "open", "high", "low", "close", "volume", "value_state", "price_role")
ACTIONS = ("token", "day", "action_type", "ratio", "amount", "value_state")
POINTS = ("token", "day", "value", "value_state")


@dataclass(frozen=True)
class Mapper:
    """One mapping rule; ``expands`` if a source row may become several."""

    name: str
    version: int
    domain: str
    columns: tuple[str, ...]
    select: Callable[..., DataFrame]
    expands: bool = False


REGISTRY: dict[str, Mapper] = {}


def mapper(name: str, version: int, domain: str, columns: tuple[str, ...], expands: bool = False) -> Callable:
    """Register the decorated function as ``name@version``."""

    def keep(f: Callable[..., DataFrame]) -> Callable:
        REGISTRY[f"{name}@{version}"] = Mapper(name, version, domain, columns, f, expands)
        return f

    return keep


def apply_mapper(key: str, source: DataFrame, **given: DataFrame | str) -> DataFrame:
    """The mapped rows; a source without the columns is refused. ``given`` are the relations and
    options that the mapper reads beside its source."""
    m = REGISTRY[key]
    if missing := [c for c in m.columns if c not in source.columns]:
        raise ValueError(f"{key} needs {missing}")
    return m.select(source.select(*m.columns), **given)


def _bar(df: DataFrame, state: Column, basis: str, role: str = "primary") -> DataFrame:
    return df.withColumns({"basis": F.lit(basis), "value_state": state, "price_role": F.lit(role)}).select(*PRICES)


_OHLCV = ("token", "day", "open", "high", "low", "close", "volume")


@mapper("bars.typed", 1, "prices", _OHLCV)
def bars_typed(df: DataFrame) -> DataFrame:
    """Bars of doubles: present if all are finite, missing if all are null, else partial or invalid."""
    states = [F.when(F.col(c).isNull(), "missing").when(finite(F.col(c)), "present").otherwise("invalid") for c in _OHLCV[2:]]
    return _bar(df, bar_state(states), "unadjusted")


@mapper("bars.text", 1, "prices", _OHLCV)
def bars_text(df: DataFrame) -> DataFrame:
    """Bars of decimal text."""
    return _bar(df, bar_state([decimal_state(F.col(c)) for c in _OHLCV[2:]]), "unadjusted")


@mapper("bars.reference", 1, "prices", ("token", "day", "close"))
def bars_reference(df: DataFrame) -> DataFrame:
    """Adjusted closes as reference prices; the other prices are null."""
    none = {c: F.lit(None).cast("double") for c in ("open", "high", "low", "volume")}
    return _bar(df.withColumns(none), F.when(finite(F.col("close")), "present").otherwise("invalid"), "adjusted", "reference")


@mapper("bars.quarantined", 2, "prices", _OHLCV)
def bars_quarantined(df: DataFrame) -> DataFrame:
    """Held bars that prove clean after all."""
    return _bar(df.where(admitted()), F.lit("present"), "unadjusted")


@mapper("bars.revised", 1, "prices", (*_OHLCV, "retrieved"))
def bars_revised(df: DataFrame) -> DataFrame:
    """Repeated downloads as revisions: a bar counts again only where a value changed; moments
    with two answers are dropped."""
    runs = revision_runs(df, ["token", "day"], "retrieved", list(_OHLCV[2:])).where("not tied")
    return _bar(runs, F.lit("present"), "unadjusted")


@mapper("splits.ratio_text", 1, "corporate_actions", ("token", "day", "split"))
def splits_text(df: DataFrame) -> DataFrame:
    """Splits written new/old."""
    new, old = (F.split_part("split", F.lit("/"), F.lit(i)).try_cast("decimal(18,6)") for i in (1, 2))
    good = (new > 0) & (old > 0)
    ratio = F.when(good, new.cast("double") / old.cast("double"))
    return df.select("token", "day", F.lit("split").alias("action_type"), ratio.alias("ratio"), F.lit(None).cast("double").alias("amount"), F.when(good, "present").otherwise("invalid").alias("value_state"))


@mapper("dividends.amount", 1, "corporate_actions", ("token", "day", "amount"))
def dividends(df: DataFrame) -> DataFrame:
    """Cash dividends by ex-date."""
    state = F.when(F.col("amount").isNull(), "missing").when(finite(F.col("amount")) & (F.col("amount") > 0), "present").otherwise("invalid")
    return df.select("token", "day", F.lit("cash_dividend").alias("action_type"), F.lit(None).cast("double").alias("ratio"), "amount", state.alias("value_state"))


@mapper("capital.factor_steps", 1, "corporate_actions", ("token", "day", "factor"))
def capital_steps(df: DataFrame) -> DataFrame:
    """Ratio actions from a cumulative factor: a step where it moves by more than 1e-6."""
    w = W.partitionBy("token").orderBy("day")
    before = F.last("factor", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    moved = df.withColumn("_b", before).where((F.col("_b") > 0) & F.col("factor").isNotNull() & (F.abs(F.col("factor") / F.col("_b") - 1) > 1e-6))
    return moved.select("token", "day", F.lit("capital").alias("action_type"), (F.col("factor") / F.col("_b")).alias("ratio"), F.lit(None).cast("double").alias("amount"), F.lit("present").alias("value_state"))


@mapper("fx.series", 1, "fx_rates", ("token", "day", "value"))
@mapper("macro.vintages", 1, "macro_observations", ("token", "day", "value"))
def text_points(df: DataFrame) -> DataFrame:
    """Observations of decimal text; a lone dot is missing."""
    text = F.nullif("value", F.lit("."))
    return df.select("token", "day", text.alias("value"), decimal_state(text, signed=True).alias("value_state"))


@mapper("macro.periods", 1, "macro_observations", ("token", "period", "value"))
def period_points(df: DataFrame) -> DataFrame:
    """Observations dated by a period's text; unreadable periods are invalid."""
    day = CAL.period_date(F.col("period"))
    state = F.when(day.isNull(), "invalid").otherwise(decimal_state(F.col("value"), signed=True))
    return df.select("token", day.alias("day"), "value", state.alias("value_state"))


@mapper("status.listing", 1, "instrument_status", ("token", "first", "last", "gone"), expands=True)
def listing_status(df: DataFrame) -> DataFrame:
    """A listed event, and a delisted one the day after the last where it is gone."""
    events = F.array_compact(F.array(F.struct(F.lit("listed").alias("status"), F.col("first").alias("day")), F.when(F.col("gone"), F.struct(F.lit("delisted").alias("status"), F.date_add("last", 1).alias("day")))))
    return df.select("token", F.explode(events).alias("e")).select("token", "e.status", "e.day")


@mapper("classification.snapshot", 2, "classifications", ("token", "levels", "seen"))
def classifications(df: DataFrame) -> DataFrame:
    """The latest classification path of each token, content-first among equals."""
    path = F.concat_ws("/", "levels")
    rank = F.row_number().over(W.partitionBy("token").orderBy(F.desc("seen"), "path"))
    return df.withColumn("path", path).withColumn("_r", rank).where("_r = 1").select("token", "path", "seen")


@mapper("filings.submissions", 1, "filings", ("token", "accession", "form", "accepted"))
def filings(df: DataFrame) -> DataFrame:
    """One row a filing; an acceptance at midnight isn't a time and becomes null."""
    at = F.when(F.date_trunc("DAY", "accepted") != F.col("accepted"), F.col("accepted"))
    rank = F.row_number().over(W.partitionBy("token", "accession").orderBy("form", F.col("accepted").asc_nulls_last()))
    return df.withColumn("_r", rank).where("_r = 1").select("token", "accession", "form", at.alias("accepted"))


@mapper("statements.lines", 1, "fundamentals", ("token", "period", "line", "term", "cumulative"), expands=True)
def statement_lines(df: DataFrame) -> DataFrame:
    """Statement lines for the term and, where given, cumulative; repeated lines numbered."""
    w = W.partitionBy("token", "period", "line").orderBy("term", "cumulative")
    spans = F.array_compact(F.array(F.struct(F.lit("term").alias("span"), F.col("term").alias("value")), F.when(F.col("cumulative").isNotNull(), F.struct(F.lit("cumulative").alias("span"), F.col("cumulative").alias("value")))))
    return df.withColumn("occurrence", F.row_number().over(w)).select("token", "period", "line", "occurrence", F.explode(spans).alias("s")).select("token", "period", "line", "occurrence", "s.span", "s.value")
