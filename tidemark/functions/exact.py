"""Exact decimals beyond Spark's arithmetic: Arrow batches of Python decimals.

DECIMAL(38,12) products and quotients lose digits in SQL, so values are computed here with 50
digits and rounded half to even at twelve places.
"""

from __future__ import annotations

import json
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(38, 12)
SCALE = Decimal("0.000000000001")


def exact(text: str | None) -> Decimal | None:
    """Decimal text to twelve places exactly; None where digits would be lost or it isn't one."""
    if text is None:
        return None
    with localcontext() as ctx:
        ctx.prec = 50
        try:
            value = Decimal(text)
            if not value.is_finite() or abs(value) >= Decimal(10) ** 26:
                return None
            out = value.quantize(SCALE, ROUND_HALF_EVEN)
        except InvalidOperation:
            return None
        return out if out == value else None


def shortest(value: float | None) -> Decimal | None:
    """A binary float by its shortest round-trip text."""
    return None if value is None or value != value else exact(repr(float(value)))


def scaled(value: Decimal | None, factor: Decimal | None) -> Decimal | None:
    """A product at 50 digits, half to even at twelve places."""
    if value is None or factor is None:
        return None
    with localcontext() as ctx:
        ctx.prec = 50
        return (value * factor).quantize(SCALE, ROUND_HALF_EVEN)


@F.pandas_udf(MONEY)
def exact_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: exact(t) if isinstance(t, str) else None)


@F.pandas_udf(MONEY)
def shortest_udf(value: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(value), index=value.index, dtype=object)
    live = value.notna()
    out[live] = [shortest(float(v)) for v in value[live]]
    return out


@F.pandas_udf(MONEY)
def scaled_udf(value: pd.Series, factor: pd.Series) -> pd.Series:
    return pd.Series([scaled(v, f) for v, f in zip(value, factor, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def float_hex_udf(value: pd.Series) -> pd.Series:
    """float.hex of a double, the two zeros alike."""
    return value.map(lambda v: None if v is None else (float(v) + 0.0).hex())


def plain_decimal(text: Column) -> Column:
    """Decimal text that SQL casts exactly: at most 26 digits before the point and 12 after."""
    return F.when(text.rlike(r"\A[+-]?[0-9]{1,26}(\.[0-9]{1,12})?\z"), text.try_cast(MONEY))


def exact_decimal(text: Column) -> Column:
    """``exact`` of any text: plain text in SQL, Python only for the rest (the plain reach it as null)."""
    plain = plain_decimal(text)
    return F.coalesce(plain, exact_udf(F.when(plain.isNull(), text)))


def shortest_decimal(value: Column) -> Column:
    """``shortest`` of any double. Where a decimal of four places below 10^10 rounds to the double,
    it is the shortest text, as two decimals of 15 digits never share a double; Python does the rest."""
    whole = F.rint(value * 10_000)
    plain = F.when((F.abs(value) < 1e10) & (whole / 10_000 == value), (whole.cast("bigint").cast("decimal(20,0)") * F.lit(Decimal("0.0001"))).cast(MONEY))
    return F.coalesce(plain, shortest_udf(F.when(plain.isNull(), value)))


def json_token_udf(field: str):
    """The text of a JSON number or string as written, which the SQL functions re-print."""

    @F.pandas_udf(T.StringType())
    def token(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                v = json.loads(t, parse_float=str, parse_int=str)
            except (TypeError, ValueError):
                return None
            v = v.get(field) if isinstance(v, dict) else None
            return v if isinstance(v, str) else None

        return text.map(one)

    return token
