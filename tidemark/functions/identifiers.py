"""Check digits of security identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(text: Column) -> Column:
    """Characters as numbers: 0-9, then A=10 ... Z=35; * @ # follow as 36 to 38."""
    return F.transform(F.regexp_extract_all(F.upper(text), F.lit("."), F.lit(0)), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"), c) - 1)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, b: a + b)


def _folded(x: Column) -> Column:
    return F.floor(x / 10).cast("int") + x % 10


def luhn(number: Column) -> Column:
    """Mod-10 with every second digit from the right doubled."""
    own = F.transform(F.regexp_extract_all(F.reverse(number), F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("int"))
    return _sum(F.transform(own, lambda d, i: F.when(i % 2 == 1, _folded(d * 2)).otherwise(d))) % 10 == 0


def isin_valid(text: Column) -> Column:
    """Two letters, nine alphanumerics and a Luhn digit over the expanded letters."""
    wide = F.array_join(F.transform(_digits(text), lambda d: d.cast("string")), "")
    return F.coalesce(text.rlike(r"\A[A-Z]{2}[A-Z0-9]{9}[0-9]\z") & luhn(wide), F.lit(False))


def _alternating(text: Column, length: int) -> Column:
    own = F.slice(_digits(text), 1, length)
    total = _sum(F.transform(own, lambda d, i: _folded(F.when(i % 2 == 1, d * 2).otherwise(d))))
    return (10 - total % 10) % 10


def cusip_valid(text: Column) -> Column:
    """Eight characters and their modulus-10 double-add-double digit."""
    good = text.rlike(r"\A[0-9A-Z*@#]{8}[0-9]\z")
    return F.coalesce(good & (_alternating(text, 8) == F.right(text, F.lit(1)).try_cast("int")), F.lit(False))


def figi_valid(text: Column) -> Column:
    """Twelve characters, G third, with the same digit over the first eleven."""
    good = text.rlike(r"\A[BCDFGHJKLMNPQRSTVWXYZ]{2}G[0-9BCDFGHJKLMNPQRSTVWXYZ]{8}[0-9]\z")
    return F.coalesce(good & (_alternating(text, 11) == F.right(text, F.lit(1)).try_cast("int")), F.lit(False))


def lei_valid(text: Column) -> Column:
    """Eighteen characters and two digits; the whole is 1 modulo 97."""
    rest = F.aggregate(_digits(text), F.lit(0), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)
    return F.coalesce(text.rlike(r"\A[A-Z0-9]{18}[0-9]{2}\z") & (rest == 1), F.lit(False))
