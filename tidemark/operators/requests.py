"""Reads as one request: predicates, roles, clocks and flags in, heads out; row validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.temporal import project_heads

TESTS = {"=": lambda c, v: c == v, "<>": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(v)}


def day_of(micros: Column) -> Column:
    """The UTC day of a clock in microseconds, before 1970 too; null stays null."""
    return F.date_from_unix_date(F.floor(micros / F.lit(86_400_000_000)).cast("int"))


@dataclass(frozen=True)
class HeadRequest:
    """What a caller wants to know as of when.

    ``where`` holds (column, test, value). Those on ``natural`` columns, which no revision of a
    record changes, go below the ranking; all others hold for the projected head only.
    """

    cutoff: int
    ingestion: int | None = None
    where: tuple[tuple[str, str, object], ...] = ()
    natural: frozenset[str] = frozenset()
    roles: tuple[str, ...] | None = None
    ceiling: int | None = None
    keys: tuple[str, ...] = ("record_id",)
    flag_kinds: tuple[str, ...] = field(default=())

    def split(self) -> tuple[list[Column], list[Column]]:
        """Predicates for below and above the ranking."""
        made = [(c in self.natural, TESTS[test](F.col(c), value)) for c, test, value in self.where]
        return [p for early, p in made if early], [p for early, p in made if not early]


def read(rows: DataFrame, request: HeadRequest, flags: DataFrame | None = None, flag_key: str = "event_id") -> DataFrame:
    """Heads of ``rows`` for a request.

    ``flags`` (flag_key, kind) excludes flagged revisions: the distinct keys of the asked kinds
    are joined on, so a revision flagged often is still one row. Rows beyond the ceiling don't
    exist for the reader; rows of other roles don't either.
    """
    early, late = request.split()
    own = rows
    for p in early:
        own = own.where(p)
    if request.roles is not None:
        own = own.where(F.col("role").isin(*request.roles))
    if request.ceiling is not None:
        own = own.where(F.col("known").isNull() | (F.col("known") <= request.ceiling))
    excluded = None
    if flags is not None:
        asked = flags.where(F.col("kind").isin(*request.flag_kinds)) if request.flag_kinds else flags
        own = own.join(asked.select(flag_key).distinct().withColumn("_flagged", F.lit(True)), flag_key, "left")
        excluded = F.coalesce("_flagged", F.lit(False))
    heads = project_heads(own, request.cutoff, request.ingestion, keys=request.keys, excluded=excluded, role="role" if request.roles is None else None)
    for p in late:
        heads = heads.where(p)
    return heads.drop("_flagged")


def normalized(rows: DataFrame, kinds: dict[str, str], required: tuple[str, ...], checks: dict[str, Column]) -> DataFrame:
    """Text rows typed cell by cell, with ``fault``, the first rule that a row breaks, or null.

    Cells are trimmed and empty ones are null; then a cell that doesn't parse, a required one
    that is null, and the named checks on the typed columns count, in that order.
    """
    trimmed = rows.withColumns({c: F.when(F.trim(c) != "", F.trim(c)) for c in kinds})
    cells = {c: F.col(c).try_cast(kind) for c, kind in kinds.items()}
    typed = trimmed.withColumns({f"_{c}": cell for c, cell in cells.items()})
    faults = [F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNull(), f"unparsed:{c}") for c in kinds]
    faults += [F.when(F.col(f"_{c}").isNull(), f"missing:{c}") for c in required]
    out = typed.withColumn("_early", F.coalesce(*faults)).select(*[c for c in rows.columns if c not in kinds], *[F.col(f"_{c}").alias(c) for c in kinds], "_early")
    late = F.coalesce(*[F.when(broken, name) for name, broken in checks.items()]) if checks else F.lit(None).cast("string")
    return out.withColumn("fault", F.coalesce("_early", late)).drop("_early")


def layered(base: DataFrame, layers: list[dict[str, Column]]) -> DataFrame:
    """Projections on projections, so that a layer's expressions may use those before it."""
    for layer in layers:
        base = base.withColumns(layer)
    return base


def receipts(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Row count and order-independent content sum of each part: (by, n, checksum).

    The sum of 40-bit pieces of each encoded row's digest: repeated rows count, unlike with an
    exclusive or, and the sum combines before the shuffle.
    """
    cell = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~"))
    piece = F.conv(F.substring(F.md5(F.concat_ws("|", *[cell(c) for c in columns])), 1, 10), 16, 10).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(piece.cast("decimal(38,0)")).alias("checksum"))
