"""Bounded samples for the fit of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_SPACE = 1 << 30


def thinned(df: DataFrame, rows: int, total: int, *by: str) -> DataFrame:
    """The rows of df whose hash of the columns is small enough that about so many of total remain; a scan with a filter."""
    bar = _SPACE if total <= rows else max(1, int(_SPACE * (rows / total)))
    return df.where(F.pmod(F.xxhash64(*by), F.lit(_SPACE)) < bar)


def bounded(df: DataFrame, rows: int, *by: str, total: int | None = None) -> list[Row]:
    """At most so many different rows of df, those with the smallest hash of the columns, in that order.

    The scan is thinned before anything moves, so that what reaches the driver does not grow with the table; which rows
    they are depends on their values only. Copies of a row are one. total is the number of rows, or one not far above it,
    where that is cheaper to count.
    """
    kept = thinned(df, rows, df.count() if total is None else total, *by).distinct()
    return kept.orderBy(F.xxhash64(*by), *df.columns).limit(rows).collect()
