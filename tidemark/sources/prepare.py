"""Preparation of raw tables: names, types, missing values, times of day and scales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import hour_of_hhmm


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def filled(df: DataFrame, columns: Sequence[str], value: float = 0) -> DataFrame:
    return df.na.fill(value, list(columns))


def complete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in the columns (all of them by default)."""
    return df.na.drop(subset=list(columns) if columns else None)


def scaled(df: DataFrame, columns: Sequence[str], divisor: float = 10) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(divisor)) for c in columns})


def times_of_day(df: DataFrame, columns: Sequence[str], kind: str = "float") -> DataFrame:
    """Clock times such as 1430 as fractional hours; 2400 is 0."""
    return df.withColumns({c: hour_of_hhmm(F.col(c)).cast(kind) for c in columns})


def first_rows(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """The first rows in a given order."""
    return df.orderBy(*order).limit(rows)
