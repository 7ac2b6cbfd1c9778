"""Scalar functions of the data preparation and of charts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def hour_of_hhmm(value: Column) -> Column:
    """1430 -> 14.5. Text or numbers; 2400 is midnight."""
    text = F.lpad(value.cast("string"), 4, "0")
    number = F.when(text == "2400", F.lit(0)).otherwise(F.try_to_number(text, F.lit("9999")).cast("int"))
    return F.floor(number / F.lit(100)).cast("double") + F.pmod(number, F.lit(100)) / F.lit(60.0)


def absolute_magnitude(apparent: Column, parallax: Column) -> Column:
    """apparent + 5 log10(parallax) - 10; null where the parallax is not positive."""
    return apparent + F.lit(5.0) * F.log10(parallax) - F.lit(10.0)


def parsed_date(value: Column, *formats: str) -> Column:
    """The first of the formats that fits; null where none does."""
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)).cast("date") for f in formats))


def epoch_millis(value: Column) -> Column:
    """Milliseconds since 1970 of a date or timestamp."""
    return F.unix_millis(value.cast("timestamp"))


def compact(sql: str) -> str:
    """SQL text with runs of white space made one."""
    return re.sub(r"\s+", " ", sql).strip()


def repeat_visible(value: Column, order: Column, start: float, stop: float, partition: Column | None = None) -> Column:
    """A sequence whose elements out of [start, stop] take the last element within before them, or else the first after.

    The window has one partition unless one is given, so it suits short sequences such as the bins of a chart.
    """
    shown = F.when(value.between(start, stop), value)
    window = Window.partitionBy(partition if partition is not None else F.lit(0)).orderBy(order)
    before = F.last(shown, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(shown, ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(before, after)


def rows_of(df: DataFrame, *arrays: str) -> DataFrame:
    """A row for each position of array columns of equal length, with the values at it under the arrays' names."""
    zipped = F.arrays_zip(*(F.col(f"`{a}`").alias(a) for a in arrays))
    return df.select(F.inline(zipped)).toDF(*arrays)


def share(value: Column, base: Column) -> Column:
    """value / base; null for an empty base."""
    return F.try_divide(value.cast("double"), base.cast("double"))
