"""Counts that follow a stream, and the log of interactions."""

from __future__ import annotations

import time
from collections.abc import Mapping
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.binning import bin_index
from tidemark.functions.scalars import compact
from tidemark.operators.cube import key_columns, key_names, pixel_columns
from tidemark.operators.filters import Brushes, crossfiltered, in_domain
from tidemark.spec import Dimension, Interval, View, View1D


def live_histogram(stream: DataFrame, view: View1D, brushes: Brushes | None = None, dimensions: Mapping[str, Dimension] | None = None) -> DataFrame:
    """(key, no_brush, value) of a histogram over a stream; state is one row for each bin. For complete or update mode."""
    d = view.dimension
    keep = crossfiltered(view, brushes or {}, dimensions or {})
    rows = stream.where(in_domain(view)).select(bin_index(d.value(), d.config).alias("key"), keep.alias("keep"))
    return rows.groupBy("key").agg(F.count("*").alias("no_brush"), F.count_if("keep").alias("value"))


def windowed_histogram(stream: DataFrame, view: View1D, time_column: str, window: str, lateness: str) -> DataFrame:
    """(window, key, value) by event time; rows later than lateness behind the newest are dropped with their state."""
    d = view.dimension
    rows = stream.withWatermark(time_column, lateness).where(in_domain(view))
    return rows.groupBy(F.window(time_column, window), bin_index(d.value(), d.config).alias("key")).agg(F.count("*").alias("value"))


def live_counts(stream: DataFrame, active: list[Dimension], pixels: list[int], passive: View, brushes: Brushes, dimensions: Mapping[str, Dimension]) -> DataFrame:
    """Sparse cube counts over a stream, to be assembled into a slice from the sink; state is one row for each cell."""
    axes = ("pixel",) if len(active) == 1 else ("pixel_x", "pixel_y")
    rows = stream.where(crossfiltered(passive, brushes, dimensions, [d.name for d in active]) & in_domain(passive))
    binned = rows.select(*(c.alias(a) for c, a in zip(pixel_columns(active, pixels), axes, strict=True)), *key_columns(passive))
    return binned.groupBy(*axes, *key_names(passive)).agg(F.count("*").alias("cnt"))


class InteractionLog:
    """Brush changes as an append-only table; an instance is a session's logger.

    A change logs the brush that moved as active and repeats all others as inactive.
    """

    SCHEMA = "time timestamp, view string, dimension string, start double, end double, active boolean, action string"

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.brushes = spark, [], {}

    def __call__(self, view: str, moved: Mapping[str, Interval | None]) -> None:
        now = datetime.now(UTC)
        for dimension, interval in moved.items():
            action = "clear" if interval is None else "move" if dimension in self.brushes else "create"
            low, high = interval or (None, None)
            self.rows.append((now, view, dimension, low, high, True, action))
            if interval is None:
                self.brushes.pop(dimension, None)
            else:
                self.brushes[dimension] = interval
        for dimension, (low, high) in self.brushes.items():
            if dimension not in moved:
                self.rows.append((now, view, dimension, low, high, False, "keep"))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, self.SCHEMA)

    def by_dimension(self) -> DataFrame:
        """(dimension, action, changes, first, last) of the brushes that moved."""
        return self.table().where("active").groupBy("dimension", "action").agg(F.count("*").alias("changes"), F.min("time").alias("first"), F.max("time").alias("last"))


class QueryLog:
    """What was asked, how many rows came and how long it took."""

    SCHEMA = "time timestamp, query string, rows long, millis double"

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def run(self, query: str, df: DataFrame) -> pa.Table:
        """The rows of df, which are as few as a chart's, with an entry under the text of the query."""
        now, began = datetime.now(UTC), time.perf_counter()
        table = df.toArrow()
        self.rows.append((now, compact(query), table.num_rows, 1000 * (time.perf_counter() - began)))
        return table

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, self.SCHEMA)


def timed(action, log) -> object:
    """The result of action(); log gets the seconds that it took."""
    began = time.perf_counter()
    out = action()
    log(time.perf_counter() - began)
    return out
