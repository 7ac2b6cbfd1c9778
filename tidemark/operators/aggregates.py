"""Counts, histograms, heat maps and extents: one scan and one partial/final aggregation each."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.binning import bin_index, bin_start, nice_bins, time_bins
from tidemark.operators.filters import Brushes, brushed, crossfiltered, in_domain
from tidemark.spec import Dimension, Interval, View, View1D, View2D

#: Cells of a dense grid that may be joined by broadcast.
BROADCAST_CELLS = 1_000_000


def grid(df: DataFrame, **axes: tuple[int, int]) -> DataFrame:
    """All combinations of integer ranges [first, last], as int columns: one range, taken apart by division."""
    sizes = [last - first + 1 for first, last in axes.values()]
    cells = df.sparkSession.range(math.prod(sizes))
    columns, below = [], math.prod(sizes)
    for (name, (first, _)), size in zip(axes.items(), sizes, strict=True):
        below //= size
        columns.append((F.expr(f"(id div {below}) % {size}") + first).cast("int").alias(name))
    return cells.select(*columns)


def dense(counts: DataFrame, cells: int, keys: list[str], **axes: tuple[int, int]) -> DataFrame:
    """counts with a row of zeros for every cell of the grid that it lacks; its value columns stay long."""
    values = [c for c in counts.columns if c not in keys]
    small = F.broadcast(counts) if cells <= BROADCAST_CELLS else counts  # at most a row for each cell
    return grid(counts, **axes).join(small, keys, "left").select(*keys, *(F.coalesce(v, F.lit(0).cast("long")).alias(v) for v in values))


def extent(df: DataFrame, dimension: Dimension) -> DataFrame:
    """(low, high) of the finite values; nulls for an empty table."""
    v = dimension.value()
    finite = (~F.isnan(v)) & (F.abs(v) < F.lit(float("inf")))
    return df.where(finite).agg(F.min(v).alias("low"), F.max(v).alias("high"))


def with_bins(df: DataFrame, dimension: Dimension, domain: Interval | None = None) -> Dimension:
    """The dimension with its bins chosen: from domain, its extent, or the data."""
    span = domain or dimension.extent
    if span is None:
        row = extent(df, dimension).first()
        span = (row["low"], row["high"]) if row["low"] is not None else (0.0, 1.0)
    return replace(dimension, config=(time_bins if dimension.time else nice_bins)(dimension.bins, span))


def row_count(df: DataFrame, brushes: Brushes | None = None, dimensions: Mapping[str, Dimension] | None = None, closed: bool = False) -> DataFrame:
    """(no_brush, value): all rows, and those within the brushes."""
    keep = brushed(brushes or {}, dimensions or {}, closed=closed)
    return df.agg(F.count("*").alias("no_brush"), F.count_if(keep).alias("value"))


def histogram(df: DataFrame, view: View1D, brushes: Brushes | None = None, dimensions: Mapping[str, Dimension] | None = None, closed: bool = False) -> DataFrame:
    """(key, key_start, no_brush, value) of every bin, from one scan; the view's own brush does not filter it."""
    d = view.dimension
    n = d.config.count
    keep = crossfiltered(view, brushes or {}, dimensions or {}, closed=closed)
    binned = df.where(in_domain(view, closed, df.schema)).select(bin_index(d.value(), d.config).alias("key"), keep.alias("keep"))
    counts = binned.groupBy("key").agg(F.count("*").alias("no_brush"), F.count_if("keep").alias("value"))
    return dense(counts, n, ["key"], key=(0, n - 1)).select("key", bin_start(F.col("key"), d.config).alias("key_start"), "no_brush", "value")


def heatmap(df: DataFrame, view: View2D, brushes: Brushes | None = None, dimensions: Mapping[str, Dimension] | None = None, closed: bool = False) -> DataFrame:
    """(key_x, key_y, x_start, y_start, no_brush, value) of every cell, from one scan."""
    nx, ny = view.x.config.count, view.y.config.count
    keep = crossfiltered(view, brushes or {}, dimensions or {}, closed=closed)
    binned = df.where(in_domain(view, closed, df.schema)).select(bin_index(view.x.value(), view.x.config).alias("key_x"), bin_index(view.y.value(), view.y.config).alias("key_y"), keep.alias("keep"))
    counts = binned.groupBy("key_x", "key_y").agg(F.count("*").alias("no_brush"), F.count_if("keep").alias("value"))
    full = dense(counts, nx * ny, ["key_x", "key_y"], key_x=(0, nx - 1), key_y=(0, ny - 1))
    return full.select("key_x", "key_y", bin_start(F.col("key_x"), view.x.config).alias("x_start"), bin_start(F.col("key_y"), view.y.config).alias("y_start"), "no_brush", "value")


def shown(df: DataFrame, view: View, brushes: Brushes, dimensions: Mapping[str, Dimension], closed: bool = False) -> DataFrame:
    """The chart data of any view."""
    if isinstance(view, View1D):
        return histogram(df, view, brushes, dimensions, closed)
    if isinstance(view, View2D):
        return heatmap(df, view, brushes, dimensions, closed)
    return row_count(df, brushes, dimensions, closed)


def series(data: DataFrame, show_base: bool = True) -> DataFrame:
    """Chart data as a row for each key and series: "brushed", and "base" unless it is hidden."""
    keys = [c for c in data.columns if c not in ("no_brush", "value")]
    named = [("brushed", "value"), *([("base", "no_brush")] if show_base else [])]
    return data.select(*keys, F.inline(F.array(*(F.struct(F.lit(n).alias("series"), F.col(c).alias("rows")) for n, c in named))))


def in_order(data: DataFrame) -> DataFrame:
    """Chart data by its keys, as charts draw it: of a result of any operator here, whose rows are as many as bins."""
    keys = [c for c in ("brush", "pixel", "pixel_x", "pixel_y", "key", "key_x", "key_y") if c in data.columns]
    return data.orderBy(*keys) if keys else data


def described(df: DataFrame, *columns: str) -> DataFrame:
    """(name, n, mean, std, low, q25, median, q75, high) of numeric columns (all of them if none are named), from one scan.

    Quartiles are approximate to a ten-thousandth of the rows; nulls are left out.
    """
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    names = columns or [n for n, t in df.dtypes if t.split("(")[0] in numeric]
    if not names:
        return df.sparkSession.createDataFrame([], "name string, n bigint, mean double, std double, low double, q25 double, median double, q75 double, high double")

    def of(name: str) -> Column:
        v = F.col(f"`{name}`").cast("double")
        q = F.percentile_approx(v, [0.25, 0.5, 0.75], 10_000)
        parts = {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "low": F.min(v), "q25": q[0], "median": q[1], "q75": q[2], "high": F.max(v)}
        return F.struct(F.lit(name).alias("name"), *(c.alias(k) for k, c in parts.items()))

    return df.agg(F.array(*(of(n) for n in names)).alias("all")).select(F.inline("all"))


def normalized(hist: DataFrame, value: str = "value", total: str = "share") -> DataFrame:
    """A histogram's values as shares of their sum; null where the sum is 0. Charts have few bins: the window has one partition."""
    return hist.withColumn(total, F.try_divide(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy())))


def normalized_cumulative(hist: DataFrame, key: str = "key", value: str = "value", total: str = "share") -> DataFrame:
    """Running sums over the last of them."""
    running = F.sum(value).over(Window.partitionBy().orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumn(total, F.try_divide(running.cast("double"), F.sum(value).over(Window.partitionBy())))


def scale_top(data: DataFrame) -> DataFrame:
    """(top): the largest of both series, by which a chart is scaled."""
    return data.agg(F.greatest(F.max("no_brush"), F.max("value")).alias("top"))


def masked(df: DataFrame, predicate: Column, name: str = "excluded") -> DataFrame:
    """df with a flag for the rows that a filter leaves out (nulls of the predicate are left out too)."""
    return df.withColumn(name, ~F.coalesce(predicate, F.lit(False)))
