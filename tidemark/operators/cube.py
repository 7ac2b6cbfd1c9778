"""Cube slices: counts of a passive view by pixel of the active one, and their running sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.binning import bin_index, in_bins
from tidemark.operators.aggregates import dense
from tidemark.operators.filters import Brushes, conjunction, crossfiltered, in_domain
from tidemark.spec import CubeSlice, Dimension, View

#: Cells that a dense slice may have unless told otherwise.
MAX_CELLS = 20_000_000


def axis_names(count: int) -> tuple[str, ...]:
    return ("pixel",) if count == 1 else ("pixel_x", "pixel_y")


def key_names(view: View) -> tuple[str, ...]:
    return ((), ("key",), ("key_x", "key_y"))[len(view.dimensions)]


def pixel_columns(active: Sequence[Dimension], pixels: Sequence[int]) -> list[Column]:
    """The pixel of a row on each active axis from 1; 0 on every axis if it is outside on any."""
    fine = [(d.value(), d.config.resized(p)) for d, p in zip(active, pixels, strict=True)]
    within = conjunction(in_bins(v, c) for v, c in fine)
    return [F.when(within, bin_index(v, c) + 1).otherwise(F.lit(0)) for v, c in fine]


def key_columns(view: View) -> list[Column]:
    return [bin_index(d.value(), d.config).alias(k) for d, k in zip(view.dimensions, key_names(view), strict=True)]


def assemble(counts: DataFrame, pixels: Sequence[int], bins: Sequence[int], max_cells: int = MAX_CELLS) -> CubeSlice:
    """A slice from sparse counts (pixel axes, keys, cnt)."""
    axes, keys = axis_names(len(pixels)), ((), ("key",), ("key_x", "key_y"))[len(bins)]
    cells = math.prod(p + 1 for p in pixels) * math.prod(bins)
    if cells > max_cells:
        raise ValueError(f"a slice of {cells} cells; ask for fewer pixels or raise max_cells from {max_cells}")
    ranges = {a: (0, p) for a, p in zip(axes, pixels, strict=True)} | {k: (0, n - 1) for k, n in zip(keys, bins, strict=True)}
    full = dense(counts.where(F.col(axes[0]) > 0), cells, [*axes, *keys], **ranges)
    for axis in axes:
        window = Window.partitionBy(*(a for a in axes if a != axis), *keys).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        full = full.withColumn("cnt", F.sum("cnt").over(window))
    if keys:
        rolled = dense(counts.groupBy(*keys).agg(F.sum("cnt").alias("cnt")), math.prod(bins), list(keys), **{k: (0, n - 1) for k, n in zip(keys, bins, strict=True)})
    else:
        rolled = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0).cast("long")).alias("cnt"))
    return CubeSlice(tuple(pixels), tuple(bins), counts, full.withColumnRenamed("cnt", "cum"), rolled, axes, keys)


def build_slice(df: DataFrame, active: Sequence[Dimension], pixels: Sequence[int], passive: View, brushes: Brushes, dimensions: dict[str, Dimension], max_cells: int = MAX_CELLS, closed: bool = False) -> CubeSlice:
    """The slice of a passive view under one or two active dimensions.

    All brushes apply but those of the passive view's and the active dimensions. Rows outside the active domain, or null
    on it, count in no_brush alone. One scan and one partial/final aggregation give at most a row for each cell. closed
    lets rows at the upper ends of the brushes pass.
    """
    keys = key_names(passive)
    rows = df.where(crossfiltered(passive, brushes, dimensions, [d.name for d in active], closed, df.schema) & in_domain(passive, schema=df.schema))
    axes = axis_names(len(active))
    binned = rows.select(*(c.alias(a) for c, a in zip(pixel_columns(active, pixels), axes, strict=True)), *key_columns(passive))
    bins = [d.config.count for d in passive.dimensions]
    return assemble(binned.groupBy(*axes, *keys).agg(F.count("*").alias("cnt")), pixels, bins, max_cells)


def coarser(slice_: CubeSlice, pixels: Sequence[int], max_cells: int = MAX_CELLS) -> CubeSlice:
    """The slice at fewer pixels, from its counts and without the table; each count of pixels must divide the finer."""
    counts = slice_.counts
    for axis, fine, coarse in zip(slice_.axes, slice_.pixels, pixels, strict=True):
        if fine % coarse:
            raise ValueError(f"{fine} pixels do not make {coarse}")
        counts = counts.withColumn(axis, F.ceil(F.col(axis) / F.lit(fine // coarse)).cast("int"))
    counts = counts.groupBy(*slice_.axes, *slice_.keys).agg(F.sum("cnt").alias("cnt"))
    return assemble(counts, pixels, slice_.bins, max_cells)
