"""Charts and slices of all views from one scan."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binning import bin_index, bin_start
from tidemark.operators.aggregates import dense
from tidemark.operators.cube import MAX_CELLS, assemble, axis_names, key_names, pixel_columns
from tidemark.operators.filters import Brushes, brushed, crossfiltered, in_domain
from tidemark.spec import CubeSlice, Dimension, View


def fused_totals(df: DataFrame, views: Mapping[str, View], brushes: Brushes, dimensions: dict[str, Dimension], closed: bool = False) -> DataFrame:
    """(view, key_x, key_y, no_brush, value): sparse chart data of every view, all rows and those under the brushes.

    A row of the table becomes one entry for each view whose domain holds it, and entries are combined before the shuffle.
    """
    entries = []
    for name, view in views.items():
        keys = [bin_index(d.value(), d.config) for d in view.dimensions] + [F.lit(0)] * (2 - len(view.dimensions))
        keep = crossfiltered(view, brushes, dimensions, closed=closed)
        entries.append(F.when(in_domain(view, closed), F.struct(F.lit(name).alias("view"), keys[0].alias("key_x"), keys[1].alias("key_y"), keep.alias("keep"))))
    rows = df.select(F.explode(F.array(*entries)).alias("e")).where("e is not null")
    return rows.groupBy("e.view", "e.key_x", "e.key_y").agg(F.count("*").alias("no_brush"), F.count_if("e.keep").alias("value"))


def fused_charts(totals: DataFrame, views: Mapping[str, View]) -> dict[str, DataFrame]:
    """Each view's chart data out of fused_totals(), which callers persist or write first, as histogram() and the like give it."""
    out = {}
    for name, view in views.items():
        own, keys = totals.where(F.col("view") == name), key_names(view)
        if not keys:
            zero = F.lit(0).cast("long")
            out[name] = own.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("no_brush", "value")))
            continue
        bins = [d.config.count for d in view.dimensions]
        named = own.select(*(F.col(c).alias(k) for k, c in zip(keys, ("key_x", "key_y"), strict=False)), "no_brush", "value")
        full = dense(named, math.prod(bins), list(keys), **{k: (0, n - 1) for k, n in zip(keys, bins, strict=True)})
        starts = [bin_start(F.col(k), d.config).alias(f"{k}_start" if k == "key" else f"{k[-1]}_start") for k, d in zip(keys, view.dimensions, strict=True)]
        out[name] = full.select(*keys, *starts, "no_brush", "value")
    return out


def fused_counts(df: DataFrame, active: Sequence[Dimension], pixels: Sequence[int], views: Mapping[str, View], brushes: Brushes, dimensions: dict[str, Dimension], closed: bool = False) -> DataFrame:
    """(view, pixel axes, key_x, key_y, cnt): sparse counts of every view.

    A row of the table becomes one entry for each view whose filters it passes, and entries are combined before the
    shuffle, so the table is read once and what is shuffled is bounded by the cells. Brushes on dimensions that no view
    shows filter every view, so they filter the scan.
    """
    shown = {d.name for v in views.values() for d in v.dimensions} | {d.name for d in active}
    df = df.where(brushed(brushes, dimensions, shown, closed, df.schema))
    axes = axis_names(len(active))
    entries = []
    for name, view in views.items():
        keep = crossfiltered(view, brushes, dimensions, [d.name for d in active], closed) & in_domain(view)
        keys = [bin_index(d.value(), d.config) for d in view.dimensions] + [F.lit(0)] * (2 - len(view.dimensions))
        entries.append(F.when(keep, F.struct(F.lit(name).alias("view"), keys[0].alias("key_x"), keys[1].alias("key_y"))))
    rows = df.select(*(c.alias(a) for c, a in zip(pixel_columns(active, pixels), axes, strict=True)), F.explode(F.array(*entries)).alias("e")).where("e is not null")
    return rows.groupBy(F.col("e.view").alias("view"), *axes, F.col("e.key_x").alias("key_x"), F.col("e.key_y").alias("key_y")).agg(F.count("*").alias("cnt"))


def fused_slices(counts: DataFrame, pixels: Sequence[int], views: Mapping[str, View], max_cells: int = MAX_CELLS) -> dict[str, CubeSlice]:
    """Each view's slice out of fused_counts(), which callers persist or write first."""
    axes, out = axis_names(len(pixels)), {}
    for name, view in views.items():
        keys = key_names(view)
        own = counts.where(F.col("view") == name).select(*axes, *(F.col(c).alias(k) for k, c in zip(keys, ("key_x", "key_y"), strict=False)), "cnt")
        out[name] = assemble(own, pixels, [d.config.count for d in view.dimensions], max_cells)
    return out
