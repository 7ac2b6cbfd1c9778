"""Brushes answered from a cube slice, without the table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binning import ordered, snap
from tidemark.operators.aggregates import dense
from tidemark.spec import BinConfig, CubeSlice, Interval


def edges(interval: Interval, config: BinConfig, pixels: int, interpolate: bool = False) -> tuple[float, float]:
    """A brush in pixels of its dimension's domain: to the nearest edge, or fractions of pixels."""
    fine = config.resized(pixels)
    low, high = ordered(interval)
    if not interpolate:
        return snap(low, fine), snap(high, fine)
    return tuple(min(max((v - fine.start) / fine.step, 0.0), float(pixels)) for v in (low, high))


def screen_edges(interval: Interval, scale: float, size: float, flipped: bool = False) -> tuple[float, float]:
    """A brush in chart coordinates as pixels; y axes of charts grow downwards, so theirs are flipped."""
    found = [size - v / scale if flipped else v / scale for v in interval]
    return ordered((found[0], found[1]))


def _weights(low: float, high: float) -> dict[int, float]:
    """What each running sum counts for: +1 at the upper end, -1 at the lower, shared between neighbours."""
    out: dict[int, float] = {}
    for at, sign in ((high, 1), (low, -1)):
        base, part = math.floor(at), at - math.floor(at)
        for pixel, weight in ((base, 1 - part), (base + 1, part)):
            if weight:
                out[pixel] = out.get(pixel, 0) + sign * weight
    return {p: (int(w) if float(w).is_integer() else w) for p, w in out.items() if w}


def brushed_counts(slice_: CubeSlice, brush: Sequence[tuple[float, float]], truncate: bool = False) -> DataFrame:
    """(keys, value) of the passive view under a brush, given in pixels for each active axis.

    Whole pixels give exact counts (long); fractions interpolate between running sums (double, linear on each axis),
    truncate drops what is after the point. The sparse counts answer, each for the part of its pixel that the brush
    covers: that is the difference of the running sums at both ends, without the dense grid that holds them, so a brush
    costs the cells that occur under it, and one aggregation.
    """
    rows, weight, whole = slice_.counts, F.lit(1), True
    for axis, interval in zip(slice_.axes, brush, strict=True):
        low, high = ordered(interval)
        whole = whole and float(low).is_integer() and float(high).is_integer()
        pixel = F.col(axis)
        rows = rows.where((pixel > math.floor(low)) & (pixel <= math.ceil(high)))
        weight = weight * (F.least(F.lit(float(high)), pixel) - F.greatest(F.lit(float(low)), pixel - 1))
    total = F.sum("cnt") if whole else F.sum(F.col("cnt") * weight)
    total = F.coalesce(total, F.lit(0))
    if whole or truncate:
        total = total.cast("long") if whole else F.when(total >= 0, F.floor(total + F.lit(1e-9))).otherwise(F.ceil(total - F.lit(1e-9))).cast("long")
    else:
        total = total.cast("double")
    if not slice_.keys:
        return rows.agg(total.alias("value"))
    found = rows.groupBy(*slice_.keys).agg(total.alias("value"))
    return dense(found, math.prod(slice_.bins), list(slice_.keys), **{k: (0, n - 1) for k, n in zip(slice_.keys, slice_.bins, strict=True)})


def brush_sweep(slice_: CubeSlice, brushes: Sequence[Sequence[tuple[int, int]]]) -> DataFrame:
    """(brush, keys, value): the counts under each of many brushes in whole pixels, in one job; brush is the position in the list.

    The brushes' corners (four for each at most) are broadcast and met with the slice's running sums.
    """
    corners = []
    for i, brush in enumerate(brushes):
        cells: list[tuple[tuple[int, ...], int]] = [((), 1)]
        for low, high in brush:
            cells = [((*at, pixel), sign * weight) for at, sign in cells for pixel, weight in _weights(*ordered((low, high))).items()]
        corners += [(i, *at, weight) for at, weight in cells]
    spark = slice_.cumulative.sparkSession
    table = spark.createDataFrame(corners, ", ".join(["brush int", *(f"{a} int" for a in slice_.axes), "weight long"]))
    met = slice_.cumulative.join(F.broadcast(table), list(slice_.axes)).groupBy("brush", *slice_.keys).agg(F.sum(F.col("cum") * F.col("weight")).alias("value"))
    every = slice_.no_brush.drop("cnt") if slice_.keys else spark.range(1).select()
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(brushes) - 1))).alias("brush"))
    return every.join(met, ["brush", *slice_.keys], "left").select("brush", *slice_.keys, F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def cleared(slice_: CubeSlice) -> DataFrame:
    """(keys, value) of the passive view without a brush on the active one."""
    return slice_.no_brush.withColumnRenamed("cnt", "value")
