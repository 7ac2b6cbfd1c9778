"""Brushes as predicates."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.binning import in_bins, inside, ordered
from tidemark.spec import Dimension, Interval, View

Brushes = Mapping[str, Interval]
_DAY = 86_400_000


def conjunction(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def raw_bounds(dimension: Dimension, low: float, high: float, schema: T.StructType | None) -> Column:
    """Wider bounds on the column itself, where a cast hides it from the Parquet scan (times, decimals, long integers).

    They hold for every row that is inside; row groups and files that lie outside are not read.
    """
    if schema is None or dimension.expr is not None or dimension.name not in schema.names or not (math.isfinite(low) and math.isfinite(high)):
        return F.lit(True)
    column, kind = F.col(f"`{dimension.name}`"), schema[dimension.name].dataType
    if dimension.time and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and max(abs(low), abs(high)) < 1e14:
        # a day more than a shift of the session's time zone
        margin = 1 if isinstance(kind, T.TimestampType) else 2 * _DAY
        ends = (F.timestamp_millis(F.lit(v)) for v in (math.floor(low) - margin, math.ceil(high) + margin))
    elif not dimension.time and isinstance(kind, T.DecimalType):
        unit = Decimal(1).scaleb(-kind.scale)
        slack = [unit + Decimal(abs(v)) * Decimal("1e-12") for v in (low, high)]
        ends = [F.lit(Decimal(v).quantize(unit) + sign * s.quantize(unit) + sign * unit) for v, s, sign in ((low, slack[0], -1), (high, slack[1], 1))]
        if max(abs(low), abs(high)) * 1.001 + 2 >= 10.0 ** (kind.precision - kind.scale):
            return F.lit(True)
    elif not dimension.time and isinstance(kind, T.LongType) and max(abs(low), abs(high)) < 1e15:
        ends = [F.lit(math.floor(low) - 1), F.lit(math.ceil(high) + 1)]
    else:
        return F.lit(True)
    first, last = (e.cast(kind) for e in ends)
    return (column >= first) & (column <= last)


def brush_predicate(dimension: Dimension, interval: Interval, closed: bool = False, schema: T.StructType | None = None) -> Column:
    low, high = ordered(interval)
    return raw_bounds(dimension, low, high, schema) & inside(dimension.value(), low, high, closed)


def brushed(brushes: Brushes, dimensions: Mapping[str, Dimension], omit: Iterable[str] = (), closed: bool = False, schema: T.StructType | None = None) -> Column:
    """Rows within all brushes but those of the dimensions in omit; with a schema, in a form that reaches the scan."""
    left_out = set(omit)
    return conjunction(brush_predicate(dimensions[d], i, closed, schema) for d, i in brushes.items() if d not in left_out)


def crossfiltered(view: View, brushes: Brushes, dimensions: Mapping[str, Dimension], omit: Iterable[str] = (), closed: bool = False, schema: T.StructType | None = None) -> Column:
    """A view's own dimensions never filter it."""
    return brushed(brushes, dimensions, {*omit, *(d.name for d in view.dimensions)}, closed, schema)


def in_domain(view: View, closed: bool = False, schema: T.StructType | None = None) -> Column:
    """Rows in the bins of a view."""
    return conjunction(raw_bounds(d, d.config.start, d.config.stop, schema) & in_bins(d.value(), d.config, closed) for d in view.dimensions)
