"""What a session shows: dimensions, bins, views and settings."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Interval = tuple[float, float]


@dataclass(frozen=True)
class BinConfig:
    """Regular bins [start, start + step), ... up to stop."""

    start: float
    stop: float
    step: float

    @property
    def count(self) -> int:
        """Bins in the domain; float error in the division is rounded away."""
        return max(0, round((self.stop - self.start) / self.step)) if self.step else 0

    def resized(self, count: int) -> BinConfig:
        """The same domain in count bins, as pixels of a brush are."""
        return BinConfig(self.start, self.stop, (self.stop - self.start) / count)


@dataclass(frozen=True)
class Dimension:
    """A numeric or time column, or any SQL expression of one.

    bins is the most that automatic binning makes; extent is taken from the data where it is None; a time dimension is
    measured in milliseconds since 1970.
    """

    name: str
    bins: int = 25
    extent: Interval | None = None
    expr: str | None = None
    time: bool = False
    title: str | None = None
    format: str = ""
    config: BinConfig | None = None

    def value(self) -> Column:
        """The column as double."""
        raw = F.expr(self.expr if self.expr is not None else f"`{self.name}`")
        return F.unix_millis(raw.cast("timestamp")).cast("double") if self.time else raw.cast("double")


@dataclass(frozen=True)
class View0D:
    """The number of rows."""

    title: str | None = None

    @property
    def dimensions(self) -> tuple[Dimension, ...]:
        return ()


@dataclass(frozen=True)
class View1D:
    """A histogram."""

    dimension: Dimension
    title: str | None = None

    @property
    def dimensions(self) -> tuple[Dimension, ...]:
        return (self.dimension,)


@dataclass(frozen=True)
class View2D:
    """A heat map of two dimensions, x then y."""

    x: Dimension
    y: Dimension
    title: str | None = None
    chart_size: tuple[int, int] | None = None

    @property
    def dimensions(self) -> tuple[Dimension, ...]:
        return (self.x, self.y)


View = View0D | View1D | View2D


@dataclass(frozen=True)
class Config:
    """Settings that change results or the resolution of brushes; the largest resolutions also bound a cube's cells."""

    interpolate: bool = False
    closed: bool = False  # brushes and domains hold their upper ends
    progressive: bool | str = False  # True, False or "only2D"
    zoom: bool = True
    max_resolution_1d: float = math.inf
    max_resolution_2d: int = 80
    histogram_width: int = 600
    heatmap_width: int = 400
    max_cells: int = 20_000_000


@dataclass
class CubeSlice:
    """Counts of a passive view by pixel of the active one.

    counts has a row for each pixel and bin that occur (pixels from 1; 0 in every axis marks rows outside the active
    domain). cumulative is dense: at pixel p the rows of pixels up to p. no_brush leaves the active axes out.
    """

    pixels: tuple[int, ...]
    bins: tuple[int, ...]
    counts: DataFrame
    cumulative: DataFrame
    no_brush: DataFrame
    axes: tuple[str, ...] = field(default=())
    keys: tuple[str, ...] = field(default=())
