"""Linked views over one table."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame

from tidemark.functions.binning import ordered
from tidemark.operators.aggregates import shown, with_bins
from tidemark.operators.cube import coarser
from tidemark.operators.lookup import brushed_counts, cleared, edges
from tidemark.plans.fused import fused_charts, fused_counts, fused_slices, fused_totals
from tidemark.plans.runner import Runner
from tidemark.spec import Config, CubeSlice, Dimension, Interval, View, View1D, View2D


class Crossfilter:
    """A table, its views and the brushes on them.

    Brushes belong to dimensions, so views of one dimension share a brush. Every view is filtered by all brushes but its
    own. Activating a view builds the slices of all others in one scan and persists their counts; moving the brush of
    the active view then reads slices only.
    """

    def __init__(self, df: DataFrame, views: Mapping[str, View], config: Config | None = None, logger=None):
        self.df, self.config, self.logger = df, config or Config(), logger
        known: dict[str, Dimension] = {}
        for view in views.values():
            for d in view.dimensions:
                if d.name not in known:
                    known[d.name] = d if d.config else with_bins(df, d)
        self.dimensions = known
        self.views = {name: self._bound(view) for name, view in views.items()}
        self.brushes: dict[str, Interval] = {}
        self.active: str | None = None
        self._slices: dict[str, tuple[tuple[int, ...], DataFrame, dict[str, CubeSlice]]] = {}
        self._runner: Runner | None = None
        self._totals: DataFrame | None = None

    def _bound(self, view: View) -> View:
        if isinstance(view, View1D):
            return replace(view, dimension=self.dimensions[view.dimension.name])
        if isinstance(view, View2D):
            return replace(view, x=self.dimensions[view.x.name], y=self.dimensions[view.y.name])
        return view

    def initial(self) -> dict[str, DataFrame]:
        """Chart data of every view, unbrushed."""
        return self._charts({})

    def charts(self) -> dict[str, DataFrame]:
        """Chart data of every view under the brushes, from the table."""
        return self._charts(self.brushes)

    def _charts(self, brushes: dict[str, Interval]) -> dict[str, DataFrame]:
        """From one scan for all views: its counts, a row for each bin, are held until the next such call."""
        self._forget()
        self._totals = fused_totals(self.df, self.views, brushes, self.dimensions, self.config.closed).persist()
        return fused_charts(self._totals, self.views)

    def _forget(self) -> None:
        if self._totals is not None:
            self._totals.unpersist()
            self._totals = None

    def pixels(self, name: str, progressive: bool = False) -> tuple[int, ...]:
        """The resolution of brushes on a view: its bins while progressive, else about a chart's pixels."""
        view = self.views[name]
        bins = [d.config.count for d in view.dimensions]
        if not bins:
            raise ValueError("a count cannot be the active view")
        if progressive:
            return tuple(bins)
        if len(bins) == 1:
            width = int(min(self.config.histogram_width, self.config.max_resolution_1d))
            return (math.ceil(width / bins[0]) * bins[0],) if self.config.zoom else (width,)
        return (int(min(self.config.heatmap_width, self.config.max_resolution_2d)),) * 2

    def activate(self, name: str, progressive: bool | None = None) -> dict[str, CubeSlice]:
        """Slices of all other views under this one; built in one scan unless they are held at that resolution.

        Left to the settings, slices of full resolution that are held already are given instead of coarse ones.
        """
        view = self.views[name]
        implied = progressive is None
        if implied:
            progressive = self.config.progressive is True or (self.config.progressive == "only2D" and isinstance(view, View2D))
        pixels = self.pixels(name, progressive)
        self.active = name
        held = self._slices.get(name)
        if held and (held[0] == pixels or (implied and held[0] == self.pixels(name))):
            return held[2]
        others = {n: v for n, v in self.views.items() if n != name}
        if held and len(held[0]) == len(pixels) and all(a % b == 0 for a, b in zip(held[0], pixels, strict=True)):
            return {n: coarser(s, pixels, self.config.max_cells) for n, s in held[2].items()}
        return self._hold(name, pixels, self._count(name, pixels))

    def _count(self, name: str, pixels: tuple[int, ...]) -> DataFrame:
        others = {n: v for n, v in self.views.items() if n != name}
        return fused_counts(self.df, self.views[name].dimensions, pixels, others, self.brushes, self.dimensions, self.config.closed).persist()

    def _hold(self, name: str, pixels: tuple[int, ...], counts: DataFrame) -> dict[str, CubeSlice]:
        slices = fused_slices(counts, pixels, {n: v for n, v in self.views.items() if n != name}, self.config.max_cells)
        self._drop(name)
        self._slices[name] = (pixels, counts, slices)
        return slices

    @property
    def approximate(self) -> bool:
        """Are the counts under the active brush those of coarser pixels than the active view's full resolution?"""
        held = self._slices.get(self.active) if self.active else None
        return bool(held) and held[0] != self.pixels(self.active)

    def refine(self) -> dict[str, DataFrame]:
        """Replace the active view's coarse slices by those of full resolution and give the counts of all other views anew.

        What a brush gives while progressive is rounded to bins; this gives its counts to the pixel, and so do later
        brushes on that view, until another view's brush moves.
        """
        if self.active is None:
            raise ValueError("no view is active")
        return self._counts(self.active, self.activate(self.active, progressive=False))

    def refine_in_background(self, then=None):
        """As refine(), while brushes go on being answered from coarse slices; a future of the fine counts.

        then gets the counts once fine slices have replaced the coarse ones. A brush on another view, or a second call,
        cancels the job; slices that are out of date when they are ready are dropped.
        """
        if self.active is None:
            raise ValueError("no view is active")
        name, held = self.active, self._slices.get(self.active)
        pixels = self.pixels(name)
        self._runner = self._runner or Runner(self.df.sparkSession)

        def build() -> dict[str, DataFrame] | None:
            counts = self._count(name, pixels)
            counts.count()
            if self.active != name or self._slices.get(name) is not held:
                counts.unpersist()
                return None
            return self._counts(name, self._hold(name, pixels, counts))

        return self._runner.run("refine", build, then)

    def prefetch(self) -> None:
        """Build the slices of every view that can be active."""
        active = self.active
        for name, view in self.views.items():
            if view.dimensions:
                self.activate(name)[next(n for n in self.views if n != name)].counts.count()
        self.active = active

    def brush(self, name: str, *intervals: Interval) -> dict[str, DataFrame]:
        """Set the brush of a view (one interval for each dimension) and give the counts of all others."""
        view = self.views[name]
        for d, interval in zip(view.dimensions, intervals, strict=True):
            self.brushes[d.name] = ordered(interval)
        return self._moved(name)

    def clear(self, name: str) -> dict[str, DataFrame]:
        """Take the brush of a view away and give the counts of all others."""
        for d in self.views[name].dimensions:
            self.brushes.pop(d.name, None)
        return self._moved(name)

    def _moved(self, name: str) -> dict[str, DataFrame]:
        # other views' slices were built under this view's former brush
        if self._runner and name != self.active:
            self._runner.cancel_all()
        for other in [n for n in self._slices if n != name]:
            self._drop(other)
        slices = self.activate(name)
        if self.logger:
            self.logger(name, {d.name: self.brushes.get(d.name) for d in self.views[name].dimensions})
        return self._counts(name, slices)

    def _counts(self, name: str, slices: dict[str, CubeSlice]) -> dict[str, DataFrame]:
        view = self.views[name]
        if not all(d.name in self.brushes for d in view.dimensions):
            return {n: cleared(s) for n, s in slices.items()}

        def brushed(s: CubeSlice) -> DataFrame:
            return brushed_counts(s, [edges(self.brushes[d.name], d.config, p, self.config.interpolate) for d, p in zip(view.dimensions, s.pixels, strict=True)])

        return {n: brushed(s) for n, s in slices.items()}

    def zoom(self, name: str, domain: Interval) -> DataFrame:
        """Bin a histogram's dimension anew over a domain (widened to its brush) and give its chart data."""
        view = self.views[name]
        if not isinstance(view, View1D):
            raise ValueError("only histograms zoom")
        low, high = ordered(domain)
        if brush := self.brushes.get(view.dimension.name):
            low, high = min(low, brush[0]), max(high, brush[1])
        changed = with_bins(self.df, view.dimension, (low, high))
        if changed.config != view.dimension.config:
            self.dimensions[changed.name] = changed
            self.views = {n: self._bound(v) for n, v in self.views.items()}
            for other in list(self._slices):
                self._drop(other)
        return shown(self.df, self.views[name], self.brushes, self.dimensions, self.config.closed)

    def _drop(self, name: str) -> None:
        if held := self._slices.pop(name, None):
            held[1].unpersist()

    def close(self) -> None:
        if self._runner:
            self._runner.cancel_all()
        self._forget()
        for name in list(self._slices):
            self._drop(name)
