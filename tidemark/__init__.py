"""Crossfilter analytics on Spark: linked histograms, heat maps and cumulative cubes over very large tables."""

__version__ = "0.1.0"
