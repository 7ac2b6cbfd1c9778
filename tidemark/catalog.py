"""One query for each operator of the engine over the test tables, with the DuckDB SQL that gives the same rows.

The SQL counts rows directly, cell by cell, rather than by running sums, so that it is an independent check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import binning, scalars
from tidemark.operators import aggregates, cube, filters, lookup
from tidemark.plans import fused
from tidemark.session import Crossfilter
from tidemark.sources import prepare, readers
from tidemark.spec import BinConfig, Config, Dimension, View, View0D, View1D, View2D
from tidemark.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = 86_400_000.0
Q = Dimension("l_quantity", 25, (0, 50), config=binning.nice_bins(25, (0, 50)))
P = Dimension("l_extendedprice", 25, (0, 105000), config=binning.nice_bins(25, (0, 105000)))
D = Dimension("l_discount", 20, (0, 0.1), config=binning.nice_bins(20, (0, 0.1)))
T = Dimension("l_tax", 10, (0, 0.1), config=binning.nice_bins(10, (0, 0.1)))
S = Dimension("l_shipdate", 25, (9131 * DAY, 11688 * DAY), time=True, config=binning.time_bins(25, (9131 * DAY, 11688 * DAY)))
DIMS = {d.name: d for d in (Q, P, D, T, S)}
ONE, TWO = {"l_discount": (0.02, 0.06)}, {"l_discount": (0.02, 0.06), "l_extendedprice": (10000.0, 60000.0)}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parquet(spark, f"{sf_dir}/lineitem.parquet", None)


# pieces of SQL


def num(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def val(d: Dimension) -> str:
    return f"CAST(epoch_ms({d.name}) AS DOUBLE)" if d.time else f"CAST({d.name} AS DOUBLE)"


def rng(v: str, low: float, high: float, closed: bool = False) -> str:
    return f"({v} >= {num(low)} AND {v} {'<=' if closed else '<'} {num(high)})"


def idx(v: str, c: BinConfig) -> str:
    return f"CAST(floor(({v} - {num(c.start)}) / {num(c.step)}) AS INTEGER)"


def where(brushes: dict, omit=(), closed: bool = False) -> str:
    return " AND ".join(["TRUE", *(rng(val(DIMS[n]), *i, closed) for n, i in brushes.items() if n not in omit)])


def hist_sql(d: Dimension, brushes: dict, table: str = "lineitem", closed: bool = False) -> str:
    c = d.config
    return f"""WITH c AS (SELECT {idx(val(d), c)} AS key, count(*) AS n, count(*) FILTER (WHERE {where(brushes, (d.name,), closed)}) AS f
        FROM {table} WHERE {rng(val(d), c.start, c.stop, closed)} GROUP BY 1)
      SELECT CAST(g.k AS INTEGER) AS key, {num(c.start)} + g.k * {num(c.step)} AS key_start, CAST(coalesce(n, 0) AS BIGINT) AS no_brush, CAST(coalesce(f, 0) AS BIGINT) AS value
      FROM range({c.count}) g(k) LEFT JOIN c ON c.key = g.k"""


def pix(d: Dimension, pixels: int) -> str:
    c = d.config.resized(pixels)
    return f"CASE WHEN {rng(val(d), c.start, c.stop)} AND {idx(val(d), c)} < {pixels} THEN {idx(val(d), c)} + 1 ELSE 0 END"


def rows_sql(active: list[Dimension], pixels: list[int], view: View, brushes: dict, closed: bool = False) -> str:
    """The view's rows with their pixels (0: outside on any axis) and keys."""
    axes, keys = cube.axis_names(len(active)), cube.key_names(view)
    own = " AND ".join(f"({pix(d, p)}) > 0" for d, p in zip(active, pixels, strict=True))
    columns = [f"CASE WHEN {own} THEN {pix(d, p)} ELSE 0 END AS {a}" for d, p, a in zip(active, pixels, axes, strict=True)]
    columns += [f"{idx(val(d), d.config)} AS {k}" for d, k in zip(view.dimensions, keys, strict=True)]
    inside = " AND ".join(["TRUE", *(rng(val(d), d.config.start, d.config.stop) for d in view.dimensions)])
    omit = {d.name for d in active} | {d.name for d in view.dimensions}
    return f"SELECT {', '.join(columns)} FROM lineitem WHERE {inside} AND {where(brushes, omit, closed)}"


def grid_sql(pixels: list[int], view: View) -> str:
    axes, keys = cube.axis_names(len(pixels)) if pixels else (), cube.key_names(view)
    parts = [f"range({p + 1}) AS a{i}({a})" for i, (a, p) in enumerate(zip(axes, pixels, strict=True))]
    parts += [f"range({d.config.count}) AS k{i}({k})" for i, (d, k) in enumerate(zip(view.dimensions, keys, strict=True))]
    return ", ".join(parts) or "(SELECT 1)"


def cube_sql(active: list[Dimension], pixels: list[int], view: View, brushes: dict, closed: bool = False) -> str:
    axes, keys = cube.axis_names(len(active)), cube.key_names(view)
    on = " AND ".join([*(f"r.{a} BETWEEN 1 AND g.{a}" for a in axes), *(f"r.{k} = g.{k}" for k in keys)])
    shown = ", ".join(f"CAST(g.{c} AS INTEGER) AS {c}" for c in (*axes, *keys))
    return f"""WITH r AS ({rows_sql(active, pixels, view, brushes, closed)}), s AS (SELECT {', '.join((*axes, *keys))}, count(*) AS n FROM r GROUP BY ALL),
      g AS (SELECT * FROM {grid_sql(pixels, view)})
      SELECT {shown}, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS cum FROM g LEFT JOIN s r ON {on} GROUP BY {', '.join('g.' + c for c in (*axes, *keys))}"""


def brush_sql(active: list[Dimension], pixels: list[int], view: View, brushes: dict, brush: list[tuple[float, float]] | None, kind: str = "BIGINT") -> str:
    """Each row counts for the part of its pixel that the brush covers; without a brush for 1."""
    axes, keys = cube.axis_names(len(active)), cube.key_names(view)
    part = " * ".join(f"greatest(0, least({num(high)}, r.{a}) - greatest({num(low)}, r.{a} - 1)) * (r.{a} > 0)::INT" for a, (low, high) in zip(axes, brush or [], strict=False)) or (f"(r.{keys[0]} IS NOT NULL)::INT" if keys else "1")
    value = f"CAST({'trunc' if kind == 'BIGINT' else ''}(coalesce(sum({part}), 0)) AS {kind}) AS value"
    if not keys:
        return f"WITH r AS ({rows_sql(active, pixels, view, brushes)}) SELECT {value} FROM r"
    return f"""WITH r AS ({rows_sql(active, pixels, view, brushes)}), g AS (SELECT * FROM {grid_sql([], view)})
      SELECT {', '.join(f'CAST(g.{k} AS INTEGER) AS {k}' for k in keys)}, {value} FROM g LEFT JOIN r ON {' AND '.join(f'r.{k} = g.{k}' for k in keys)} GROUP BY {', '.join('g.' + k for k in keys)}"""


# counts, extents, histograms


@query("count_0d", "SELECT count(*) AS no_brush, count(*) AS value FROM lineitem")
def count_0d(spark, sf_dir):
    return aggregates.row_count(items(spark, sf_dir))


@query("count_0d_brushed", f"SELECT count(*) AS no_brush, count(*) FILTER (WHERE {where(TWO)}) AS value FROM lineitem")
def count_0d_brushed(spark, sf_dir):
    return aggregates.row_count(items(spark, sf_dir), TWO, DIMS)


for _name, _d in (("extent_quantity", Q), ("extent_shipdate", S)):
    query(_name, f"SELECT min({val(_d)}) AS low, max({val(_d)}) AS high FROM lineitem")(lambda spark, sf_dir, d=_d: aggregates.extent(items(spark, sf_dir), d))

_ZOOMED = Dimension("l_extendedprice", 25, config=binning.nice_bins(25, (20000, 40000)))
for _name, _d, _b in (
    ("hist_quantity", Q, {}),
    ("hist_quantity_brushed", Q, ONE),
    ("hist_two_brushes", Q, TWO),
    ("hist_shipdate_time", S, ONE),
    ("hist_zoomed", _ZOOMED, ONE),
    ("nobrush_self_exclusion", D, TWO),
):
    query(_name, hist_sql(_d, _b))(lambda spark, sf_dir, d=_d, b=_b: aggregates.histogram(items(spark, sf_dir), View1D(d), b, DIMS))


@query("hist_series", f"WITH h AS ({hist_sql(Q, ONE)}) SELECT key, key_start, 'brushed' AS series, value AS rows FROM h UNION ALL SELECT key, key_start, 'base', no_brush FROM h")
def hist_series(spark, sf_dir):
    """A chart's two series one below the other."""
    return aggregates.series(aggregates.histogram(items(spark, sf_dir), View1D(Q), ONE, DIMS))


@query("hist_closed", hist_sql(Q, ONE, closed=True))
def hist_closed(spark, sf_dir):
    """Filters and domains closed at the upper end, as between is."""
    return aggregates.histogram(items(spark, sf_dir), View1D(Q), ONE, DIMS, closed=True)


@query("count_closed", f"SELECT count(*) AS no_brush, count(*) FILTER (WHERE {where(TWO, closed=True)}) AS value FROM lineitem")
def count_closed(spark, sf_dir):
    return aggregates.row_count(items(spark, sf_dir), TWO, DIMS, closed=True)


_TOTAL = Dimension("o_totalprice", 25, config=binning.nice_bins(25, (0, 600000)))
_VALUE = Dimension("value", 25, config=binning.nice_bins(25, (0, 1000)))


@query("hist_orders_price", hist_sql(_TOTAL, {}, "orders"))
def hist_orders_price(spark, sf_dir):
    return aggregates.histogram(spark.read.parquet(f"{sf_dir}/orders.parquet"), View1D(_TOTAL))


@query("hist_events_value", hist_sql(_VALUE, {}, "events"))
def hist_events_value(spark, sf_dir):
    return aggregates.histogram(spark.read.parquet(f"{sf_dir}/events.parquet"), View1D(_VALUE))


def _heat_sql(brushes: dict, closed: bool = False) -> str:
    return f"""WITH c AS (SELECT {idx(val(P), P.config)} AS x, {idx(val(Q), Q.config)} AS y, count(*) AS n, count(*) FILTER (WHERE {where(brushes, (P.name, Q.name), closed)}) AS f
        FROM lineitem WHERE {rng(val(P), P.config.start, P.config.stop, closed)} AND {rng(val(Q), Q.config.start, Q.config.stop, closed)} GROUP BY 1, 2)
      SELECT CAST(a.i AS INTEGER) AS key_x, CAST(b.j AS INTEGER) AS key_y, {num(P.config.start)} + a.i * {num(P.config.step)} AS x_start, {num(Q.config.start)} + b.j * {num(Q.config.step)} AS y_start,
        CAST(coalesce(n, 0) AS BIGINT) AS no_brush, CAST(coalesce(f, 0) AS BIGINT) AS value
      FROM range({P.config.count}) a(i), range({Q.config.count}) b(j) LEFT JOIN c ON c.x = a.i AND c.y = b.j"""


for _name, _b, _c in (("heatmap_price_quantity", {}, False), ("heatmap_brushed", TWO, False), ("heatmap_closed", {**TWO, "l_tax": (0.02, 0.06)}, True)):
    query(_name, _heat_sql(_b, _c).replace("range(" + str(P.config.count) + ") a(i), range(" + str(Q.config.count) + ") b(j)", f"(SELECT * FROM range({P.config.count}) a(i), range({Q.config.count}) b(j)) g").replace("a.i", "g.i").replace("b.j", "g.j"))(
        lambda spark, sf_dir, b=_b, c=_c: aggregates.heatmap(items(spark, sf_dir), View2D(P, Q), b, DIMS, c)
    )

# cubes and brushes: (name, active, pixels, passive view, brush in pixels, fractional brush)

_CASES = (
    ("1d_0d", [Q], [50], View0D(), [(10, 35)], [(10.25, 35.5)]),
    ("1d_1d", [Q], [50], View1D(P), [(10, 35)], [(10.25, 35.5)]),
    ("1d_2d", [Q], [25], View2D(P, D), [(5, 20)], [(5.5, 20.75)]),
    ("2d_0d", [P, Q], [10, 10], View0D(), [(2, 7), (1, 9)], [(2.5, 7.25), (1.75, 8.5)]),
    ("2d_1d", [P, Q], [10, 10], View1D(D), [(2, 7), (1, 9)], [(2.5, 7.25), (1.75, 8.5)]),
    ("2d_2d", [P, Q], [8, 8], View2D(D, T), [(2, 7), (1, 8)], [(2.5, 6.25), (1.75, 7.5)]),
)
_OTHER = {"l_discount": (0.01, 0.08), "l_quantity": (3.0, 30.0), "l_shipdate": (9500 * DAY, 11000 * DAY)}


def _slice(spark, sf_dir, active, pixels, view):
    return cube.build_slice(items(spark, sf_dir), active, pixels, view, _OTHER, DIMS)


for _name, _a, _p, _v, _w, _f in _CASES:
    query(f"cube{_name}", cube_sql(_a, _p, _v, _OTHER))(lambda spark, sf_dir, a=_a, p=_p, v=_v: _slice(spark, sf_dir, a, p, v).cumulative)
    query(f"brush{_name}", brush_sql(_a, _p, _v, _OTHER, _w))(lambda spark, sf_dir, a=_a, p=_p, v=_v, w=_w: lookup.brushed_counts(_slice(spark, sf_dir, a, p, v), w))
    query(f"brush{_name}_interpolated", brush_sql(_a, _p, _v, _OTHER, _f, "DOUBLE"))(lambda spark, sf_dir, a=_a, p=_p, v=_v, w=_f: lookup.brushed_counts(_slice(spark, sf_dir, a, p, v), w))
    query(f"no_brush{_name}", brush_sql(_a, _p, _v, _OTHER, None))(lambda spark, sf_dir, a=_a, p=_p, v=_v: lookup.cleared(_slice(spark, sf_dir, a, p, v)))


_ENDS = {"l_discount": (0.01, 0.08), "l_tax": (0.0, 0.05)}


@query("cube1d_closed", cube_sql([Q], [50], View1D(P), _ENDS, closed=True))
def cube_closed(spark, sf_dir):
    """Brushes that hold their upper ends."""
    return cube.build_slice(items(spark, sf_dir), [Q], [50], View1D(P), _ENDS, DIMS, closed=True).cumulative


@query("brush1d_1d_truncated", brush_sql([Q], [50], View1D(P), _OTHER, [(10.25, 35.5)]))
def brush_truncated(spark, sf_dir):
    return lookup.brushed_counts(_slice(spark, sf_dir, [Q], [50], View1D(P)), [(10.25, 35.5)], truncate=True)


_SWEEP = [(start, start + width) for start in range(0, 500, 25) for width in range(25, 501 - start, 25)]


@query("brush_sweep", f"""WITH r AS ({rows_sql([Q], [500], View1D(P), _OTHER)}), c AS (SELECT pixel, key, count(*) AS n FROM r WHERE pixel > 0 GROUP BY ALL),
  b AS (SELECT row_number() OVER (ORDER BY a, z) - 1 AS brush, a, z FROM (SELECT a, z FROM range(0, 500, 25) s(a), range(25, 501, 25) t(z) WHERE z > a)), g AS (SELECT * FROM b, range({P.config.count}) k(key))
  SELECT CAST(g.brush AS INTEGER) AS brush, CAST(g.key AS INTEGER) AS key, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS value FROM g LEFT JOIN c ON c.key = g.key AND c.pixel > g.a AND c.pixel <= g.z GROUP BY g.brush, g.key""")
def brush_sweep(spark, sf_dir):
    """210 brushes of all widths answered from one slice in one job."""
    return lookup.brush_sweep(_slice(spark, sf_dir, [Q], [500], View1D(P)), [[b] for b in _SWEEP])


@query("progressive_coarse", cube_sql([Q], [10], View1D(P), _OTHER))
def progressive_coarse(spark, sf_dir):
    """A coarse slice out of a fine one, without the table."""
    return cube.coarser(_slice(spark, sf_dir, [Q], [50], View1D(P)), [10]).cumulative


_FUSED = {"count": View0D(), "price": View1D(P), "discount_tax": View2D(D, T)}


def _fused_sql() -> str:
    parts = []
    for name, view in _FUSED.items():
        keys = cube.key_names(view)
        named = [*keys, *["0"] * (2 - len(keys))]
        parts.append(f"SELECT '{name}' AS view, pixel, CAST({named[0]} AS INTEGER) AS key_x, CAST({named[1]} AS INTEGER) AS key_y, count(*) AS cnt FROM ({rows_sql([Q], [50], view, _OTHER)}) GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query("fused_index", _fused_sql())
def fused_index(spark, sf_dir):
    """The sparse counts of all passive views from one scan."""
    return fused.fused_counts(items(spark, sf_dir), [Q], [50], _FUSED, _OTHER, DIMS)


def _charts_sql() -> str:
    parts = []
    for name, view in _FUSED.items():
        keys = [idx(val(d), d.config) for d in view.dimensions] + ["0"] * (2 - len(view.dimensions))
        inside = " AND ".join(["TRUE", *(rng(val(d), d.config.start, d.config.stop) for d in view.dimensions)])
        keep = where(TWO, {d.name for d in view.dimensions})
        parts.append(f"SELECT '{name}' AS view, CAST({keys[0]} AS INTEGER) AS key_x, CAST({keys[1]} AS INTEGER) AS key_y, count(*) AS no_brush, count(*) FILTER (WHERE {keep}) AS value FROM lineitem WHERE {inside} GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query("fused_charts", _charts_sql())
def fused_charts(spark, sf_dir):
    """The chart data of all views, with and without brushes, from one scan."""
    return fused.fused_totals(items(spark, sf_dir), _FUSED, TWO, DIMS)


@query("session_brush", brush_sql([Q], [600], View1D(P), ONE, [(120, 420)]))
def session_brush(spark, sf_dir):
    """A session in which one view is brushed, then another."""
    session = Crossfilter(items(spark, sf_dir), {"discount": View1D(D), "quantity": View1D(Q), "price": View1D(P), "count": View0D()})
    session.brush("discount", ONE["l_discount"])
    return session.brush("quantity", (35.0, 10.0))["price"]


@query("session_progressive", f"SELECT 'coarse' AS stage, true AS approximate, * FROM ({brush_sql([Q], [25], View1D(P), ONE, [(5, 18)])}) UNION ALL SELECT 'fine', false, * FROM ({brush_sql([Q], [600], View1D(P), ONE, [(125, 425)])})")
def session_progressive(spark, sf_dir):
    """A brush answered from slices at the resolution of bins, then from those of full resolution."""
    views = {"discount": View1D(D), "quantity": View1D(Q), "price": View1D(P), "count": View0D()}
    session = Crossfilter(items(spark, sf_dir), views, Config(progressive=True))
    session.brush("discount", ONE["l_discount"])
    brush = (125 / 12, 425 / 12)
    coarse = session.brush("quantity", brush)["price"].select(F.lit("coarse").alias("stage"), F.lit(session.approximate).alias("approximate"), "*")
    fine = session.refine()["price"].select(F.lit("fine").alias("stage"), F.lit(session.approximate).alias("approximate"), "*")
    return coarse.unionByName(fine)


# expressions

_KEYS = "l_orderkey, l_linenumber"


@query("bin_expressions", f"""SELECT {_KEYS}, {num(Q.config.start)} + {num(Q.config.step)} * floor(({val(Q)} - {num(Q.config.start)}) / {num(Q.config.step)}) AS snapped,
  ({val(Q)} - {num(Q.config.start)}) / {num(Q.config.step)} AS fractional, CASE WHEN {rng(val(Q), 0, 50)} THEN {idx(val(Q), Q.config)} ELSE -1 END AS marked,
  greatest({num(5)}, least({num(40)}, {val(Q)})) AS clamped FROM lineitem""")
def bin_expressions(spark, sf_dir):
    v = Q.value()
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", binning.snapped(v, Q.config).alias("snapped"), binning.fractional_bin(v, Q.config).alias("fractional"), binning.bin_or(v, Q.config).alias("marked"), scalars.clamp(v, 5.0, 40.0).alias("clamped"))


@query("filter_mask", f"SELECT excluded, count(*) AS n FROM (SELECT NOT ({where(TWO)}) AS excluded FROM lineitem) GROUP BY 1")
def filter_mask(spark, sf_dir):
    return aggregates.masked(items(spark, sf_dir), filters.brushed(TWO, DIMS)).groupBy("excluded").agg(F.count("*").alias("n"))


@query("pdf_hist", f"SELECT key, value / sum(value) OVER () AS share FROM ({hist_sql(Q, ONE)})")
def pdf_hist(spark, sf_dir):
    return aggregates.normalized(aggregates.histogram(items(spark, sf_dir), View1D(Q), ONE, DIMS)).select("key", "share")


@query("cdf_hist", f"SELECT key, CAST(sum(value) OVER (ORDER BY key) AS DOUBLE) / sum(value) OVER () AS share FROM ({hist_sql(Q, ONE)})")
def cdf_hist(spark, sf_dir):
    return aggregates.normalized_cumulative(aggregates.histogram(items(spark, sf_dir), View1D(Q), ONE, DIMS)).select("key", "share")


@query("scale_top", f"SELECT greatest(max(no_brush), max(value)) AS top FROM ({hist_sql(Q, ONE)})")
def scale_top(spark, sf_dir):
    return aggregates.scale_top(aggregates.histogram(items(spark, sf_dir), View1D(Q), ONE, DIMS))


@query("ratio_selected", f"SELECT count(*) FILTER (WHERE {where(TWO)}) AS value, count(*) AS base, CAST(count(*) FILTER (WHERE {where(TWO)}) AS DOUBLE) / count(*) AS ratio FROM lineitem")
def ratio_selected(spark, sf_dir):
    counts = aggregates.row_count(items(spark, sf_dir), TWO, DIMS)
    return counts.select("value", F.col("no_brush").alias("base"), scalars.share(F.col("value"), F.col("no_brush")).alias("ratio"))


@query("repeat_visible", "SELECT i, least(greatest(i, 4), 8) AS v FROM range(1, 10) t(i)")
def repeat_visible(spark, sf_dir):
    return spark.range(1, 10).select(F.col("id").alias("i"), scalars.repeat_visible(F.col("id"), F.col("id"), 3.5, 8.5).alias("v"))


# preparation of raw tables


@query("prep_time_of_day", """SELECT o_orderkey, CAST(CASE WHEN h * 100 + m = 2400 THEN 0 ELSE h + m / 60.0::DOUBLE END AS DOUBLE) AS hour
  FROM (SELECT o_orderkey, o_orderkey % 25 AS h, CASE WHEN o_orderkey % 25 = 24 THEN 0 ELSE o_orderkey % 60 END AS m FROM orders)""")
def prep_time_of_day(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    h = F.col("o_orderkey") % 25
    m = F.when(h == 24, 0).otherwise(F.col("o_orderkey") % 60)
    return prepare.times_of_day(o.select("o_orderkey", (h * 100 + m).alias("hour")), ["hour"], "double")


@query("prep_fill_drop", "SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END, 0) / CAST(10 AS DOUBLE) AS amount, CAST(user_id AS INTEGER) AS usr FROM events WHERE event_id % 5 <> 0")
def prep_fill_drop(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"))
    e = prepare.renamed(e, {"value": "amount", "user_id": "usr"})
    return prepare.typed(prepare.complete(prepare.scaled(prepare.filled(e, ["amount"]), ["amount"])), {"usr": "int"})


@query("prep_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def prep_dates(spark, sf_dir):
    """Dates as text in one of three formats, parsed with fallbacks."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    texts = F.array(*(F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "yyyyMMdd", "dd-MMM-yyyy")))
    return o.select("o_orderkey", scalars.parsed_date(F.get(texts, (F.col("o_orderkey") % 3).cast("int")), "yyyy-MM-dd", "yyyyMMdd", "dd-MMM-yyyy").alias("day"))


@query("magnitude", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN round(o_totalprice + 5.0::DOUBLE * log10(CAST(o_orderkey % 4 AS DOUBLE)) - 10.0::DOUBLE, 6) END AS mg FROM orders")
def magnitude(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", F.round(scalars.absolute_magnitude(F.col("o_totalprice"), (F.col("o_orderkey") % 4).cast("double")), 6).alias("mg"))


@query("first_rows", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity LIMIT 100")
def first_rows(spark, sf_dir):
    """A prefix in a given order."""
    return prepare.first_rows(items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity"), 100, "l_orderkey", "l_linenumber", "l_quantity")


@query("summary", "SELECT count(l_quantity) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem")
def summary(spark, sf_dir):
    v = F.col("l_quantity")
    return items(spark, sf_dir).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")


@query("describe_columns", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS low, max({c}) AS high FROM lineitem" for c in _NUMBERS))
def describe_columns(spark, sf_dir):
    """Several columns' summaries from one scan; quartiles, which are approximate, are left out here."""
    found = aggregates.described(items(spark, sf_dir), *_NUMBERS)
    return found.select("name", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high")


@query("rows_of_arrays", f"SELECT key, value FROM ({hist_sql(Q, ONE)})")
def rows_of_arrays(spark, sf_dir):
    """A chart's data as arrays, taken apart again."""
    bins = F.array_sort(F.collect_list(F.struct("key", "value")))
    arrays = aggregates.histogram(items(spark, sf_dir), View1D(Q), ONE, DIMS).agg(bins.alias("bins")).select("bins.key", "bins.value")
    return scalars.rows_of(arrays, "key", "value")


@query("query_log", f"SELECT 'SELECT count(*) AS n FROM {{data}} WHERE l_quantity < 10' AS query, 1::BIGINT AS rows UNION ALL SELECT 'SELECT l_tax, count(*) AS n FROM {{data}} GROUP BY l_tax', count(DISTINCT l_tax) FROM lineitem")
def query_log(spark, sf_dir):
    log = live.QueryLog(spark)
    for text in ("SELECT count(*) AS n\nFROM {data} WHERE l_quantity < 10", "SELECT l_tax, count(*) AS n FROM {data}  GROUP BY l_tax"):
        readers.sql(items(spark, sf_dir), text, log)
    return log.table().select("query", "rows")


@query("interaction_log", "SELECT 'l_discount' AS dimension, 'create' AS action, 1::BIGINT AS changes UNION ALL SELECT 'l_quantity', 'create', 1 UNION ALL SELECT 'l_quantity', 'move', 1 UNION ALL SELECT 'l_quantity', 'clear', 1")
def interaction_log(spark, sf_dir):
    log = live.InteractionLog(spark)
    log("discount", {"l_discount": (0.0, 0.05)})
    log("quantity", {"l_quantity": (1.0, 5.0)})
    log("quantity", {"l_quantity": (2.0, 6.0)})
    log("quantity", {"l_quantity": None})
    return log.by_dimension().select("dimension", "action", "changes")


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "BOOLEAN": "boolean"}


@query("described", f"SELECT column_name AS name, CASE column_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())} END AS type, \"null\" = 'YES' AS nullable FROM (DESCRIBE lineitem)")
def described(spark, sf_dir):
    return readers.described(items(spark, sf_dir))
