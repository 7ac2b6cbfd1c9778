import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import binning, scalars
from tidemark.operators import aggregates, cube, filters, lookup
from tidemark.plans import fused
from tidemark.session import Crossfilter
from tidemark.spec import BinConfig, Config, Dimension, View0D, View1D, View2D

INF = float("inf")


@pytest.mark.parametrize(
    ("most", "extent", "want"),
    [
        (25, (0, 4000), (0, 4000, 200)), (24, (0, 24), (0, 24, 1)), (25, (-20, 60), (-20, 60, 5)), (25, (0, 500), (0, 500, 20)),
        (25, (-100, 3000), (-200, 3000, 200)), (25, (-10, 50), (-10, 50, 5)), (25, (0, 12), (0, 12, 0.5)), (25, (0, 1400), (0, 1400, 100)),
        (25, (-5, 10), (-5, 10, 1)), (25, (-160, 160), (-160, 160, 20)), (50, (0, 360), (0, 360, 10)), (25, (-90, 90), (-90, 90, 10)),
        (20, (0, 7), (0, 7, 0.5)), (25, (-7, 17), (-7, 17, 1)), (25, (1, 50), (0, 50, 2)), (25, (900, 105000), (0, 105000, 5000)), (25, (50, 1), (0, 50, 2)),
    ],
)
def test_nice_bins(most, extent, want):
    got = binning.nice_bins(most, extent)
    assert (got.start, got.stop) == want[:2] and math.isclose(got.step, want[2]) and got.count == round((want[1] - want[0]) / want[2])


def test_nice_bins_of_one_value():
    for low in (0, 5, -3):
        got = binning.nice_bins(10, (low, low))
        assert got.start <= low < got.stop and 0 < got.count


DAY = 86_400_000.0


def test_time_ticks():
    assert binning.time_ticks((0, 10 * DAY), 10) == [i * DAY for i in range(11)]
    years = binning.time_ticks((0, 3653 * DAY), 10)
    assert years[:3] == [0, 365 * DAY, 730 * DAY] and len(years) == 11
    months = binning.time_ticks((0, 365 * DAY), 12)
    assert months[:3] == [0, 31 * DAY, 59 * DAY]
    assert binning.time_ticks((0, 60_000), 4) == [0, 15_000, 30_000, 45_000, 60_000]
    assert binning.time_ticks((0, 40), 5) == [0, 10, 20, 30, 40]
    weeks = binning.time_ticks((0, 60 * DAY), 9)
    assert weeks[0] == 3 * DAY and weeks[1] - weeks[0] == 7 * DAY
    assert binning.time_ticks((DAY / 2, 4 * DAY), 4)[0] == DAY
    got = binning.time_bins(10, (0, 10 * DAY))
    assert (got.start, got.stop, got.step) == (0, 10 * DAY, 10 * DAY / 11)
    assert binning.time_bins(5, (10.0, 10.5)).step > 0


V = Dimension("v", config=BinConfig(0, 10, 1))
W = Dimension("w", config=BinConfig(0, 4, 1))
X = Dimension("x", config=BinConfig(-1, 1, 0.5))
DIMS = {d.name: d for d in (V, W, X)}
EDGES = [0.0, 10.0, -0.001, 10.001, 3.0, 2.9999, None, math.nan, INF, -INF]


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(1)
    rows = [(i, EDGES[i % 10] if i < 40 else rnd.uniform(-2, 12), rnd.uniform(-1, 5) if i % 9 else None, rnd.uniform(-1.5, 1.5)) for i in range(800)]
    return spark.createDataFrame(rows, "id long, v double, w double, x double").persist(), rows


def ok(v, low, high):
    return v is not None and not math.isnan(v) and low <= v < high


def test_edges_of_bins_and_brushes(table):
    df, rows = table
    got = {r["key"]: (r["no_brush"], r["value"]) for r in aggregates.histogram(df, View1D(V), {"w": (3.0, 1.0), "v": (2.0, 3.0)}, DIMS).collect()}
    for k in range(10):
        inside = [r for r in rows if ok(r[1], k, k + 1)]
        assert got[k] == (len(inside), sum(ok(r[2], 1, 3) for r in inside))
    total = aggregates.row_count(df, {"v": (3.0, 3.0)}, DIMS).first()
    assert tuple(total) == (800, 0)
    low, high = aggregates.extent(df, V).first()
    finite = [r[1] for r in rows if r[1] is not None and math.isfinite(r[1])]
    assert (low, high) == (min(finite), max(finite))
    assert [tuple(r) for r in aggregates.histogram(df.limit(0), View1D(W), {}, DIMS).select("no_brush", "value").collect()] == [(0, 0)] * 4
    assert aggregates.masked(df, filters.brushed({"v": (0, 5)}, DIMS)).where("not excluded").count() == sum(ok(r[1], 0, 5) for r in rows)


def direct(rows, view, brushes):
    at = {"v": 1, "w": 2, "x": 3}
    out = {}
    for r in rows:
        if all(ok(r[at[d]], *i) for d, i in brushes.items()) and all(ok(r[at[d.name]], d.config.start, d.config.stop) for d in view.dimensions):
            key = tuple(math.floor((r[at[d.name]] - d.config.start) / d.config.step) for d in view.dimensions)
            out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize(("active", "pixels"), [([V], [20]), ([V, W], [10, 8])])
@pytest.mark.parametrize("passive", [View0D(), View1D(X), View2D(X, Dimension("y", expr="v + w", config=BinConfig(0, 8, 2)))])
def test_cubes_answer_as_direct_counts(table, active, pixels, passive):
    df, rows = table
    if len(passive.dimensions) == 2:
        passive = View2D(X, W if len(active) == 1 else Dimension("x", config=BinConfig(-1, 1, 1)))
    rnd = random.Random(5)
    s = cube.build_slice(df, active, pixels, passive, {"x": (-0.5, 0.5)} if not passive.dimensions else {}, DIMS)
    fixed = {} if passive.dimensions else {"x": (-0.5, 0.5)}
    assert {tuple(r[k] for k in s.keys): r["value"] for r in lookup.cleared(s).collect() if r["value"]} == direct(rows, passive, fixed)
    for _ in range(4):
        brush, at = dict(fixed), []
        for d, p in zip(active, pixels, strict=True):
            a, b = sorted((rnd.randint(0, p), rnd.randint(0, p)))
            fine = d.config.resized(p)
            brush[d.name] = (fine.start + a * fine.step, fine.start + b * fine.step)
            at.append(lookup.edges((brush[d.name][1], brush[d.name][0]), d.config, p))
            assert at[-1] == (a, b)
        got = {tuple(r[k] for k in s.keys): r["value"] for r in lookup.brushed_counts(s, at).collect()}
        want = direct(rows, passive, brush)
        assert {k: v for k, v in got.items() if v} == want
    whole = [(0, p) for p in pixels]
    half = [(a + 0.5, b - 0.5) for a, b in whole]
    sums = [sum(r["value"] for r in lookup.brushed_counts(s, x).collect()) for x in (whole, half)]
    assert sums[1] < sums[0]
    cut = lookup.brushed_counts(s, half, truncate=True).schema["value"].dataType.simpleString()
    assert cut == "bigint"


def test_fused_slices_equal_single_ones(table):
    df, _ = table
    views = {"n": View0D(), "x": View1D(X), "xw": View2D(X, W)}
    brushes = {"x": (-0.5, 0.75), "w": (1.0, 3.0)}
    counts = fused.fused_counts(df, [V], [10], views, brushes, DIMS)
    for name, s in fused.fused_slices(counts, [10], views).items():
        one = cube.build_slice(df, [V], [10], views[name], brushes, DIMS)
        assert sorted(map(tuple, s.cumulative.collect())) == sorted(map(tuple, one.cumulative.collect()))
        assert sorted(map(tuple, s.no_brush.collect())) == sorted(map(tuple, one.no_brush.collect()))
    with pytest.raises(ValueError, match="cells"):
        cube.build_slice(df, [V], [10], View1D(X), {}, DIMS, max_cells=20)


def test_session(table):
    df, rows = table
    seen = []
    s = Crossfilter(df, {"v": View1D(Dimension("v", 10, (0, 10))), "x": View1D(X), "vw": View2D(V, W), "n": View0D()}, logger=lambda *a: seen.append(a))
    assert set(s.initial()) == {"v", "x", "vw", "n"} and s.pixels("v") == (600,) and s.pixels("vw") == (80, 80) and s.pixels("v", True) == (10,)
    got = s.brush("x", (0.5, -0.5))
    want = direct(rows, View1D(V), {"x": (-0.5, 0.5)})
    assert {(r["key"],): r["value"] for r in got["v"].collect() if r["value"]} == want
    got = s.brush("v", (2.0, 7.0))
    assert got["n"].first()["value"] == direct(rows, View0D(), {"x": (-0.5, 0.5), "v": (2.0, 7.0)})[()]
    assert {(r["key"],): r["value"] for r in got["x"].collect() if r["value"]} == direct(rows, View1D(X), {"v": (2.0, 7.0)})
    charts = s.charts()
    assert {(r["key"],): r["value"] for r in charts["x"].collect() if r["value"]} == direct(rows, View1D(X), {"v": (2.0, 7.0)})
    coarse = s.activate("v", progressive=True)
    assert coarse["n"].pixels == (10,)
    zoomed = s.zoom("v", (3.0, 5.0)).collect()
    assert zoomed[0]["key_start"] == 2.0 and s.views["vw"].x.config.stop == 7.0
    cleared = s.clear("v")
    assert cleared["n"].first()["value"] == direct(rows, View0D(), {"x": (-0.5, 0.5)})[()] and len(seen) == 3
    s.prefetch()
    with pytest.raises(ValueError, match="count"):
        s.activate("n")
    s.close()
    assert Crossfilter(df, {"v": View1D(V), "n": View0D()}, Config(interpolate=True)).brush("v", (0.01, 9.99))["n"].first()["value"] > 0


@pytest.mark.parametrize("progressive", [True, "only2D"])
def test_progressive_session_refines(table, progressive):
    df, rows = table
    s = Crossfilter(df, {"v": View1D(Dimension("v", 10, (0, 10))), "x": View1D(X), "vw": View2D(V, W), "n": View0D()}, Config(progressive=progressive))

    def check(got, brushes):
        assert got["n"].first()["value"] == direct(rows, View0D(), brushes)[()] > 0
        assert {(r["key"],): r["value"] for r in got["x"].collect() if r["value"]} == direct(rows, View1D(X), brushes)

    one, bins = {"v": (2.05, 7.4)}, {"v": (2.0, 7.0)}
    check(s.brush("v", one["v"]), bins if progressive is True else one)
    check(s.refine(), one)
    check(s.brush("v", (3.15, 8.65)), {"v": (3.15, 8.65)})
    check(s._counts("v", s.activate("v", progressive=True)), {"v": (3.0, 9.0)})  # 3.15 and 8.65 to the nearest bins
    check(s.brush("v", (1.25, 4.6)), {"v": (1.25, 4.6)})
    assert s.clear("v")["n"].first()["value"] == direct(rows, View0D(), {})[()]
    (a, b), (c, d) = [(low, low + 20 * step) for low, step in ((k.config.start + 7 * p, p) for k in s.views["vw"].dimensions for p in [k.config.resized(80).step])]
    s.brush("vw", (a, b), (c, d))
    assert s._slices["vw"][0] == s.pixels("vw", True) != s.pixels("vw")
    assert s.refine()["n"].first()["value"] == direct(rows, View0D(), {"v": (a, b), "w": (c, d)})[()]
    s.close()
    with pytest.raises(ValueError, match="active"):
        Crossfilter(df, {"v": View1D(V), "n": View0D()}).refine()


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.hour_of_hhmm(F.lit("2400")).alias("a"), scalars.hour_of_hhmm(F.lit(1430)).alias("b"), scalars.hour_of_hhmm(F.lit("x")).alias("c"),
        scalars.absolute_magnitude(F.lit(5.0), F.lit(100.0)).alias("d"), scalars.absolute_magnitude(F.lit(5.0), F.lit(-1.0)).alias("e"),
        scalars.clamp(F.lit(7.0), 0.0, 5.0).alias("f"), scalars.share(F.lit(1), F.lit(0)).alias("g"), scalars.epoch_millis(F.lit("1970-01-02").cast("date")).alias("h"),
        scalars.parsed_date(F.lit("nope"), "yyyy-MM-dd", "yyyyMMdd").alias("i"),
    ).first()
    assert tuple(row) == (0.0, 14.5, None, 5.0, None, 5.0, None, 86_400_000, None)
    assert scalars.compact(" a \n b\t c ") == "a b c"
    assert lookup.screen_edges((10, 30), 10, 8, flipped=True) == (5, 7)


def scan_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(line for line in plan.split("\n") if "PushedFilters" in line)


def test_brushes_reach_the_scan(spark, tmp_path):
    days = spark.range(4000).select(
        F.col("id").cast("double").alias("v"), F.expr("timestamp_seconds(id * 43200)").alias("ts"), F.expr("cast(timestamp_seconds(id * 43200) as timestamp_ntz)").alias("ntz"),
        F.expr("cast(timestamp_seconds(id * 43200) as date)").alias("day"), F.expr("cast(id / 7 as decimal(12, 2))").alias("price"), (F.col("id") * 3).alias("big"),
    )
    days.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    low, high = 200 * DAY + 3.5, 900 * DAY + 0.5
    for name, brush, time in (("ts", (low, high), True), ("ntz", (low, high), True), ("day", (low, high), True), ("price", (100.005, 300.115), False), ("big", (30.5, 6000.0), False)):
        d = Dimension(name, config=BinConfig(*brush, (brush[1] - brush[0]) / 10), time=time)
        dims = {name: d}
        for closed in (False, True):
            got = cube.build_slice(df, [Dimension("v", config=BinConfig(0, 4000, 400))], [10], View0D(), {name: brush}, dims, closed=closed)
            assert f"GreaterThanOrEqual({name}" in scan_filters(got.counts) and f"LessThanOrEqual({name}" in scan_filters(got.counts)
            plain = df.where((d.value() >= brush[0]) & ((d.value() <= brush[1]) if closed else (d.value() < brush[1]))).count()
            assert got.no_brush.first()["cnt"] == plain > 0
        hist = aggregates.histogram(df, View1D(d))
        assert sum(r["no_brush"] for r in hist.collect()) == df.where((d.value() >= brush[0]) & (d.value() < brush[1])).count()
    wide = Dimension("price", config=BinConfig(-1e12, 1e12, 1e11))
    assert aggregates.row_count(df, {"price": (-1e12, 1e12)}, {"price": wide}).first()["value"] == 4000


def test_only_the_latest_job_counts(spark):
    import threading
    import time

    from tidemark.plans.runner import Runner

    runner, seen, started = Runner(spark), [], threading.Event()

    def slow():
        started.set()
        return spark.range(8).repartition(8).mapInPandas(lambda parts: (time.sleep(20) or p for p in parts), "id long").count()

    first = runner.run("index", slow, seen.append)
    assert started.wait(20)
    time.sleep(1)
    began = time.perf_counter()
    second = runner.run("index", lambda: spark.range(5).count(), seen.append)
    assert second.result(60) == 5 == runner.result("index") and first.cancelled() and time.perf_counter() - began < 15
    with pytest.raises(ValueError, match="no"):
        runner.run("bad", lambda: (_ for _ in ()).throw(ValueError("no"))).result(20)
    runner.cancel_all()
    time.sleep(0.2)
    assert seen == [5]


def test_refines_in_background_and_flags_coarse_counts(table):
    df, rows = table
    s = Crossfilter(df, {"v": View1D(Dimension("v", 10, (0, 10))), "x": View1D(X), "n": View0D()}, Config(progressive=True))
    assert s.brush("v", (2.05, 7.4))["n"].first()["value"] == direct(rows, View0D(), {"v": (2.0, 7.0)})[()] and s.approximate
    fine = s.refine_in_background().result(60)
    assert fine["n"].first()["value"] == direct(rows, View0D(), {"v": (2.05, 7.4)})[()] and not s.approximate
    s.brush("x", (-0.5, 0.5))
    s.close()


def test_closed_ends_order_and_summaries(table):
    df, rows = table
    brushes = {"x": (-0.5, 0.5)}
    got = aggregates.heatmap(df, View2D(V, W), {"v": (0, 3), "x": (-0.5, 0.5)}, DIMS, closed=True)
    total = sum(r["value"] for r in got.collect())
    assert total == sum(ok(r[1], 0, 10) and ok(r[2], 0, 4) and -0.5 <= r[3] <= 0.5 for r in rows)
    ordered = [r["key"] for r in aggregates.in_order(aggregates.histogram(df, View1D(V), brushes, DIMS)).collect()]
    assert ordered == sorted(ordered)
    d = {r["name"]: r for r in aggregates.described(df.where("not isnan(v) and abs(v) < 1e9")).collect()}
    assert set(d) == {"id", "v", "w", "x"} and d["id"]["low"] == 4.0 - 4 and d["w"]["n"] < d["x"]["n"] and d["x"]["q25"] < d["x"]["median"] < d["x"]["q75"]
    assert aggregates.described(df.select(F.lit("a").alias("a"))).count() == 0
    pairs = df.agg(F.collect_list("id").alias("a"), F.collect_list("id").alias("b c"))
    assert scalars.rows_of(pairs, "a", "b c").count() == 800
    hist = aggregates.histogram(df, View1D(V), brushes, DIMS)
    assert {r["series"] for r in aggregates.series(hist, show_base=False).collect()} == {"brushed"} and aggregates.series(hist).count() == 20


def test_fused_charts_equal_single_ones(table):
    df, _ = table
    views, brushes = {"n": View0D(), "x": View1D(X), "xw": View2D(X, W)}, {"x": (-0.5, 0.75), "v": (1.0, 8.0)}
    for closed in (False, True):
        charts = fused.fused_charts(fused.fused_totals(df, views, brushes, DIMS, closed), views)
        for name, got in charts.items():
            want = aggregates.shown(df, views[name], brushes, DIMS, closed)
            assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    empty = fused.fused_charts(fused.fused_totals(df.limit(0), views, {}, DIMS), views)
    assert tuple(empty["n"].first()) == (0, 0) and empty["x"].count() == 4


def test_prefetched_slices_answer(table):
    df, rows = table
    s = Crossfilter(df, {"v": View1D(V), "x": View1D(X), "n": View0D()})
    s.prefetch()
    assert set(s._slices) == {"v", "x"} and s.active is None
    held = s._slices["v"][1]
    assert s.brush("v", (2.0, 7.0))["n"].first()["value"] == direct(rows, View0D(), {"v": (2.0, 7.0)})[()] and s._slices["v"][1] is held
    plan = s.brush("v", (3.0, 6.0))["x"]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "InMemoryTableScan" in plan
    s.close()
