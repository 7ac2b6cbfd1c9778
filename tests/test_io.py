import datetime
import functools
import http.server
import json
import threading

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions.binning import nice_bins
from tidemark.operators import cube
from tidemark.sources import prepare, readers, writers
from tidemark.spec import BinConfig, Dimension, View1D
from tidemark.streaming import live

V = Dimension("v", config=nice_bins(10, (0, 100)))
W = Dimension("w", config=BinConfig(0, 10, 1))


def test_files(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") * 1.5).alias("v"), F.lit(datetime.date(2020, 1, 2)).alias("day"))
    writers.parquet(df, f"{tmp_path}/p")
    assert readers.parquet(spark, f"{tmp_path}/p").count() == 100 and spark.sql("select count(*) from data").first()[0] == 100
    writers.json(df, f"{tmp_path}/j")
    assert readers.json(spark, f"{tmp_path}/j", df.schema, whole_file=False).exceptAll(df).count() == 0
    made = writers.arrow_files(df.repartition(3), f"{tmp_path}/a").collect()
    assert sum(r["rows"] for r in made) == 100
    assert readers.arrow_files(spark, [r["path"] for r in made]).exceptAll(df).count() == 0
    with pa.OSFile(f"{tmp_path}/s.arrows", "wb") as f, pa.ipc.new_stream(f, df.toArrow().schema) as w:
        w.write_table(df.toArrow())
    assert readers.arrow_files(spark, [f"{tmp_path}/s.arrows"]).count() == 100
    shown = json.loads(writers.columnar_json(df.limit(3), "id"))
    assert shown["id"] == [0, 1, 2] and shown["day"][0] == 1577923200
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n2\t\n")
    assert [tuple(r) for r in readers.delimited(spark, f"{tmp_path}/t.tsv", "a int, b string", "\t").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.json(spark, f"{tmp_path}/r.json").count() == 2
    assert [r["name"] for r in readers.described(df).collect()] == df.columns


def test_http(spark, tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            sink = pa.BufferOutputStream()
            table = pa.table({"n": pa.array([len(self.path)], pa.int64())})
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(sink.getvalue().to_pybytes())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        schema = spark.range(1).select(F.col("id").alias("n")).schema
        df = readers.http_arrow(spark, f"http://127.0.0.1:{server.server_port}/?q=", ["select 1", "select 22"], schema)
        assert sorted(r["n"] for r in df.collect()) == [len("/?q=select%201"), len("/?q=select%2022")]
    finally:
        server.shutdown()


def test_sql_server(spark):
    url = "jdbc:derby:memory:tidemark;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).select(F.col("id").alias("n"), (F.col("id") % 7).cast("double").alias("v")).write.jdbc(url, "t", "overwrite", options)
    # Spark's writer quotes names, and Derby is strict about their case
    query = 'select "n", "v" from t where "n" < 60'
    whole = readers.sql_server(spark, url, query, **options)
    parts = readers.sql_server(spark, url, query, ("n", 0, 60, 4), **options)
    assert whole.count() == parts.count() == 60 and parts.rdd.getNumPartitions() == 4
    assert cube.build_slice(parts, [Dimension("n", config=BinConfig(0, 60, 6))], [10], View1D(Dimension("v", config=BinConfig(0, 7, 1))), {}, {}).cumulative.where("pixel = 10").agg(F.sum("cum")).first()[0] == 60


def test_preparation(spark):
    df = spark.createDataFrame([("2400", None, 3), ("0915", 20, None), ("1430", 10, 1)], "t string, w int, k int")
    out = prepare.complete(prepare.scaled(prepare.filled(prepare.times_of_day(df, ["t"]), ["w"]), ["w"]))
    assert sorted(map(tuple, prepare.typed(prepare.renamed(out, {"t": "hour"}), {"k": "short"}).collect())) == [(0.0, 0.0, 3), (14.5, 1.0, 1)]
    assert [r["t"] for r in prepare.first_rows(df, 2, "t").collect()] == ["0915", "1430"]


def test_streams(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 120).cast("double").alias("v"), (F.col("id") % 11).cast("double").alias("w"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    for i in range(3):
        rows.where(F.col("v") % 3 == i).write.mode("append").parquet(f"{tmp_path}/in")
    stream = functools.partial(lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in"))
    made = live.live_histogram(stream(), View1D(V), {"w": (0.0, 5.0)}, {"w": W})
    q = made.writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r["key"]: (r["no_brush"], r["value"]) for r in spark.table("live").collect()}
    values = [(i % 120, i % 11) for i in range(1000)]
    assert got == {k: (sum(v // 10 == k for v, _ in values), sum(v // 10 == k and w < 5 for v, w in values)) for k in range(10)}
    q = live.live_counts(stream(), [V], [10], View1D(W), {}, {}).writeStream.format("memory").queryName("cells").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    s = cube.assemble(spark.table("cells"), [10], [10])
    one = cube.build_slice(rows, [V], [10], View1D(W), {}, {})
    assert sorted(map(tuple, s.cumulative.collect())) == sorted(map(tuple, one.cumulative.collect()))
    q = live.windowed_histogram(stream(), View1D(V), "ts", "1 hour", "1000 days").writeStream.format("memory").queryName("hours").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").count() > 0


def test_log(spark):
    log = live.InteractionLog(spark)
    log("a", {"v": (1.0, 2.0)})
    log("b", {"w": (1.0, 2.0)})
    log("a", {"v": None})
    rows = log.table().collect()
    assert [(r["dimension"], r["active"], r["action"]) for r in rows] == [("v", True, "create"), ("w", True, "create"), ("v", False, "keep"), ("v", True, "clear"), ("w", False, "keep")]
    assert {(r["dimension"], r["action"]): r["changes"] for r in log.by_dimension().collect()} == {("v", "create"): 1, ("w", "create"): 1, ("v", "clear"): 1}
    took = []
    assert live.timed(lambda: 5, took.append) == 5 and took
