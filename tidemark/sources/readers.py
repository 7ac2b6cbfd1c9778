"""Tables in: Parquet, delimited text, JSON, Arrow files, SQL servers and Arrow over HTTP."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema


def parquet(spark: SparkSession, path: str, view: str | None = "data") -> DataFrame:
    """A Parquet table, registered as a temporary view unless view is None."""
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def sql(df: DataFrame, query: str, log=None) -> DataFrame:
    """A query in SQL over a table that it calls {data}; a QueryLog, where given, runs it and logs its rows and time."""
    found = df.sparkSession.sql(query, data=df)
    if log is not None:
        log.run(query, found)
    return found


def described(df: DataFrame) -> DataFrame:
    """(name, type, nullable) of every column."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")


def delimited(spark: SparkSession, path: str, schema: T.StructType | str, separator: str = ",", header: bool = True) -> DataFrame:
    """Comma or tab separated text with a given schema, so that it is read once."""
    return spark.read.csv(path, schema=schema, sep=separator, header=header)


def json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, whole_file: bool = True) -> DataFrame:
    """JSON records; whole_file for files that hold one array."""
    return spark.read.json(path, schema=schema, multiLine=whole_file)


def arrow_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Arrow IPC files (or streams), one after another in each task; the driver reads a schema alone.

    Paths must be readable on every executor through pyarrow's file systems.
    """
    from pyarrow import fs

    def opened(path: str):
        store, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        source = store.open_input_file(at)
        try:
            file = pa.ipc.open_file(source)
            return file.schema, (file.get_batch(i) for i in range(file.num_record_batches))
        except pa.ArrowInvalid:
            source.seek(0)
            stream = pa.ipc.open_stream(source)
            return stream.schema, iter(stream)

    schema = from_arrow_schema(opened(paths[0])[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for part in opened(path)[1]:
                    yield pa.RecordBatch.from_arrays([part.column(f.name) for f in schema], schema.names)

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(len(paths), F.col("path")).mapInArrow(run, schema)


def sql_server(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query on a JDBC server, in parallel ranges of a column (name, low, high, parts) where given."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    name, low, high, parts = partition
    return reader.option("dbtable", f"({query}) q").option("partitionColumn", name).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def http_arrow(spark: SparkSession, url: str, queries: Sequence[str], schema: T.StructType, escape: Callable[[str], str] = quote) -> DataFrame:
    """Answers of a server that takes SQL in its address and gives Arrow; each query is fetched by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query in batch.column(0).to_pylist():
                with urlopen(url + escape(query)) as answer:  # noqa: S310
                    for part in pa.ipc.open_stream(answer):  # batch by batch, as they arrive
                        yield pa.RecordBatch.from_arrays([part.column(n) for n in schema.names], schema.names)

    return spark.createDataFrame([(q,) for q in queries], "query string").repartition(len(queries), F.col("query")).mapInArrow(run, schema)
