"""Tables out: Parquet, JSON, column-wise JSON and Arrow files."""

from __future__ import annotations

import json as json_
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def columnar_json(df: DataFrame, order: str, rows: int = 1_000_000) -> str:
    """One object with an array for each column, in order of a column; dates as seconds since 1970.

    For charts and samples: the result is one string, so more than `rows` rows are refused.
    """
    seconds = [F.unix_seconds(F.col(n).cast("timestamp")).alias(n) if t in ("date", "timestamp", "timestamp_ntz") else F.col(n) for n, t in df.dtypes]
    found = df.orderBy(order).select(*seconds).limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows")
    return json_.dumps({n: [r[n] for r in found] for n in df.columns})


def arrow_files(df: DataFrame, folder: str) -> DataFrame:
    """Write one Arrow IPC file for each partition, now and once; (path, rows) of those that count.

    The folder must be shared by executors. A task that is run again writes a file of another name, so read those listed.
    The driver gets a row for each partition.
    """
    from pyarrow import fs

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows = None, 0
        store, at = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        path = f"{at}/part-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            if writer is None:
                store.create_dir(at, recursive=True)
                sink = store.open_output_stream(path)
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rows])], ["path", "rows"])

    made = df.select(*names).mapInArrow(run, "path string, rows long").collect()
    return df.sparkSession.createDataFrame(sorted(map(tuple, made)), "path string, rows long")
