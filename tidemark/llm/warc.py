"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key over the whole table and written as one gzip member each. Every archive
has an index of compressed blocks of sorted capture lines, and a sparse directory with the first key of each block. A
lookup finds the archives by their key ranges and the blocks by bisection of their directories; keys then go to their
blocks, which are searched by bisection, and only the bytes of the records found are read. Blocks are bounded by captures
and bytes, so a URL with very many captures spreads over many of them.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, slices, written

#: Captures in an index block, and the payload bytes after which one is closed.
BLOCK_LINES, BLOCK_BYTES = 256, 4 << 20
#: Bytes of payloads that a batch holds before it is handed on, and the least that is read of an archive at once.
BATCH_BYTES, AHEAD = 8 << 20, 64 << 10
#: Payloads shorter than this are never revisits.
LEAST_BYTES = 1000
#: Shared payloads (some 200 bytes each) up to which they are broadcast. Spark itself would choose a broadcast only once
#: the pages are shuffled.
MOST_BROADCAST = 100_000
#: Archive bytes that a task reads back, about.
READ_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
_CAPTURE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def url_key(url: Column) -> Column:
    """Host parts in reverse, joined by commas, then ")" and the rest without its fragment; other strings as they are."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    rest = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    reversed_ = F.array_join(F.reverse(F.split(host, "\\.")), ",")
    return F.when(host != "", F.concat(reversed_, F.lit(")"), rest)).otherwise(F.coalesce(url, F.lit("")))


def captures(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload and what each record is, with the id and URL that a revisit refers to.

    Of records with equal payloads of least_bytes or more, that with the largest page_id is the response and the others
    revisit it (rows of that same id are responses too); a null id revisits, unless all ids of the payload are null.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = df.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest"),
    )
    # a payload that occurs once needs no lookup; digests and ids are combined before the shuffle
    shared = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(shared, "payloads")
    # few shared payloads are sent to every executor, which spares the pages a shuffle; more are joined by one
    side = F.broadcast(shared) if shared.count() <= MOST_BROADCAST else shared
    joined = rows.join(side, ["payload_digest", "payload_bytes"], "left")
    revisits = F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first.page_id")).alias("refers_to"),
        F.when(revisits, F.col("first.url")).alias("refers_to_url"),
    )


def _filesystem(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder))


def _uri(folder: str) -> str:
    return "file://" + folder[len("file:") :] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def _line(value: str) -> str:
    """A header value on one line: only the line breaks that would end it are coded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page: dict, place: str) -> bytes:
    """The bytes of a WARC record. place, the archive and the offset in it, makes its id, so that ids never repeat."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {page['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Date: {DATE}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(page["payload_digest"])).decode(),
        f"X-Page-ID: {'' if page['page_id'] is None else page['page_id']}",
        f"X-Payload-Bytes: {page['payload_bytes']}",
    ]
    if page["url"] is not None:
        head.append("WARC-Target-URI: " + _line(page["url"]))
        if _line(page["url"]) != page["url"]:
            head.append("X-Target-URI-JSON: " + json.dumps(page["url"]))
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if page["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {page['refers_to']}"]
        if page["refers_to_url"] is not None:
            head.append("WARC-Refers-To-Target-URI: " + _line(page["refers_to_url"]))
    else:
        body += page["payload"].encode()
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's capture; the payload of a revisit is None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    number = lambda name: int(fields[name]) if fields.get(name) else None
    url = json.loads(fields["X-Target-URI-JSON"]) if "X-Target-URI-JSON" in fields else fields.get("WARC-Target-URI")
    return {
        "page_id": number("X-Page-ID"),
        "url": url,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page"),
        "payload_bytes": number("X-Payload-Bytes"),
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "payload": None if fields["WARC-Type"] == "revisit" else body.partition(b"\r\n\r\n")[2].decode(),
    }


def _checked(raw: bytes) -> dict:
    """A record's capture; one whose payload does not match its digest fails the job."""
    page = parse(zlib.decompress(raw, 31))
    data = (page["payload"] or "").encode()
    if page["record_type"] == "response" and (hashlib.sha1(data).hexdigest() != page["payload_digest"] or len(data) != page["payload_bytes"]):
        raise ValueError(f"page {page['page_id']}: payload and digest differ")
    return page


def _gzip(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def _members(data: bytes) -> Iterator[bytes]:
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data) + one.flush()
        data = one.unused_data


def write_archives(df: DataFrame, folder: str | None = None, partitions: int | None = None, block_lines: int = BLOCK_LINES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write captures() to archives with their index; the block directory, one row for each index block.

    Directory rows: archive, first_key, last_key, at, size (of the block in the archive's index), n, warc_at, warc_size
    (of its records). A task that is run again writes files of another name and only the rows of the attempt that
    counted are kept. The folder must be one that all executors write to; the default lies in the shared folder.
    """
    spark = df.sparkSession
    folder = _uri(folder or os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}"))
    keyed = df.withColumn("key", url_key(F.col("url")))
    order = ["key", "page_id", "payload_digest"]  # so that captures of one URL can be dealt to several tasks
    ranged = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _filesystem(folder)
        name, rows, lines = f"part-{uuid.uuid4().hex}", [], []
        warc = index = None
        where, block_at, begun, held = 0, 0, 0, 0

        def close_block() -> None:
            nonlocal block_at, begun, lines, held
            block = _gzip("\n".join(lines).encode())
            index.write(block)
            first, last = (json.loads(x)[0] for x in (lines[0], lines[-1]))
            rows.append((name, first, last, block_at, len(block), len(lines), begun, where - begun))
            block_at, begun, lines, held = block_at + len(block), where, [], 0

        for page in (p for batch in batches for part in slices(batch, "payload", 1 << 20) for p in part.to_pylist()):
            if warc is None:
                store.create_dir(at, recursive=True)
                warc = store.open_output_stream(f"{at}/{name}.warc.gz", compression=None)
                index = store.open_output_stream(f"{at}/{name}.cdx.gz", compression=None)
            raw = _gzip(record(page, f"{name}/{where}"))
            warc.write(raw)
            lines.append(json.dumps([page["key"], page["page_id"], where, len(raw)]))
            where, held = where + len(raw), held + page["payload_bytes"]
            if len(lines) == block_lines or held >= block_bytes:
                close_block()
        if warc is not None:
            if lines:
                close_block()
            warc.close()
            index.close()
            with store.open_output_stream(f"{at}/{name}.dir", compression=None) as f:
                f.write(json.dumps(rows).encode())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(folder, *r) for r in rows], strict=True)], names)

    names = ["folder", "archive", "first_key", "last_key", "at", "size", "n", "warc_at", "warc_size"]
    schema = "folder string, archive string, first_key string, last_key string, at long, size long, n long, warc_at long, warc_size long"
    return written(ranged.sortWithinPartitions(*order).mapInArrow(run, schema), "directory")


def _opened(folder: str, name: str):
    store, base = _filesystem(folder)
    return store.open_input_file(f"{base}/{name}")


def _lines(index: bytes) -> list[list]:
    """The capture lines of an index block: key, page_id, offset and size of the record."""
    return [json.loads(x) for x in zlib.decompress(index, 31).decode().split("\n")]


def _batches(found: Iterator[tuple[str, dict]]) -> Iterator[pa.RecordBatch]:
    """(key, capture) as batches of about BATCH_BYTES."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.string()}
    keys, pages, held = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([p[k] for p in pages], t) for k, t in kinds.items())], ["key", *kinds])

    for key, page in found:
        keys.append(key)
        pages.append(page)
        held += len(page["payload"] or "") + 200
        if held >= BATCH_BYTES:
            yield batch()
            keys, pages, held = [], [], 0
    if pages:
        yield batch()


def _tasks(directory: DataFrame) -> int:
    """How many tasks read archives: rows of a directory are small, so Spark would take too few."""
    size = directory.agg(F.count("*").alias("n"), F.sum("warc_size").alias("bytes")).first()
    least = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(size["n"], max(least, (size["bytes"] or 0) // READ_BYTES)))


def read_archives(directory: DataFrame) -> DataFrame:
    """Every capture, read back block by block: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    The payload of a revisit is null. A record whose bytes do not match its digest fails the job.
    """

    def captured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict]]:
        for batch in batches:
            for block in batch.to_pylist():
                with _opened(block["folder"], f"{block['archive']}.cdx.gz") as index, _opened(block["folder"], f"{block['archive']}.warc.gz") as warc:
                    for key, _, at, size in _lines(index.read_at(block["size"], block["at"])):
                        yield key, _checked(warc.read_at(size, at))

    blocks = directory.repartition(_tasks(directory), F.col("archive"), F.col("at"))
    return blocks.mapInArrow(lambda batches: _batches(captured(batches)), "key string, " + _CAPTURE).drop("key")


@lru_cache(maxsize=64)
def _directory(folder: str, archive: str) -> list[list]:
    with _opened(folder, f"{archive}.dir") as f:
        return json.loads(f.read())


def lookup(urls: DataFrame, directory: DataFrame, url: str = "url") -> DataFrame:
    """The captures of each distinct URL key in urls: key and the columns of read_archives().

    The driver gets one row for each archive (its key range), no more than spark.sql.shuffle.partitions or the partitions
    asked for; the directories of blocks stay beside the archives and are read where a key falls into their range. Null
    URLs have the empty key. Keys without captures give nothing.
    """
    tops = directory.groupBy("folder", "archive").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()
    # bisection must order keys as Spark does: by their UTF-8 bytes
    tops = sorted((r["low"].encode(), r["high"].encode(), r["folder"], r["archive"]) for r in tops)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that may hold a key."""
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                want = key.encode()
                for low, high, folder, archive in tops[: bisect.bisect_right(tops, want, key=lambda t: t[0])]:
                    if high < want:
                        continue
                    blocks = _directory(folder, archive)
                    at = max(0, bisect.bisect_left(blocks, want, key=lambda b: b[1].encode()) - 1)
                    while at < len(blocks) and blocks[at][1].encode() <= want:
                        if blocks[at][2].encode() >= want:
                            out.append((key, folder, archive, *blocks[at][3:5], blocks[at][6] + blocks[at][7]))
                        at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "folder", "archive", "at", "size", "upto"])

    def captured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict]]:
        """The records of keys that come by archive, block and key, read in order of their places."""
        index = warc = archive = block = None
        begin, held = 0, b""
        try:
            for r in (r for batch in batches for r in batch.to_pylist()):
                if r["archive"] != archive:
                    for f in (index, warc):
                        if f:
                            f.close()
                    archive, block, held = r["archive"], None, b""
                    index, warc = _opened(r["folder"], f"{archive}.cdx.gz"), _opened(r["folder"], f"{archive}.warc.gz")
                if r["at"] != block:
                    block, lines = r["at"], _lines(index.read_at(r["size"], r["at"]))
                    keys = [x[0].encode() for x in lines]
                want = r["key"].encode()
                i = bisect.bisect_left(keys, want)
                while i < len(lines) and keys[i] == want:
                    _, _, at, size = lines[i]
                    if not begin <= at <= at + size <= begin + len(held):
                        begin, held = at, warc.read_at(max(size, min(AHEAD, r["upto"] - at)), at)
                    yield r["key"], _checked(held[at - begin : at - begin + size])
                    i += 1
        finally:
            for f in (index, warc):
                if f:
                    f.close()

    # keys by range, so that a task reads the directories of few archives
    keys = urls.select(url_key(F.col(url)).alias("key")).distinct().repartitionByRange("key")
    placed = keys.mapInArrow(places, "key string, folder string, archive string, at long, size long, upto long")
    placed = placed.repartition(_tasks(directory), "archive", "at").sortWithinPartitions("archive", "at", "key")
    return placed.mapInArrow(lambda batches: _batches(captured(batches)), "key string, " + _CAPTURE)
