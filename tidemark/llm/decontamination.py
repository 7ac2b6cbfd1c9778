"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be long, so the sketch is the item's: of an item's shingles, those with the k
smallest hashes are a sample without replacement, and the share of them that a document holds estimates the containment.
Items are partitioned by size, each partition with its own k and number of hits, which a document that just reaches the
threshold misses with a chance of MISS at most. A document with that many hits holds one of any k - hits + 1 of the
sketch, so the search joins documents with the rarest of each sketch alone; candidates are then counted on the whole
sketch, and those left are verified on all shingles of the item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import shingles
from tidemark.llm.bloom import bloom_filter
from tidemark.llm.common import drop_written, slices, without, written

MISS = 1e-6
#: Hashes in the sketch of a large item.
WIDEST = 32
#: Partitions up to this size are planned by the exact chance for each size in them.
EXACT = 64
_ITEM = "item_id long, print binary, part long, n_item long, need int, width int, sketch array<long>, full array<long>"


def plan_for(size: int, percent: int, widest: int = WIDEST, miss: float = MISS) -> tuple[int, int]:
    """(sketch size, hits needed) of an item with size shingles.

    Sketches are drawn without replacement, so the hypergeometric chance of too few hits bounds what is lost.
    """
    share = percent / 100
    k = min(size, widest)
    held = math.ceil(share * size)
    best = 1
    for need in range(1, k + 1):
        few = sum(math.comb(held, h) * math.comb(size - held, k - h) for h in range(need) if 0 <= k - h <= size - held) / math.comb(size, k)
        if few > miss:
            break
        best = need
    return k, best


@cache
def partition_plan(top: int, percent: int, widest: int = WIDEST, miss: float = MISS) -> tuple[int, int]:
    """(sketch size, hits needed) for all items of more than top / 2 and at most top shingles.

    Small partitions take the least number of hits of their sizes. For others Hoeffding's bound of the relative entropy
    holds for draws without replacement, whatever the size.
    """
    k = min(top // 2 + 1, widest)
    if top <= EXACT:
        return k, min(plan_for(size, percent, k, miss)[1] for size in range(top // 2 + 1, top + 1))
    share = percent / 100

    def chance(hits: int) -> float:
        x = hits / k
        entropy = (x * math.log(x / share) if x else 0.0) + ((1 - x) * math.log((1 - x) / (1 - share)) if x < 1 and share < 1 else 0.0)
        return math.exp(-k * entropy) if share < 1 else float(x >= 1)

    return k, max([1, *(hits + 1 for hits in range(k) if hits < share * k and chance(hits) <= miss)])


def _items(percent: int, widest: int):
    """Each item text with its print (equal for equal shingle sets), size partition, sketch and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = shingles.word_hashes(text)
                    found = np.unique(shingles.window_hashes(words))
                    if not len(found):
                        continue
                    part = 1 << (len(found) - 1).bit_length()
                    k, need = partition_plan(part, percent, widest)
                    smallest = found[np.argsort(shingles.mix(found), kind="stable")[:k]]
                    rows.append((item, xxhash.xxh3_128_digest(found.tobytes()), part, len(found), need, min(len(words), shingles.SIZE), smallest.view(np.int64), found.view(np.int64)))
                if rows:
                    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["item_id", "print", "part", "n_item", "need", "width", "sketch", "full"])

    return run


def _probe(shared, widths: list[int]):
    """The shingles of documents that may be an item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, hits = [], []
                for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = shingles.word_hashes(t)
                    for width in widths:
                        if len(words) < width:
                            continue
                        found = shingles.window_hashes(words, width)
                        found = np.unique(found[shared.value.may_hold(found)])
                        ids.append(np.full(len(found), doc, dtype=np.int64))
                        hits.append(found.view(np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(hits))], ["doc_id", "shingle"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", widest: int = WIDEST) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) where a document holds at least percent of an item's distinct shingles.

    Shingles are five words, A-Z lower-cased; an item with fewer words is one shingle of that many words. Items and
    documents without words match nothing, null ids neither; rows that share a document's id count as one document,
    rows that share an item's id as separate texts of which the one with most shared shingles is reported, and repeated
    rows count once. Documents and items may both be of any size: nothing is broadcast but a filter of bounded size,
    which keeps shingles that no item has in their tasks, and what Spark finds small.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null")
    table = written(wanted.mapInArrow(_items(percent, widest), _ITEM), "items")
    texts = table.dropDuplicates(["print"])
    widths = sorted(r["width"] for r in table.select("width").distinct().collect())  # of 1 to 5
    shared = spark.sparkContext.broadcast(bloom_filter(texts.select(F.explode("full").alias("shingle"))))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    found = written(rows.mapInArrow(_probe(shared, widths), "doc_id long, shingle long").distinct(), "shingles")

    sketches = texts.select("print", "need", F.size("sketch").alias("k"), F.explode("sketch").alias("shingle"))
    rarity = sketches.groupBy("shingle").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("print").orderBy("n", "shingle"))  # k rows for each print
    rarest = sketches.join(rarity, "shingle").withColumn("rank", rank).where("rank <= k - need + 1").select("shingle", "print")
    candidates = found.join(rarest, "shingle").select("doc_id", "print").distinct()
    likely = (
        candidates.join(sketches.select("print", "need", "shingle"), "print")
        .join(found, ["doc_id", "shingle"])
        .groupBy("doc_id", "print", "need")
        .agg(F.count("*").alias("hits"))
        .where("hits >= need")
    )
    counted = (
        likely.select("doc_id", "print")
        .join(texts.select("print", "n_item", F.explode("full").alias("shingle")), "print")
        .join(found, ["doc_id", "shingle"])
        .groupBy("doc_id", "print", "n_item")
        .agg(F.count("*").alias("n_shared"))
        .where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    )
    named = table.select("item_id", "print").distinct().join(counted, "print")
    leaks = named.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("m")).select("doc_id", "item_id", "m.n_shared", "m.n_item")
    leaks = written(leaks, "leaks")
    drop_written(table)
    drop_written(found)
    return leaks


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold no item; rows with a null id stay."""
    return without(docs, find_leaks(docs, items, percent, key, text).select("doc_id").distinct(), key)
