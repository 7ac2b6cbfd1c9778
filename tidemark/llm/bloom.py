"""A Bloom filter over 64-bit keys that grows with their number up to a fixed size, so that it may be broadcast."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import mix

#: Bits for each key, and the logarithms of the fewest and the most bits: 8 KB to 32 MB. Over some 16 million keys the
#: filter lets more and more foreign keys through, which costs time but no result.
BITS_A_KEY, LEAST, MOST = 16, 16, 28


@dataclass(frozen=True)
class Bloom:
    """words holds the bits; a key sets `probes` of them."""

    words: np.ndarray
    probes: int

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be in the filter; none that is in it is missed."""
        inside = np.ones(len(keys), dtype=bool)
        for at in _positions(keys, len(self.words) * 32, self.probes):
            inside &= (self.words[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        return inside


def _positions(keys: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        a = mix(keys.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        step, mask = (a >> np.uint64(32)) | np.uint64(1), np.uint64(bits - 1)
        return [(a + np.uint64(i) * step) & mask for i in range(probes)]


def bloom_filter(keys: DataFrame) -> Bloom:
    """The filter of a frame's only column (long, no nulls), combined by Spark.

    The frame is read twice, first for the number of its rows. At most 2**MOST / 32 words of eight bytes reach the driver.
    """
    name, n = keys.columns[0], max(1, keys.count())
    log = min(MOST, max(LEAST, math.ceil(math.log2(BITS_A_KEY * n))))
    probes = min(4, max(1, round(math.log(2) * 2**log / n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (log - 5), dtype=np.uint32)
        for batch in batches:
            for at in _positions(batch.column(name).to_numpy().view(np.uint64), 1 << log, probes):
                np.bitwise_or.at(held, (at >> np.uint64(5)).astype(np.int64), np.uint32(1) << (at & np.uint64(31)).astype(np.uint32))
        words = np.flatnonzero(held)
        for part in np.split(words, range(1 << 20, len(words), 1 << 20)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part].view(np.int32))], ["word", "bits"])

    out = np.zeros(1 << (log - 5), dtype=np.uint32)
    found = keys.mapInArrow(run, "word int, bits int").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint32)
    return Bloom(out, probes)
