"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The n-gram of three letters is the product of their vectors, the first
rotated twice and the second once; a text is the sum of its n-grams, and a language's prototype the sum of all its
training texts. A document gets the language whose prototype, less what all prototypes share, has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices

DIMENSION = 1024
SEED = 20
#: n-grams whose vectors a worker remembers before it starts afresh.
MEMORY = 40_000
#: Texts whose vectors are made in one matrix product.
TOGETHER = 128
UNKNOWN = "und"
_SPAN = np.int64(1 << 21)


class Vectors:
    """Vectors of n-grams, made when first met; what stands between words is a letter of its own (0)."""

    def __init__(self, dimension: int):
        self.dimension = dimension
        self.letter = np.full(0x110000, -1, dtype=np.int32)
        self.letter[:128] = 0
        for c in range(128):
            if chr(c).isalpha():
                self.letter[c] = c
        self.made: dict[int, np.ndarray] = {}
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, dtype=np.int64)
        self.row = np.zeros(0, dtype=np.int64)
        self.table = np.zeros((1024, self.dimension), dtype=np.float32)

    def of_letter(self, code: int) -> np.ndarray:
        if code not in self.made:
            self.made[code] = np.random.default_rng([SEED, code]).integers(0, 2, self.dimension).astype(np.float32) * 2 - 1
        return self.made[code]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of a text and how often each occurs; none where it has no letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32)
        letters = self.letter[codes]
        for c in np.unique(codes[letters < 0]).tolist():
            self.letter[c] = c if chr(c).isalpha() else 0
        letters = self.letter[codes].astype(np.int64)
        letters = letters[(letters > 0) | np.r_[True, letters[:-1] > 0][: len(letters)]]
        held = np.flatnonzero(letters)
        if not len(held):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        letters = np.r_[0, letters[held[0] : held[-1] + 1], 0]
        return np.unique((letters[:-2] * _SPAN + letters[1:-1]) * _SPAN + letters[2:], return_counts=True)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """The table's rows of distinct n-grams."""
        at = np.searchsorted(self.known, grams)
        held = at < len(self.known)
        held[held] = self.known[at[held]] == grams[held]
        new = grams[~held]
        if len(new):
            if len(self.known) + len(new) > MEMORY and len(self.known):
                self._reset()
                new = grams
            base = len(self.known)
            if base + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((base + len(new), self.dimension), dtype=np.float32)])
            for i, g in enumerate(new.tolist()):
                third, rest = g % int(_SPAN), g // int(_SPAN)
                self.table[base + i] = np.roll(self.of_letter(rest // int(_SPAN)), 2) * np.roll(self.of_letter(rest % int(_SPAN)), 1) * self.of_letter(third)
            known = np.r_[self.known, new]
            order = np.argsort(known, kind="stable")
            self.known, self.row = known[order], np.r_[self.row, np.arange(base, base + len(new))][order]
            at = np.searchsorted(self.known, grams)
        return self.row[at]

    def bundles(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The vectors of texts, given by their n-grams and counts: one matrix product for all of them."""
        if not found:
            return np.zeros((0, self.dimension), dtype=np.float32)
        grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        text = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])
        counts = np.concatenate([c for _, c in found])
        out = np.zeros((len(found), self.dimension), dtype=np.float32)
        for i in range(0, len(grams), 8192):
            part = (at >= i) & (at < i + 8192)
            matrix = np.zeros((len(found), min(8192, len(grams) - i)), dtype=np.float32)
            matrix[text[part], at[part] - i] = counts[part]
            rows = self.rows(grams[i : i + 8192])  # may replace the table
            out += matrix @ self.table[rows]
        return out


@cache
def vectors(dimension: int) -> Vectors:
    """One table for each Python worker."""
    return Vectors(dimension)


def fit_prototypes(df: DataFrame, text: str = "text", lang: str = "lang", dimension: int = DIMENSION) -> dict[str, np.ndarray]:
    """Each language's prototype from all rows of df with a language and a letter.

    Tasks count n-grams by language and send one vector for each language they met; Spark adds them up. The driver gets
    languages x dimension sums. Without rows there are no prototypes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = vectors(dimension), {}
        for batch in (part for whole in batches for part in slices(whole, "text")):
            by_lang: dict[str, list] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = own.grams(t)
                if len(grams):
                    by_lang.setdefault(name, []).append((grams, counts))
            for name, found in by_lang.items():
                grams, inverse = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                total = np.bincount(inverse, weights=np.concatenate([c for _, c in found]))
                for i in range(0, len(grams), 4096):
                    at = own.rows(grams[i : i + 4096])
                    part = total[i : i + 4096] @ own.table[at].astype(np.float64)
                    sums[name] = sums.get(name, 0) + np.rint(part).astype(np.int64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimension), pa.array(np.arange(dimension, dtype=np.int32)), pa.array(total)], ["lang", "axis", "total"])

    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    out: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(run, "lang string, axis int, total long").groupBy("lang", "axis").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r["lang"], np.zeros(dimension))[r["axis"]] = r["total"]
    return dict(sorted(out.items()))


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) with lang_pred and score, the cosine that chose it (0 to 1).

    It is the cosine with the language's prototype less what all prototypes share.

    lang_pred is und, with score 0, for null texts, texts without a letter, and where there are no prototypes. Of equal
    cosines the first language in order wins. Columns of df with these names are replaced.
    """
    names = sorted(prototypes)
    whole = np.array([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in names])
    own_part = whole - whole.mean(axis=0) if len(names) > 1 else whole
    own_part = own_part / np.maximum(np.linalg.norm(own_part, axis=1, keepdims=True), 1e-12) if len(names) else own_part
    dimension = whole.shape[1] if len(names) else DIMENSION
    df = df.drop(*({"lang_pred", "score"} - {text}))
    kept = [f for f in df.schema.fields if keep is None or f.name in keep]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vectors(dimension)
        for long in batches:
            for batch in slices(long, text):
                found = [own.grams(t) for t in batch.column(text).to_pylist()]
                said, score = [UNKNOWN] * len(found), [0.0] * len(found)
                full = [i for i, (grams, _) in enumerate(found) if len(grams) and names]
                for part in (full[i : i + TOGETHER] for i in range(0, len(full), TOGETHER)):
                    total = own.bundles([found[i] for i in part]).astype(np.float64)
                    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
                    each = total @ own_part.T
                    best = np.argmax(each, axis=1)
                    cosine = np.clip(each[np.arange(len(part)), best], 0.0, 1.0)
                    for i, k, c in zip(part, best.tolist(), cosine.tolist(), strict=True):
                        said[i], score[i] = names[k], c
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(said, pa.string()), pa.array(score, pa.float64())], [f.name for f in schema])

    return df.mapInArrow(run, schema)
