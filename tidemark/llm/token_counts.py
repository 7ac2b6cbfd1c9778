"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; those that a task has not met before are held as ragged numpy arrays of
symbols. In each round every sequence finds its pair of lowest rank and all occurrences of that pair are
merged at once, in all sequences together. What survives when no pair has a rank is the token count. This equals
one-at-a-time merging, as a pair that holds a merged symbol always ranks after the pair that made the symbol.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.common import slices

NO_RANK = np.iinfo(np.int64).max
#: Chunks and pre-tokens that a task remembers before it starts afresh.
MEMORY = 500_000
#: White space, a space, then white space or the end: only there does a pre-token reach over a single space.
_RUN = "[\\t\\n\\v\\f\\r \\x{85}\\p{Z}] (?:[\\t\\n\\v\\f\\r \\x{85}\\p{Z}]|$)"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def is_byte_level(spec: dict) -> bool:
    """Is a tokenizer file what the merging here stands for: byte-level BPE, cut by that scheme's own pattern, with nothing besides?"""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    return (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and all(c in model["vocab"] for c in byte_alphabet())
        and spec.get("normalizer") is None
        and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space")
        and cut.get("use_regex", True)
        and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    )


class RankMerger:
    """The merges of a byte-level BPE vocabulary file, applied to many sequences at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        self.initial = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self._hash([vocab[a] * self.width + vocab[b] for a, b in merges])
        self.library = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def _hash(self, keys: list[int]) -> None:
        """A table from pairs to ranks, searched by arrays: a key lies at its slot or in one of the next few."""
        self.bits = max(8, len(keys).bit_length() + 3)
        self.keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.ranks = np.zeros(len(self.keys), dtype=np.int64)
        self.reach = 1
        for rank, (key, slot) in enumerate(zip(keys, self._slot(np.array(keys, dtype=np.int64)).tolist(), strict=True)):
            at = slot
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.ranks[at] = key, rank
            self.reach = max(self.reach, at - slot + 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        slot = self._slot(key).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], NO_RANK)
        more = np.flatnonzero((held != key) & (held >= 0))
        for step in range(1, self.reach):
            if not len(more):
                break
            at = slot[more] + step
            held = self.keys[at]
            out[more] = np.where(held == key[more], self.ranks[at], NO_RANK)
            more = more[(held != key[more]) & (held >= 0)]
        return out

    def count(self, sequences: list[str]) -> np.ndarray:
        """Symbols that survive in each sequence."""
        raw = [x.encode() for x in sequences]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out = lengths.copy()
        symbol = self.initial[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), lengths)
        while len(symbol):
            rank = np.full(len(symbol), NO_RANK)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbol)])
            lowest = np.minimum.reduceat(rank, starts)
            out[owner[starts]] = sizes
            going = np.repeat(lowest < NO_RANK, sizes)
            at = np.flatnonzero(going & (rank == np.repeat(lowest, sizes)))
            if not len(at):
                break
            # in a run such as "aaaa" every other pair merges, from the left
            first = np.r_[True, np.diff(at) != 1]
            at = at[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            going[at + 1] = False
            symbol, owner = symbol[going], owner[going]
        return out


class TokenCounter:
    """Counts of whole texts; distinct chunks and pre-tokens are merged once per task.

    Files of other kinds than is_byte_level() are counted by the library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            own = is_byte_level(json.load(f))
        self.merger = RankMerger(path) if own else None
        self.library = None if own else Tokenizer.from_file(path)
        if self.library:
            self.library.no_truncation()
            self.library.no_padding()
        self.chunks: dict[str, int] = {}
        self.pre: dict[str, int] = {}

    def _cut(self, text: str) -> list[str]:
        """Pre-tokens of a text; letters alone, or after one space, are one."""
        letters = text[1:] if text[:1] == " " else text
        if letters.isalpha() and max(letters) < "\u0250":
            return [text]
        return [text[a:b] for _, (a, b) in self.merger.library.pre_tokenizer.pre_tokenize_str(text)]

    def _sums(self, texts: list[str]) -> list[int]:
        cut = [self._cut(x) for x in texts]
        if len(self.pre) > MEMORY:
            self.pre.clear()
        new = list({p for x in cut for p in x if p not in self.pre})
        if new:
            self.pre.update(zip(new, self.merger.count(new).tolist(), strict=True))
        held = self.pre.__getitem__
        return [held(x[0]) if len(x) == 1 else sum(map(held, x)) for x in cut]

    def _chunk_counts(self, chunks: list[str]) -> np.ndarray:
        if len(self.chunks) > MEMORY:
            self.chunks.clear()
        new = list({x for x in chunks if x not in self.chunks})
        if new:
            self.chunks.update(zip(new, self._sums(new), strict=True))
        return np.fromiter(map(self.chunks.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def _whole(self, text: str) -> int:
        """With special strings as single tokens and any white space."""
        parts, n = [text], 0
        for special in self.merger.specials:
            cut = [p.split(special) for p in parts]
            n += sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c]
        return n + sum(self._sums(parts))

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        if self.library:
            found = self.library.encode_batch(texts.to_pylist(), add_special_tokens=False)
            return np.array([len(x.ids) for x in found], dtype=np.int64)
        odd = pc.match_substring_regex(texts, _RUN)
        for special in self.merger.specials:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        odd = odd.to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), dtype=np.int64)
        for i in np.flatnonzero(odd):
            out[i] = self._whole(texts[int(i)].as_py())
        plain = np.flatnonzero(~odd)
        if len(plain):
            parts = pc.split_pattern(texts.take(pa.array(plain)) if odd.any() else texts, " ")
            start = np.asarray(parts.offsets)[:-1] - parts.offsets[0].as_py()
            coded = parts.flatten().dictionary_encode()
            code, distinct = np.asarray(coded.indices), coded.dictionary.to_pylist()
            n = self._chunk_counts([" " + x for x in distinct])[code]
            n[start] = self._chunk_counts([distinct[k] for k in code[start]])
            out[plain] = np.add.reduceat(n, start)
        return out


@cache
def counter(path: str) -> TokenCounter:
    """One counter for each Python worker."""
    return TokenCounter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 512, keep: list[str] | None = None, max_batch_bytes: int = 4 << 20) -> DataFrame:
    """df's columns (or those in keep) with n_bytes, n_tokens and over_limit (n_tokens > limit) added.

    path is a file of the tokenizers library, readable on every executor; the count is that of
    encode(text, add_special_tokens=False).ids without truncation or padding. A null or empty text has no bytes and no tokens. Rows keep their
    number; repeated rows each get their count; an empty table gives an empty table. Columns of df with one of the
    three names are replaced. No shuffle; a task holds one slice of a batch and a table of bounded size.
    """
    df = df.drop(*({"n_bytes", "n_tokens", "over_limit"} - {text}))
    kept = [f for f in df.schema.fields if keep is None or f.name in keep]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for whole in batches:
            for batch in slices(whole, text, max_batch_bytes):
                size = pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())
                columns = [*(batch.column(f.name) for f in kept), size, pa.array(own.count(batch.column(text)))]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return df.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
