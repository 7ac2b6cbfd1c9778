"""SentencePiece encoding and decoding through a table of distinct chunks.

In a vocabulary whose pieces hold white-space markers only at their start, no merge crosses from one marked word
to the next. Each distinct marked word of a batch is therefore segmented once, and the ids are joined back to the
texts by position. The vocabulary is checked for this; where it does not hold, whole texts are segmented.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import slices

MARK = "▁"
#: Distinct marked words that a task remembers before it starts afresh.
MEMORY = 65_536
_MARKED = re.compile("( +[^ ]*)")


def unchanged(path: str) -> bool:
    """Does a model's normalizer leave every character as it is, but for the marker in front and for spaces?

    All of the first plane is tried, and the blocks of others that normal forms change.
    """
    blocks = ((1, 0xD800), (0xE000, 0x10400), (0x1D400, 0x1D800), (0x1F100, 0x1F300), (0x2F800, 0x2FA20))
    text = "".join(chr(c) for a, b in blocks for c in range(a, b) if chr(c) not in (" ", MARK))
    return sentencepiece.SentencePieceNormalizer(model_file=path).normalize(text) == MARK + text


class ChunkTable:
    """Ids of marked words, each segmented once."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "".join(self.model.decode(self.model.encode(x)) for x in (" a", "a  b ", "①ﬁ"))
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces) and probe == " aa  b ①ﬁ" and unchanged(path)
        self.end = self.model.eos_id()
        self.blank = self.model.piece_to_id(MARK)  # a marker with nothing after it
        self.seen: dict[str, int] = {}
        self._reset()
        # the bytes that each id stands for; none for control pieces
        byte = re.compile("<0x([0-9A-F]{2})>")
        raw = [b"" if self.model.is_control(i) else bytes([int(byte.match(p)[1], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
        self.unknown = self.model.unk_id()
        self.strips = self.model.decode([self.blank] * 2) == " "

    def _reset(self) -> None:
        self.seen.clear()
        self.flat, self.at = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 12, dtype=np.int64)
        self.used = 0

    def _rows(self, words: list[str]) -> np.ndarray:
        """The table's row of each word; words not yet in it are segmented."""
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > MEMORY and self.seen:
            self._reset()
            new = words
        if new:
            new = list(dict.fromkeys(new))
            ids = [x or [self.blank] for x in self.model.encode(new, num_threads=1)]
            base = len(self.seen)
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            total = int(sizes.sum())
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + total, dtype=np.int32)])
            if base + len(new) + 1 > len(self.at):
                self.at = np.concatenate([self.at, np.zeros(base + len(new) + 1, dtype=np.int64)])
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=total)
            self.at[base + 1 : base + 1 + len(new)] = self.used + np.cumsum(sizes)
            self.used += total
            self.seen.update(zip(new, range(base, base + len(new)), strict=True))
        return np.fromiter(map(self.seen.__getitem__, words), dtype=np.int64, count=len(words))

    def encode(self, texts: pa.Array, add_end: bool = True) -> pa.Array:
        """A list of ids for each text; null is taken as empty."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        if not self.by_word:
            ids = self.model.encode(texts.to_pylist(), num_threads=1)
            return pa.array([[*x, self.end] if add_end else x for x in ids], pa.list_(pa.int32()))
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        odd = pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts, " ")
        if odd.any():  # runs of spaces belong to the word after them
            cut = parts.to_pylist()
            for i in np.flatnonzero(odd):
                cut[i] = [w[1:] for w in _MARKED.findall(" " + texts[int(i)].as_py())]
            parts = pa.array(cut, pa.list_(pa.string()))
        bounds = np.asarray(parts.offsets)
        bounds = bounds - bounds[0]
        coded = parts.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        start, size = self.at[rows], self.at[rows + 1] - self.at[rows]
        ends = np.r_[0, np.cumsum(size)]
        flat = self.flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        offset = ends[bounds]
        if empty.any():
            drop = np.zeros(len(flat), dtype=bool)
            for i in np.flatnonzero(empty):
                drop[offset[i] : offset[i + 1]] = True
            offset = offset - np.r_[0, np.cumsum(drop)][offset]
            flat = flat[~drop]
        if add_end:
            flat = np.insert(flat, offset[1:], self.end)
            offset = offset + np.arange(len(offset))
        return pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(flat, pa.int32()))

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text of each list of ids; null is taken as an empty list.

        Bytes of the pieces are joined by position; lists with unknown or foreign ids, or whose bytes are not valid
        UTF-8, go through the library.
        """
        if ids.null_count:
            ids = pc.coalesce(ids, pa.scalar([], ids.type))
        bounds = np.asarray(ids.offsets, dtype=np.int64)
        flat = np.asarray(ids.flatten(), dtype=np.int64)
        bounds = bounds - bounds[0]
        if self.strips and not ids.flatten().null_count and (not len(flat) or (flat.min() >= 0 and flat.max() < len(self.raw_at) - 1 and not (flat == self.unknown).any())):
            start, size = self.raw_at[flat], self.raw_at[flat + 1] - self.raw_at[flat]
            ends = np.r_[0, np.cumsum(size)]
            out = self.raw[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
            at = ends[bounds]
            # the space of the prefix that encoding puts before a text
            lead = at[:-1][(at[1:] > at[:-1])]
            lead = lead[out[lead] == 32]
            keep = np.ones(len(out), dtype=bool)
            keep[lead] = False
            at = np.r_[0, np.cumsum(keep)][at]
            out = out[keep]
            inner = at[at < len(out)]
            try:
                whole = not ((out[inner] & 0xC0) == 0x80).any() and bool(out.tobytes().decode() or True)
            except UnicodeDecodeError:
                whole = False
            if whole and len(out) < 1 << 31:
                return pa.StringArray.from_buffers(len(ids), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out.tobytes()))
        lists = [[i for i in x if i is not None] for x in ids.to_pylist()]
        return pa.array(self.model.decode(lists, num_threads=1) if lists else [], pa.string())


@cache
def table(path: str) -> ChunkTable:
    """One table for each Python worker."""
    return ChunkTable(path)


def _with(df: DataFrame, source: str, added: dict[str, T.DataType], step, keep: list[str] | None, max_batch_bytes: int) -> DataFrame:
    df = df.drop(*(set(added) - {source}))
    kept = [f for f in df.schema.fields if f.name not in added and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, kind in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, source, max_batch_bytes):
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *step(batch.column(source))], [f.name for f in schema])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", add_end: bool = True, keep: list[str] | None = None, max_batch_bytes: int = 2 << 20) -> DataFrame:
    """df's columns (or those in keep) with ids: what the library's encode gives for each whole text, then its end id.

    A null or empty text has the end id alone (no id without add_end). Rows keep their number, repeated rows each
    get their ids, an empty table gives an empty table; a column named like ids is replaced. The model file must be
    readable at path on every executor. No shuffle; a task holds one slice of a batch and a table of bounded size.
    """
    return _with(df, text, {ids: T.ArrayType(T.IntegerType())}, lambda x: [table(path).encode(x, add_end)], keep, max_batch_bytes)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None, max_batch_bytes: int = 2 << 20) -> DataFrame:
    """df's columns (or those in keep) with text: what the library's decode gives for each list of ids; empty for null.

    A column named like text is replaced.
    """
    return _with(df, ids, {text: T.StringType()}, lambda x: [table(path).decode(x)], keep, max_batch_bytes)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", add_end: bool = True, keep: list[str] | None = None, max_batch_bytes: int = 1 << 20) -> DataFrame:
    """df's columns (or those in keep) with the ids of encode() and the text that decode() makes of them.

    One pass: a task needs one Python worker, and the ids are not sent to a second one. Columns named like ids or
    decoded are replaced.
    """

    def step(texts: pa.Array) -> list[pa.Array]:
        coded = table(path).encode(texts, add_end)
        return [coded, table(path).decode(coded)]

    return _with(df, text, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, step, keep, max_batch_bytes)
