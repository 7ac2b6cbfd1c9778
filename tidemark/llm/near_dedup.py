"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find grouping.

A document's signature has, for each component, the least value of its shingles; a shingle visits the components
in a random order of its own and its value at the j-th visit lies in [j, j+1), so values are spread evenly over
components and a document stops as soon as no later visit can lower any of them. Documents that agree in a whole
band meet in a bucket.

Exact copies collapse to one representative first. In every bucket, whatever its size, members that do not belong
together yet are compared: first, in rounds, the least member of each group with the least member of the bucket's largest
group, which joins most of them; then all that are still apart, in pairs of blocks bounded by members and bytes, without
comparing the largest group with itself. Signatures alone are sent to the blocks; sets follow for the members that have a
likely partner there. All links are confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import bloom_filter
from tidemark.llm.common import drop_written, slices, without, written
from tidemark.llm.components import components
from tidemark.llm.shingles import mix, sets

SIGNATURE = 192
#: Chance to miss a pair exactly at the threshold that the bands may leave.
MISS = 1e-6
#: Deviations below the threshold at which an estimate still sends a pair to verification.
SLACK = 4.5
#: Members of a bucket, and bytes of their sets, that one block holds.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: Rounds in which groups are compared with their bucket's largest one.
PIVOTS = 2
_UNSET = np.iinfo(np.uint64).max
_SHIFT = np.uint64(53)


def _draw(elements: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each element's value at a visit, and the place that it swaps into the visit's turn."""
    x = mix(elements + np.uint64((level * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    value = (np.uint64(level) << _SHIFT) | (x >> np.uint64(11))
    y = mix(x ^ np.uint64(0xA0761D6478BD642F))
    return value, (level + y % np.uint64(size - level)).astype(np.int64)


def super_minhash(groups: list[np.ndarray], size: int = SIGNATURE) -> np.ndarray:
    """Signatures (uint16, one row for each set of 64-bit hashes); sets must not be empty."""
    lengths = np.array([len(g) for g in groups], dtype=np.int64)
    elements = np.concatenate(groups) if groups else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(groups)), lengths)
    held = np.full((len(groups), size), _UNSET, dtype=np.uint64)
    flat = held.reshape(-1)
    with np.errstate(over="ignore"):
        value, place = _draw(elements, 0, size)
        np.minimum.at(flat, owner * size + place, value)
        # sets that a later visit may lower go on, some at a time as each element now carries its order of visits
        going = np.flatnonzero(held.max(axis=1) >> _SHIFT >= 1)
        cuts = np.cumsum(lengths[going]) // 50_000
        for part in np.split(going, np.flatnonzero(np.diff(cuts)) + 1) if len(going) else []:
            wanted = np.zeros(len(groups), dtype=bool)
            wanted[part] = True
            mine = wanted[owner]
            e, o, k = elements[mine], owner[mine], place[mine]
            rows = np.arange(len(e))
            order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(e), 1))
            order[rows, k], order[:, 0] = 0, k
            for level in range(1, size):
                live = (held[part].max(axis=1) >> _SHIFT) >= level
                if not live.all():
                    part = part[live]
                    wanted[:] = False
                    wanted[part] = True
                    mine = wanted[o]
                    e, o, order = e[mine], o[mine], order[mine]
                    rows = np.arange(len(e))
                if not len(part):
                    break
                value, k = _draw(e, level, size)
                at = order[rows, k]
                order[rows, k] = order[:, level]
                order[:, level] = at
                np.minimum.at(flat, o * size + at, value)
        return (mix(held) & np.uint64(0xFFFF)).astype(np.uint16)


def bands_for(threshold: float, size: int = SIGNATURE, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows in each): the longest rows with which a pair at the threshold is missed with at most that chance."""
    for rows in range(size, 0, -1):
        if (1 - threshold**rows) ** (size // rows) <= miss:
            return size // rows, rows
    return size, 1


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            found = sets(batch.column("text"))
            full = [i for i, s in enumerate(found) if len(s)]
            signed = super_minhash([found[i] for i in full])
            signature: list = [None] * len(found)
            for i, row in zip(full, signed, strict=True):
                signature[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()), pa.array(signature, pa.binary())],
                ["doc_id", "n_shingles", "print", "signature"],
            )


def _full_sets(shared):
    """Sets of the documents that the broadcast filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids = whole.column("doc_id")
            near = shared.value.may_hold(pc.fill_null(ids, 0).to_numpy().view(np.uint64)) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
            if not near.any():
                continue
            for batch in slices(whole.filter(pa.array(near)), "text"):
                found = [s.tobytes() for s in sets(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary()), pa.array(found, pa.binary())], ["doc_id", "print", "set"])

    return run


def _links(percent: int, one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets share enough with one."""
    sizes = np.array([len(o) for o in others], dtype=np.int64)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    common = np.add.reduceat((one[at] == flat).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
    return 100 * common >= percent * (sizes + len(one) - common)


def _least(percent: int) -> int:
    """Equal signature components of a pair that goes on to verification."""
    threshold = percent / 100
    return math.ceil(SIGNATURE * (threshold - SLACK * math.sqrt(threshold * (1 - threshold) / SIGNATURE)))


def _alike(percent: int):
    """Pairs whose signatures are near enough."""
    least = _least(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, SIGNATURE) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((one == other).sum(axis=1) >= least))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(_links(percent, _ints(x), [_ints(y)])[0]) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _ints(scalar: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), dtype=np.uint64)


def _pairs(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of members of two blocks that carry different labels and have signatures near enough: places and equal components."""
    label, block, size = (group.column(c).to_numpy() for c in ("label", "block", "n_shingles"))
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype=np.uint16).reshape(len(label), SIGNATURE)
    first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
    left, right, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    least = _least(percent)
    for x in first:
        others = second[second > x] if i == j else second
        others = others[label[others] != label[x]]
        others = others[100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])]
        if len(others):
            equal = (sig[others] == sig[x]).sum(axis=1)
            near = equal >= least
            left.append(np.full(int(near.sum()), x))
            right.append(others[near])
            score.append(equal[near])
    return np.concatenate(left), np.concatenate(right), np.concatenate(score)


def _likely(percent: int):
    """The members of two blocks that have a likely partner in the other."""

    def run(group: pa.Table) -> pa.Table:
        a, b, _ = _pairs(group.combine_chunks(), percent)
        return group.drop_columns(["signature"]).take(pa.array(np.unique(np.r_[a, b])))

    return run


def _compare(percent: int):
    """Links between members of two blocks that do not belong together yet, as few as join them.

    Pairs are tried by falling similarity of their signatures, on full sets, until they belong together by earlier ones.
    """

    def run(group: pa.Table) -> pa.Table:
        # rows of one document may share its id under several texts
        group = group.combine_chunks()
        doc = group.column("doc").to_numpy()
        full = [_ints(x) for x in group.column("set")]
        _, root = np.unique(group.column("label").to_numpy(), return_inverse=True)
        root = root.astype(np.int64)
        a, b, score = _pairs(group, percent)
        out: list[tuple[int, int]] = []
        for k in np.lexsort((b, a, -score)):
            x, y = int(a[k]), int(b[k])
            if root[x] != root[y] and _links(percent, full[x], [full[y]])[0]:
                out.append((int(doc[x]), int(doc[y])))
                root[root == root[y]] = root[x]
        ends = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": ends.min(axis=1) if len(ends) else ends[:, 0], "b": ends.max(axis=1) if len(ends) else ends[:, 1]})

    return run


def _labelled(buckets: DataFrame, links: list[DataFrame]) -> DataFrame:
    """buckets with each member's group so far, for those whose members carry several labels, and each bucket's largest group."""
    group = components(reduce(DataFrame.union, links))
    labels = group.select(F.col("node").alias("doc"), F.col("component").alias("label"))
    buckets = buckets.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    sizes = buckets.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min("doc").alias("least"))
    # of equally large groups that with the least member
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", (-F.col("least")).alias("minus"), "label")).alias("m"), F.count("*").alias("groups")).where("groups > 1")
    # written, so that the join below may be split where a bucket is large: no aggregation shares its partitions
    main = written(main.select("bucket", F.col("m.label").alias("main"), (-F.col("m.minus")).alias("pivot")), "main")
    members = written(buckets.join(main, "bucket"), "members")
    for table in (group, main):
        drop_written(table)
    return members


def _linked(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are near by their signatures and linked on full sets."""
    of = lambda column, doc, name: full.select(F.col("doc_id").alias(doc), F.col(column).alias(f"{name}_{doc}"))
    alike = pairs.join(of("signature", "a", "sig"), "a").join(of("signature", "b", "sig"), "b").mapInArrow(_alike(percent), "a long, b long")
    return alike.join(of("set", "a", "set"), "a").join(of("set", "b", "set"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long")


def _apart(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that carry different labels, by pairs of blocks."""
    own = full.select(F.col("doc_id").alias("doc"), "n_shingles", "signature")
    members = members.select("bucket", "doc", "label", (F.col("label") == F.col("main")).alias("inside"))
    sums = lambda inside: F.ceil(F.greatest(F.count_if(inside) / BLOCK, 8 * F.sum(F.when(inside, F.col("n_shingles")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    sized = members.join(own.drop("signature"), "doc").groupBy("bucket")
    counts = written(sized.agg(sums(~F.col("inside")).alias("outer"), sums(F.col("inside")).alias("inner")), "counts")
    # blocks from 0 hold what is apart, those after them the largest group, which is not compared with itself
    hashed = F.xxhash64("doc")
    blocks = members.join(counts, "bucket").withColumn("block", F.when(F.col("inside"), F.col("outer") + F.pmod(hashed, F.col("inner"))).otherwise(F.pmod(hashed, F.col("outer"))).cast("int"))
    last = F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    blocks = blocks.withColumn("last", last).join(own, "doc").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    blocks = blocks.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "label", "block", "n_shingles", "signature")
    likely = blocks.groupBy("bucket", "i", "j").applyInArrow(_likely(percent), "bucket long, i int, j int, doc long, label long, block int, n_shingles long")
    # texts that share an id come back with all their sets
    likely = likely.drop("n_shingles").distinct().join(full.withColumnRenamed("doc_id", "doc"), "doc")
    links = written(likely.groupBy("bucket", "i", "j").applyInArrow(_compare(percent), "a long, b long"), "links")
    drop_written(counts)
    return links


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of df.

    A document's set holds its distinct shingles of five words (A-Z lower-cased); with fewer words it holds all of them
    as one; without words or text it is empty and linked with nothing. Documents are linked where 100 * intersection
    >= percent * union. component_id is the least id reachable over links, kept says whether it is the row's own.
    Rows with a null id are linked with nothing, have a null component_id and are kept; rows that share an id count as
    one document. An empty table gives an empty one; other columns of df are ignored. The result is a table in the
    shared folder; those that led to it are deleted.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bands, rows = bands_for(percent / 100)
    signed = written(docs.mapInArrow(_sign, "doc_id long, n_shingles long, print binary, signature binary"), "signatures")
    usable = signed.where("doc_id is not null and print is not null")
    classes = written(usable.groupBy("print").agg(F.min("doc_id").alias("doc")), "classes")
    own = usable.join(classes.select("print", F.col("doc").alias("doc_id")), ["print", "doc_id"], "left_semi").dropDuplicates(["doc_id", "print"])
    banded = own.select(
        F.col("doc_id").alias("doc"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring("signature", i * (2 * rows) + 1, F.lit(2 * rows)), i).alias("bucket")))).alias("b"),
    ).select("doc", "b.band", "b.bucket")
    # buckets of the same members count once, in their first band
    kept = (
        banded.groupBy("bucket")
        .agg(F.min("doc").alias("hub"), F.count("*").alias("n"), F.sum(F.xxhash64("doc").bitwiseAND(F.lit((1 << 40) - 1))).alias("members"), F.min("band").alias("band"))
        .where("n > 1")
        .groupBy("hub", "n", "members")
        .agg(F.min(F.struct("band", "bucket")).alias("b"))
        .select("b.band", "b.bucket")
    )
    buckets = written(banded.join(kept, ["bucket", "band"]).select("bucket", "doc"), "buckets")
    met = buckets.select(F.col("doc").alias("doc_id")).distinct()
    shared = df.sparkSession.sparkContext.broadcast(bloom_filter(met))
    full = docs.mapInArrow(_full_sets(shared), "doc_id long, print binary, set binary").join(own.join(met, "doc_id", "left_semi"), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"])
    full = written(full.select("doc_id", "n_shingles", "signature", "set"), "sets")

    # an id that stands for several texts links their classes
    links = [written(usable.join(classes, "print").where("doc_id <> doc").join(_several(usable), "doc_id", "left_semi").select("doc_id", "doc").distinct().toDF("a", "b"), "links")]
    tested = None
    for _ in range(PIVOTS):
        members = _labelled(buckets, links)
        pairs = members.where("label <> main").groupBy("bucket", "label", "pivot").agg(F.min("doc").alias("a")).select("a", F.col("pivot").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs.groupBy("a").agg(F.min("b").alias("b")), "pairs")
        links.append(written(_linked(pairs, full, percent), "links"))
        tested = pairs if tested is None else tested.union(pairs)
        drop_written(members)
    members = _labelled(buckets, links)
    links.append(_apart(members, full, percent))
    grouped = components(reduce(DataFrame.union, links))

    # classes get their groups first, so that rows meet one table; those without a text or an id need none
    named = classes.join(grouped.withColumnRenamed("node", "doc"), "doc", "left").select("print", F.coalesce("component", "doc").alias("component_id"))
    out = usable.select("doc_id", "n_shingles", "print").join(named, "print").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("doc_id is null or print is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.union(alone)
    out = written(out.withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))), "groups")
    for table in (signed, classes, buckets, full, members, grouped, *links, *([tested] if tested is not None else [])):
        drop_written(table)
    return out


def _several(usable: DataFrame) -> DataFrame:
    """The ids that stand for more than one text."""
    return usable.groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low <> high").select("doc_id")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of df whose document is the least of its group; rows with a null id stay."""
    return without(df, near_duplicates(df, key, text, percent).where(~F.col("kept")).select("doc_id").distinct(), key)
