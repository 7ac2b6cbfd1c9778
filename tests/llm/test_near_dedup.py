import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.odd import documents, texts
from tidemark.llm import components, near_dedup, shingles


def brute(rows, percent):
    def group(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [group(t) for t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for k in range(i):
            b = sets[k]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(k)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def edited(words, rate, rnd):
    return " ".join(f"edit{rnd.randrange(10**6)}" if rnd.random() < rate else w for w in words)


def family_rows():
    rnd = random.Random(8)
    rows = texts(30)
    for size in (40, 120, 400):
        base = [f"w{rnd.randrange(300)}" for _ in range(size)]
        rows += [edited(base, rate, rnd) for rate in (0, 0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05) for _ in range(6)]
    chain = [f"c{i}" for i in range(200)]
    for step in range(12):  # each links to the next only
        rows.append(" ".join(chain[step * 6 : step * 6 + 120]))
    rnd.shuffle(rows)
    return rows


def test_groups_equal_brute_force(spark):
    rows = family_rows()
    df = documents(spark, rows).withColumn("signature", F.lit("clash"))
    for percent in (85, 80):
        want = brute(rows, percent)
        out = near_dedup.near_duplicates(df, percent=percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want and len(out) == len(rows)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    left = near_dedup.deduplicated(df, percent=80)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {i for i, (_, c) in want.items() if i == c}


@pytest.mark.parametrize(("pivots", "bytes_"), [(2, 1 << 20), (0, 1 << 20), (1, 3000)])
def test_blocks_compare_all(spark, monkeypatch, pivots, bytes_):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", bytes_)
    rows = family_rows()[:120]
    out = near_dedup.near_duplicates(documents(spark, rows), percent=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows, 80)


def test_null_ids_and_repeated_rows(spark):
    df = documents(spark, ["a b c d e f g", "a b c d e f g", None]).selectExpr("case when doc_id = 2 then null else 7 end as doc_id", "text")
    out = near_dedup.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in out) == [(-1, -1, True), (7, 7, True), (7, 7, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert near_dedup.deduplicated(df).count() == 3


def test_ids_with_several_texts_join_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(9, a), (9, b), (5, a), (7, b), (3, "other words that are only here")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()} == {(9, 5), (5, 5), (7, 5), (3, 3)}


def test_tables_on_the_way_are_deleted(spark):
    import glob

    from tidemark.llm.common import shared_dir

    held = lambda: set(glob.glob(shared_dir(spark).removeprefix("file://") + "/tidemark-*"))
    before = held()
    near_dedup.near_duplicates(documents(spark, family_rows()[:60]))
    assert len(held() - before) == 1


def test_signatures_are_super_minhash():
    rnd = np.random.default_rng(1)
    groups = [np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 7, 60, 900, 5000)]
    got = near_dedup.super_minhash(groups, 64)

    def one_by_one(group, size):
        held = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
        for x in group:
            order = list(range(size))
            for level in range(size):
                value, k = near_dedup._draw(np.array([x]), level, size)
                order[level], order[int(k[0])] = order[int(k[0])], order[level]
                held[order[level]] = min(held[order[level]], value[0])
        return (shingles.mix(held) & np.uint64(0xFFFF)).astype(np.uint16)

    with np.errstate(over="ignore"):
        for g, row in zip(groups[:4], got[:4], strict=True):
            assert (one_by_one(g, 64) == row).all()
    a = groups[5]
    b = np.unique(np.concatenate([a[:4000], rnd.integers(0, 2**63, 500, dtype=np.uint64)]))
    pair = near_dedup.super_minhash([a, b])
    assert abs((pair[0] == pair[1]).mean() - 4000 / 5500) < 0.12


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(350)] + [(5000, 5000)]
    rnd.shuffle(edges)
    nodes, root = components.union_find(*map(np.array, zip(*[e for e in edges if e[0] != e[1]], strict=True)))
    out = components.components(spark.createDataFrame(edges, "x long, y long").repartition(7))
    assert {r["node"]: r["component"] for r in out.collect()} == dict(zip(nodes.tolist(), root.tolist(), strict=True))
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_shingle_sets():
    out = shingles.sets(pa.array(["A b C d e f", "a B c D E F", "x y", "x  y", "", None, "x\xa0y"]))
    assert (out[0] == out[1]).all() and len(out[0]) == 2 and (out[2] == out[3]).all() and len(out[4]) == len(out[5]) == 0 and len(out[6]) == 1
