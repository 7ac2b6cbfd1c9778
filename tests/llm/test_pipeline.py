import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.odd import documents, texts
from tests.llm.test_models import brute_leaks, prose
from tests.llm.test_native import brute_spans, brute_statistics
from tests.llm.test_near_dedup import brute


def test_stages_equal_brute_force(spark, tmp_path):
    rnd = random.Random(12)
    item = " ".join(f"q{i}" for i in range(30))
    clean = [prose("en", rnd, 60) for _ in range(60)]
    rows = [*clean, *clean[:5], *[prose("de", rnd, 40) + " " + item for _ in range(3)], *texts(20)]
    rows += [prose("fr", rnd, 40) + f" mail a{i}@b.co and 10.0.0.{i} end" for i in range(8)]
    rows += [" ".join(f"{w}###" for w in prose("es", rnd, 50).split()) for _ in range(60)]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    noisy = len(rows) - 60
    docs.select("doc_id", (F.col("doc_id") < noisy).cast("int").alias("quality"), F.lit(0).alias("toxic")).where("doc_id % 3 > 0").write.parquet(f"{tmp_path}/labels.parquet")

    def base_ok(text):
        n, _, _, _, repeated = brute_statistics(text)
        return n >= 20 and 100 * repeated <= 30 * n

    kept = [i for i, t in enumerate(rows) if base_ok(t) and i < noisy]
    state, got = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path))
        assert state.columns == corpus_pipeline.COLUMNS, name
        got.append({r["doc_id"]: r["text"] for r in state.collect()})
    assert set(got[0]) == set(kept)
    groups = brute([rows[i] for i in kept], 80)
    kept = [i for k, i in enumerate(kept) if groups[k][1] == k]
    assert set(got[1]) == set(kept)
    leaks = {d for d, _ in brute_leaks([(i, rows[i]) for i in kept], [(1, item)], 80)}
    kept = [i for i in kept if i not in leaks]
    assert leaks and set(got[2]) == set(kept) == set(got[3])
    for i, text in got[3].items():
        for kind, start, end in brute_spans(rows[i]):
            assert f"[{kind.upper()}]" in text or rows[i][start:end] not in text
        if not brute_spans(rows[i]) and "token" not in rows[i]:
            assert text == rows[i]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(kept) and all(r["n_tokens"] == len(r["ids"]) and r["round_trip"] for r in out if "▁" not in got[3][r["doc_id"]])


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = documents(spark, [])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
