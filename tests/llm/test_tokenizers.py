import json

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.odd import documents, texts
from tidemark.llm import sentencepiece_codec, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip_equals_library(spark):
    rows = texts()
    df = documents(spark, rows).withColumn("IDS", F.lit("clash"))
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(df, PIECES), PIECES).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert len(out) == len(rows)
    for r in out:
        ids = model.encode(rows[r["doc_id"]] or "", add_eos=True)
        assert r["ids"] == ids and r["decoded"] == model.decode(ids) and r["text"] == rows[r["doc_id"]]
    assert sentencepiece_codec.encode(df.limit(0), PIECES).count() == 0


def test_decode_of_any_ids_equals_library():
    table = sentencepiece_codec.ChunkTable(PIECES)
    lists = [[(i * 7919 + k * 104729) % 32000 for k in range(i % 9)] for i in range(500)] + [[3, 200, 259], [229, 148], [1, 2], [0, 5]]
    for x in lists:
        assert table.decode(pa.array([x], pa.list_(pa.int32()))).to_pylist() == [table.model.decode(x)]
    assert table.decode(pa.array([None, [264]], pa.list_(pa.int32()))).to_pylist() == ["", "a"]


def test_counts_equal_library(spark):
    rows = texts() + ["a  \n b\t", "꟎ new", "x" * 5000, " \x85 \xa0　 y", "'s 's 't", "<|endoftext|><|endoftext|>"]
    df = documents(spark, rows).withColumn("n_tokens", F.lit("clash"))
    library = Tokenizer.from_file(BYTES)
    out = token_counts.count_tokens(df, BYTES).collect()
    assert len(out) == len(rows)
    for r in out:
        text = rows[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert token_counts.count_tokens(df.limit(0), BYTES).count() == 0


def test_round_trip_equals_both_steps(spark):
    import public_tokenizers

    from tidemark.llm import sentencepiece_codec

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a  b c", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, ids int")
    apart = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model), model)
    both = sentencepiece_codec.round_trip(docs, model)
    assert sorted(map(tuple, both.select("doc_id", "ids", "decoded").collect())) == sorted(map(tuple, apart.select("doc_id", "ids", "decoded").collect()))


def test_other_files_are_left_to_the_libraries(spark):
    other = public_tokenizers.path("word_bpe_49k.json")
    rows = [t for t in texts()[:40]]
    library = Tokenizer.from_file(other)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(documents(spark, rows), other, keep=["doc_id"]).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(rows)}
    with open(BYTES, encoding="utf-8") as f:
        spec = json.load(f)
    assert token_counts.is_byte_level(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"model": {**spec["model"], "ignore_merges": True}}):
        assert not token_counts.is_byte_level({**spec, **change})
    assert sentencepiece_codec.unchanged(PIECES)


def test_texts_of_a_megabyte(spark):
    rows = ["word and other words " * 60_000, "x" * 1_200_000, "é😀 " * 250_000, "1,2;" * 300_000]
    df = documents(spark, rows)
    library, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, BYTES, keep=["doc_id"]).collect()}
    both = {r["doc_id"]: r for r in sentencepiece_codec.round_trip(df, PIECES, keep=["doc_id"]).collect()}
    for i, t in enumerate(rows):
        assert counts[i] == len(library.encode(t, add_special_tokens=False).ids)
        ids = model.encode(t, add_eos=True)
        assert both[i]["ids"] == ids and both[i]["decoded"] == model.decode(ids)
