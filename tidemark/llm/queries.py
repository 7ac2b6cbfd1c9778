"""One query for each corpus operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontamination, language_id, license_scan, near_dedup, pii, quality_rules, sentencepiece_codec, token_counts, warc
from tidemark.llm.common import hex_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as digests."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_codec.round_trip(docs, model, keep=["doc_id"])
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_of(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        hex_of(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, by a decision list learned from labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit_rules(docs, _table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules, keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, looked up there by its URL and read back."""
    pages = _table(spark, sf_dir, "pages")
    directory = warc.write_archives(warc.captures(pages))
    return warc.lookup(pages, directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that reads like a licence, with its family."""
    docs = _table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.fit_classifier(docs))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = pii.fit_trees(docs)
    found = pii.find_spans(docs, trees, keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in pii.BASE), hex_of(pii.span_text(F.col("base"))).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, by prototypes of the documents that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    prototypes = language_id.fit_prototypes(docs.where(~F.col("held_out")))
    return language_id.predict(docs.drop("lang"), prototypes, keep=["doc_id", "held_out"])


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation expanded into examples and read back from them."""
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    examples = chat_format.expand_turns(rows)
    read = examples.select(
        "conv_id",
        F.when(F.col("target_turn").isNotNull(), F.struct("target_turn", chat_format.trained_text(examples).alias("text"))).alias("loss"),
        F.when(F.col("last"), F.col("formatted")).alias("whole"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    conv = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("loss")).alias("loss"), F.element_at(F.collect_list("whole"), 1).alias("whole"), F.sum("chars").alias("formatted_chars"))
    parsed = conv.select(
        "conv_id",
        F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss"),
        chat_format.parsed_turns(F.col("whole")).alias("turns"),
        "formatted_chars",
    )
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_of(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        hex_of(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_warc": op5_warc,
    "op6_license_scan": op6_license_scan,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_chat_format": op9_chat_format,
    "op10_token_counts": op10_token_counts,
}

_OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), lines AS (
  SELECT *,
    4 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c')) + 2
      + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) + 8 AS chars,
    row_number() OVER w AS pos
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sums AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM lines
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR pos = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM sums GROUP BY conv_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = "list_distinct([array_to_string(w[p : p + k - 1], chr(1)) for p in range(1, len(w) - k + 2)])"

_OP3_SQL = f"""
WITH i AS (SELECT item_id, w, least(len(w), 5) AS k, row_number() OVER () AS row FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
item AS (SELECT row, item_id, k, len(s) AS n_item, unnest(s) AS shingle FROM (SELECT row, item_id, k, {_SHINGLES} AS s FROM i)),
d AS (SELECT doc_id, w, ks.k FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL) d, (SELECT DISTINCT k FROM i) ks WHERE len(w) >= ks.k),
doc AS (SELECT DISTINCT doc_id, k, unnest(s) AS shingle FROM (SELECT doc_id, k, {_SHINGLES} AS s FROM d)),
met AS (SELECT doc_id, item_id, count(*) AS n_shared, CAST(n_item AS BIGINT) AS n_item FROM doc JOIN item USING (k, shingle)
  GROUP BY doc_id, item_id, row, n_item HAVING 100 * count(*) >= 80 * n_item)
SELECT doc_id, item_id, m.n_shared AS n_shared, m.n_item AS n_item FROM (SELECT doc_id, item_id, max({{'n_shared': n_shared, 'n_item': n_item}}) AS m FROM met GROUP BY doc_id, item_id)
"""

_OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, w, least(len(w), 5) AS k FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
s AS MATERIALIZED (SELECT doc_id, k, CASE WHEN k > 0 THEN {_SHINGLES} ELSE [] END AS s FROM d),
sh AS MATERIALIZED (SELECT doc_id, k, len(s) AS n, unnest(s) AS shingle FROM s),
link AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b USING (k, shingle) GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.to_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""

_OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS head FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to FROM f
"""

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op3_decontamination": _OP3_SQL, "op4_near_duplicates": _OP4_SQL, "op5_warc": _OP5_SQL, "op9_chat_format": _OP9_SQL}
