"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_main, licenses, mixing, ngram_join, packing, pii, quality, sharding, syncmers, token_store
from .common import Scratch
from .tokens import vocabulary


#: Of the registered query and the pipeline alone, so that reruns agree; whoever publishes texts takes a secret one.
SAMPLE_KEY = b"a key that everybody knows"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-store").path("store")  # goes when the driver ends
    token_store.write_store(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), 2)
    return token_store.read_crcs(spark, path)


def op2_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), SAMPLE_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(_table(spark, sf_dir, "pages"))


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 16)


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 0, 2048)


_ALL = (
    op1_token_store,
    op2_risk_controlled_quality,
    op3_keyed_surrogates,
    op4_closed_syncmers,
    op5_ngram_jaccard,
    op6_page_differencing,
    op7_pivotal_mix,
    op8_license_windows,
    op9_hash_tree_shards,
    op10_pattern_packing,
)
QUERIES = {f.__name__: f for f in _ALL}
#: Sets are exact, so SQL says all of the join; the other methods draw, hash or fit.
ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS shingle FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 75 * (s.n + t.n - count(*))
), reach AS (
  SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT r.start, l.y FROM reach r JOIN links l ON r.node = l.x
), copies AS (SELECT doc_id, list_sort(list(shingle)) AS body FROM shingles GROUP BY doc_id
), classes AS (SELECT doc_id, count(*) OVER (PARTITION BY body) AS class_size FROM copies
), degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, coalesce(g.n, 0) AS n_links, coalesce(k.class_size, 1) AS class_size
FROM documents d JOIN (SELECT start, min(node) AS component_id FROM reach GROUP BY start) c ON c.start = d.doc_id
LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN degree g ON g.x = d.doc_id LEFT JOIN classes k ON k.doc_id = d.doc_id
""",
}
