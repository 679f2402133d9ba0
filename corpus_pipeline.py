"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage takes all rows that its predecessor kept; all but the last return the
columns of ``documents``, with ``n_chars`` of the text as it then is.  Rows with null or
repeated ids are documents like others in every stage; null and empty texts fail the
quality rules; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsieve.llm import mixing, ngram_join, packing, pii, quality
from graphsieve.llm.common import Scratch
from graphsieve.llm.tokens import vocabulary


#: So that reruns agree; whoever publishes the texts takes a secret one.
SAMPLE_KEY = b"a key that everybody knows"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[Scratch] = []


def stage(f: Stage) -> Stage:
    """A stage's result is written before the next stage begins; what it wrote on the way goes then."""

    @wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LEFT:
            _LEFT.pop().drop()
        before = set(Scratch.LIVE)
        out = f(spark, docs, sf_dir)
        _LEFT.extend(Scratch.LIVE - before)
        return out

    return begin


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; cutoffs come from the labels of documents that are still there."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, that of the smallest id; null ids come last."""
    return ngram_join.keep_one(docs)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with surrogates for what is personal in it."""
    out = pii.replace_pii(docs, SAMPLE_KEY, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is there twice; one that it does not take goes."""
    return mixing.mix_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its place in a sequence; copies of a document are packed as rows of their own."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 0, 2048)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]
#: The thresholds, the hashes and the tokenizer cannot be said in SQL; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = scratch.save(step(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
