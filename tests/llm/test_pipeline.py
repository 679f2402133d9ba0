"""The pipeline's stages against their own plain versions, and the registered queries on small tables."""

import os
import re
from collections import Counter

import pytest
import __spark_entry__ as entry
import corpus_pipeline
from graphsieve.llm import ngram_join, pii, quality

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@needs_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]
    one = corpus_pipeline.quality_rules(spark, docs, SMALL).cache()
    kept = {r["doc_id"] for r in quality.judge(docs, labels).where("kept").collect()}
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns
    two = corpus_pipeline.near_duplicates(spark, one, SMALL).cache()
    found = ngram_join.jaccard_components(one).collect()
    assert {r["doc_id"] for r in two.collect()} == {r["component_id"] for r in found}
    three = corpus_pipeline.personal_data(spark, two, SMALL).cache()
    before = {r["doc_id"]: r["text"] for r in two.collect()}
    for r in three.collect():
        old = pii.entities(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) and not any(x.written in r["text"] for x in old)
        assert old or r["text"] == before[r["doc_id"]]
    four = corpus_pipeline.mix(spark, three, SMALL).cache()
    assert four.columns == docs.columns and max(Counter(r["doc_id"] for r in four.collect()).values()) <= 3
    last = corpus_pipeline.pack(spark, four, SMALL).collect()
    assert Counter(r["doc_id"] for r in last if r["piece"] == 0) == Counter(r["doc_id"] for r in four.collect())


@needs_tables
def test_run_agrees_with_itself(spark):
    a, b = (Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SMALL).collect()) for _ in range(2))
    assert a == b and a


def test_awkward_rows_pass_all_stages(spark, docs, empty, tmp_path):
    """Null and repeated ids, null and empty texts, clashing columns; and a table without rows."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, quality int")
    for name, table in (("some", docs), ("none", empty)):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert bool(out) == (name == "some")
        ids = {r["doc_id"] for r in docs.collect()}
        assert {r["doc_id"] for r in out} <= ids


@needs_tables
@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_queries_cover_their_table(spark, name):
    rows = entry.queries()[name](spark, SMALL).collect()
    table = "pages" if name.startswith("op6") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    ids = {r[key] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()}
    assert {r[key] for r in rows} == ids


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "graphsieve")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"(?:import|from)\s.*\bllm\b", open(os.path.join(folder, f)).read()), f
