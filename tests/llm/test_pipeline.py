import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import CLASH, DOCS, odd_rows, passages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = odd_rows() + [(1000 + i, t) for i, t in passages(5)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    docs.withColumns({c: F.lit("x") for c in CLASH}).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(1000, 1030)] + [(i, 0, 0) for i in range(1030, 1033)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_keep_the_columns_and_whole_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        before_ids, after_ids = (collections.Counter(r["doc_id"] for r in df.select("doc_id").collect()) for df in (docs, after))
        assert not after_ids - before_ids, name
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    places = collections.defaultdict(list)
    for r in out.collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS + ", lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
