"""Registered queries against their SQL, and the pipeline's stages."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from carbonhaul.llm import catalog, toxicity
from carbonhaul.llm.common import staged

from .test_documents import components


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = catalog.queries()[name](spark, sf)
    result = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = sorted(result.fetchall(), key=str)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == want


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    (_, toxic), (_, single), (_, mixed), (_, packed) = corpus_pipeline.STAGES
    clean = staged(toxic(spark, docs, sf), "test-clean")
    assert clean.columns == docs.columns
    scores = toxicity.scored(docs, toxicity.fit(docs, labels))
    assert {r.doc_id for r in clean.collect()} == {
        r.doc_id for r in scores.where("score < 0.5").collect()
    }
    one = staged(single(spark, clean.union(clean.limit(5)), sf), "test-single")
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    firsts = sorted({c for _, _, c in components(rows, 5, 80)})
    assert sorted(r.doc_id for r in one.collect()) == firsts
    assert one.columns == docs.columns
    mix = staged(mixed(spark, one, sf), "test-mix")
    assert mix.columns == docs.columns and mix.subtract(one).isEmpty()
    got = packed(spark, mix, sf)
    starts = got.where("piece = 0").groupBy("doc_id").count()
    copies = mix.groupBy("doc_id").count()
    assert starts.exceptAll(copies).isEmpty() and copies.exceptAll(starts).isEmpty()
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_pipeline_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), "test-empty")
    assert docs.count() == 0
