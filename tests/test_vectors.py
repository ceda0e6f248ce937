"""Approximate vector search: recall against the exact one, every vector listed, appended vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import vectors as V
from quern.operators.retrieval import vector_topk
from quern.plans import QUERIES
from quern.sources.stored import fresh_path


def table(spark, m, first=0):
    return spark.createDataFrame([(first + k, [float(x) for x in v]) for k, v in enumerate(m)], "doc_id bigint, vector array<float>")


def hits(df):
    return {(r["query_id"], r["doc_id"]) for r in df.collect()}


def test_recall_on_embeddings(spark, sf):
    for d in (sf, "/root/testdata/sf0.01"):
        exact, found = hits(QUERIES["vector_cosine_topk"](spark, d)), hits(QUERIES["vector_ann_topk"](spark, d))
        assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_clusters_need_few_lists(spark, metric):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 16)) * 10
    m = (centers[rng.integers(0, 20, 800)] + rng.normal(size=(800, 16))).astype(np.float32)
    vectors = table(spark, m)
    index = V.VectorIndex.build(vectors, fresh_path(spark, "vectors"), metric)
    queries = vectors.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"))
    exact, found = vector_topk(vectors, queries, 10, metric), index.search(queries, 10)
    assert index.probes <= len(index.centroids) // 2
    assert len(hits(exact) & hits(found)) >= 0.9 * exact.count()
    whole = index.search(queries, 10, probes=len(index.centroids))  # all lists: the same rows, scores and ranks
    plain = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 4), r["rank"]) for r in df.collect())
    assert plain(whole) == plain(exact)


def test_every_vector_is_listed_and_more_can_be_added(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(150, 8)).astype(np.float32)
    m[:60] = m[0]  # a hot list
    index = V.VectorIndex.build(table(spark, m[:100]).unionByName(spark.createDataFrame([(999, None)], "doc_id bigint, vector array<float>")), fresh_path(spark, "vectors"), lists=5)
    index.add(table(spark, m[100:], 100))
    lists = spark.read.parquet(f"{index.path}/lists")
    assert sorted(r[0] for r in lists.select(F.explode("ids")).collect()) == list(range(150))
    assert lists.agg(F.max("size")).first()[0] <= 16
    asked = spark.createDataFrame([(1, [float(x) for x in m[120]]), (2, None)], "query_id bigint, query array<float>")
    best = index.search(asked, 3, probes=5).filter("rank = 1").collect()
    assert [(r["query_id"], r["doc_id"]) for r in best] == [(1, 120)]


def test_one_vector(spark):
    index = V.VectorIndex.build(table(spark, np.ones((1, 4), np.float32)), fresh_path(spark, "vectors"))
    assert [r["doc_id"] for r in index.search(spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id bigint, query array<float>")).collect()] == [0]
