"""The registered queries: SQL where there is some, and the pipeline's stages on the smallest documents."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from quern.llm import decontamination, neardup, repeats

NAMES = [n for n in __spark_entry__.queries() if n.startswith("op")]


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", [n for n in NAMES if n in __spark_entry__.oracle_sql()])
def test_same_rows(name, spark, sf):
    duck = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    ours, theirs = __spark_entry__.queries()[name](spark, sf).toPandas(), duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    plain = lambda df: sorted(str([None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x for x in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())  # noqa: E731  a column of numbers with nulls comes as floats
    assert plain(ours) == plain(theirs)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, before, sf).cache()
        assert out.columns == columns and 0 < out.count() <= before.count()
        if k == 1:
            assert neardup.classes(out).filter("doc_id <> class_id").count() == 0
        if k == 2:
            assert repeats.report(out).agg({"n_removed": "sum"}).first()[0] < 0.01 * out.agg({"n_chars": "sum"}).first()[0]
        if k == 3:
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontamination.report(decontamination.hits(out, bench)).filter("contaminated").count() == 0
        before = out
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
