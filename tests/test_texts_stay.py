"""The cascade's few rows meet the texts where these are, and a text is made small once for all words of a query."""

from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.plans.cascade import cascade


def test_a_text_is_made_small_once(spark):
    rows = [("Ab cd", "ab.pdf", "x AB CD " + "y" * 100, "Kim"), ("ab", "x.pdf", "ab", None), ("zz", None, None, None), (".", "a", "b", "c"), (None, "a", "b", "c")]
    df = spark.createDataFrame(rows, "q string, f string, s string, d string")
    out = df.select(R.relevance(*map(F.col, "qfsd")).alias("r"))
    assert out._jdf.queryExecution().analyzed().toString().count("lower(coalesce(s") == 1
    assert [round(r.r, 6) for r in out.collect()] == [6.4, 4.2, 0.000006, 0.5, 10.0]


def test_texts_are_not_dealt_out(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "aa bb", "kim"), (2, "b.pdf", "bb AB-12", "lee"), (3, None, None, None)], "doc_id bigint, filename string, text string, drafter string")
    codes = spark.createDataFrame([(2, "AB12")], "doc_id bigint, norm_code string")
    asked = spark.createDataFrame([(1, "bb"), (2, "AB-12"), (3, "zz")], "query_id bigint, query string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = cascade(docs, codes, asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = {(r.query_id, r.doc_id, r.stage) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [doc_id" in plan
    assert rows == {(1, 1, 1), (1, 2, 1), (2, 2, 0)}
