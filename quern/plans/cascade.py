"""The cascade retriever for tables of queries: exact codes, then words in file names and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog as C
from ..operators import retrieval as R
from ..operators.segments import FEW
from ..sources.stored import stored


def cascade(docs: DataFrame, codes: DataFrame, queries: DataFrame, k: int = 20, use_fts: bool = True, index: R.Index | None = None, **bm25) -> DataFrame:
    """query_id, doc_id, stage, score, rank.

    ``docs``: doc_id, filename, text, drafter. ``queries``: query_id, query. All stages are planned for all
    queries; a query with code hits keeps those alone, else documents that hold any of its terms come
    first if there are at least half of ``k``, else BM25's follow them. Scores are of relevance with the
    bonus for the file name, over whole texts; the first ``k`` stay. ``index``: that of ``docs``, if there is one.
    """
    index = index or R.Index(docs)
    asked = queries.withColumn("text", F.col("query"))
    found = queries.select("query_id", F.explode(R.T.extract_codes(F.col("query"))).alias("code"))
    exact = stored(R.code_hits(codes, docs, found, k).select("query_id", "doc_id", F.lit(0).alias("stage")), "exact")  # codes are taken from texts once
    words = R.or_match(index, asked, 2 * k).select("query_id", "doc_id", F.lit(1).alias("stage"), F.lit(0).alias("n"))
    words = words.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))) if use_fts else words.limit(0)
    ranked = R.bm25(index, asked, 2 * k, **bm25).select("query_id", "doc_id", F.lit(2).alias("stage"))
    enough = words.filter(F.col("n") >= k / 2).select("query_id").distinct()
    rest = words.drop("n").unionByName(ranked.join(enough, "query_id", "left_anti"))
    both = exact.unionByName(rest.join(exact.select("query_id").distinct(), "query_id", "left_anti"))
    first = stored(C.first_of_key(both, ["query_id", "doc_id"], "stage"), "first")
    # Few rows meet the texts where these are; texts are not dealt out.
    few = F.broadcast(first) if first.count() <= FEW else first
    joined = docs.select("doc_id", "filename", "text", "drafter").join(few, "doc_id").join(queries, "query_id")
    score = R.relevance(F.col("query"), F.col("filename"), F.col("text"), F.col("drafter")) + R.filename_bonus(F.col("query"), F.col("filename"))
    return R.ranked(joined.select("query_id", "doc_id", "stage", score.alias("score")), "score", k)
