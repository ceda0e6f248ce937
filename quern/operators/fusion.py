"""Putting ranked lists together: rank and score fusion, boosts, phases, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .retrieval import ranked


def minmax(df: DataFrame, score: str = "score", by: str = "query_id", out: str = "norm") -> DataFrame:
    """Scores of each list between 0 and 1; 1 where all are equal."""
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(hi == lo, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo)))


def rrf_weighted(vector: DataFrame, words: DataFrame, k: int = 20, w_vector: float = 0.1, w_words: float = 0.9) -> DataFrame:
    """Reciprocal ranks (from 1) of two lists, weighted; one row for each query and document."""
    v = vector.select("query_id", "doc_id", F.col("rank").alias("rv"))
    b = words.select("query_id", "doc_id", F.col("rank").alias("rb"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return ranked(v.join(b, ["query_id", "doc_id"], "full").select("query_id", "doc_id", (part(w_vector, "rv") + part(w_words, "rb")).alias("score")), "score", digits=9)


def rrf_plain(*lists: DataFrame, k: int = 60) -> DataFrame:
    """The sum of 1 / (k + rank) over any number of lists."""
    both = None
    for df in lists:
        one = df.select("query_id", "doc_id", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part"))
        both = one if both is None else both.unionByName(one)
    return ranked(both.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), "score", digits=9)


def weighted_sum(vector: DataFrame, words: DataFrame, w_vector: float = 0.1, w_words: float = 0.9) -> DataFrame:
    """Scores divided by their list's highest, weighted and added; those above 0."""
    w = Window.partitionBy("query_id")
    share = lambda df, c: df.select("query_id", "doc_id", F.coalesce(F.try_divide(F.col("score"), F.max("score").over(w)), F.lit(0.0)).alias(c))
    both = share(vector, "sv").join(share(words, "sb"), ["query_id", "doc_id"], "full")
    score = w_vector * F.coalesce("sv", F.lit(0.0)) + w_words * F.coalesce("sb", F.lit(0.0))
    return ranked(both.select("query_id", "doc_id", score.alias("score")).filter(F.round("score", 9) > 0), "score", digits=9)


def year_boost(score: Column, year: Column, filename: Column, source: Column) -> Column:
    """1.5 times the score if the year stands in file name or source."""
    there = F.coalesce(filename, F.lit("")).contains(year) | F.coalesce(source, F.lit("")).contains(year)
    return F.when(year.isNotNull() & there, score * 1.5).otherwise(score)


def keyword_boost(amounts: Column, models: Column, names: Column, content: Column, filename: Column) -> Column:
    """The factor: 2 for each amount found (1.8 if only its digits are), 1.7 for each model, 1.5 for each name."""
    found = lambda x: content.contains(x) | filename.contains(x)
    digits = lambda x: F.regexp_replace(x, "[,원]", "")
    bare = F.regexp_replace(F.concat_ws("\n", content, filename), ",", "")
    amount = lambda x: F.when(found(x), 2.0).when(digits(x).rlike(r"^\d{4,}$") & bare.contains(digits(x)), 1.8).otherwise(1.0)
    product = lambda xs, f: F.aggregate(xs, F.lit(1.0), lambda a, x: a * f(x))
    return product(amounts, amount) * product(models, lambda x: F.when(found(x), 1.7).otherwise(1.0)) * product(names, lambda x: F.when(found(x), 1.5).otherwise(1.0))


def query_keywords(query: Column) -> dict[str, Column]:
    """Amounts, model codes and longer Hangul words of a query."""
    all_ = lambda p: F.regexp_extract_all(query, F.lit(f"({p})"), F.lit(1))
    return {"amounts": F.array_distinct(F.concat(all_(r"[\d,]+원"), all_(r"\d+만원"), all_(r"\d+억원"), all_(r"[\d,]*\d[\d,]*"))), "models": F.array_distinct(F.concat(all_("[A-Z]+-[0-9A-Z]+"), all_(r"[A-Z]+\s+[A-Z0-9]+"))), "names": F.array_distinct(all_("[가-힣]{3,4}"))}


def multilevel(candidates: DataFrame, k: Column, floor: float = 0.2) -> DataFrame:
    """Phases over query_id, doc_id, vector_score, bm25_score, keyword_score, rerank_score.

    1: the first 50 by vector score, at ``floor`` or more. 2: 0.5, 0.3 and 0.2 of the three scores, the best
    20. 3: of more than 10 the best 10 by rerank score. 4: the best ``k`` of the query. Ties by doc_id.
    """
    top = lambda df, score, n: df.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id"))).filter(F.col("_r") <= n)
    one = top(candidates, "vector_score", 50).filter(F.col("vector_score") >= floor)
    mixed = F.round(0.5 * F.col("vector_score") + 0.3 * F.coalesce("bm25_score", F.lit(0.0)) + 0.2 * F.coalesce("keyword_score", F.lit(0.0)), 9)
    two = top(one.withColumn("score", mixed), "score", 20).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    three = two.withColumn("score", F.when(F.col("n") > 10, F.col("rerank_score")).otherwise(F.col("score")))
    last = top(three, "score", 10).withColumn("rank", F.col("_r"))
    return last.filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each query how many documents rose, fell or stayed, and the scores' mean, deviation, least and most."""
    both = before.select("query_id", "doc_id", F.col("rank").alias("r0")).join(after.select("query_id", "doc_id", F.col("rank").alias("r1"), "score"), ["query_id", "doc_id"])
    return both.groupBy("query_id").agg(
        F.count_if(F.col("r1") < F.col("r0")).alias("improved"), F.count_if(F.col("r1") > F.col("r0")).alias("degraded"), F.count_if(F.col("r1") == F.col("r0")).alias("unchanged"),
        F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.stddev_pop("score"), 6).alias("std_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def pin(hits: DataFrame, doc_id: Column) -> DataFrame:
    """A chosen document becomes the first of its query, with the score 99.9."""
    score = F.when(F.col("doc_id") == doc_id, F.lit(99.9)).otherwise(F.col("score"))
    return ranked(hits.drop("rank").withColumn("score", score), "score")


def single_document(hits: DataFrame) -> DataFrame:
    """Up to three hits of the first hit's document with 0.7 of its score (0.1 at least) if there are two; else the first three.

    ``hits``: query_id, source, score, rank.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    same = (F.col("source") == F.first("source").over(w)) & (F.col("score") >= F.greatest(F.lit(0.1), 0.7 * F.first("score").over(w)))
    flagged = hits.withColumn("_same", same).withColumn("_n", F.sum(F.col("_same").cast("int")).over(Window.partitionBy("query_id")))
    kept = flagged.filter((F.col("_n") < 2) | F.col("_same")).withColumn("rank", F.row_number().over(w))
    return kept.filter("rank <= 3").drop("_same", "_n")
