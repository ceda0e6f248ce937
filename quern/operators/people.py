"""Who a query is about, and routes that know the hits: joins with closed sets of names and of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import queries as Q
from ..functions import understanding as U
from ..functions.text import jamo_ratio
from .fuzzy import near_names


def known_names(drafters: DataFrame, name: str = "drafter") -> DataFrame:
    """key, original: each normalised name with its longest spelling (of equals the smallest)."""
    rows = drafters.select(F.col(name).alias("original")).filter("original is not null and original <> ''").distinct()
    keyed = rows.withColumn("key", U.normalized_name(F.col("original")))
    return keyed.groupBy("key").agg(F.min_by("original", F.struct(-F.length("original"), "original")).alias("original"))


def drafter_names(docs: DataFrame, name: str = "drafter", unknown: tuple[str, ...] = ("미상", "작성자 미상")) -> DataFrame:
    """The distinct drafters, without blanks and stand-ins."""
    return docs.select(name).filter(F.col(name).isNotNull() & (F.col(name) != "") & ~F.col(name).isin(*unknown)).distinct()


def parse_filters(queries: DataFrame, drafters: DataFrame, today: Column, least: float = 0.87) -> DataFrame:
    """query_id, year_lo, year_hi, drafter, source of queries (query_id, query).

    Directives (``year:``, ``drafter:``) come first; else years as ``queries.years`` has them, and the first candidate that
    is a known name (``closed_world``) or, if none is, the likest one of ``least`` or more (``fuzzy``). Candidates meet names
    by the normalised name, or as strings that are alike (``fuzzy.near_names``), of lengths that differ by one at most.
    """
    names = known_names(drafters)
    directed = F.nullif(U.normalized_name(U.directed_drafter(F.col("query"))), F.lit(""))
    q = queries.select("query_id", "query", U.directed_year(F.col("query"), today).alias("y"), directed.alias("d"))
    q = q.join(names.select(F.col("key").alias("d"), F.col("original").alias("by_token")), "d", "left")
    token = F.col("y").isNotNull() | F.col("by_token").isNotNull()
    open_ = q.filter(~token).select("query_id", F.posexplode(U.name_candidates(F.col("query"))).alias("place", "c")).withColumn("key", U.normalized_name(F.col("c"))).filter(F.length("key").between(2, 4))
    exact = open_.join(names, "key").groupBy("query_id").agg(F.min_by("original", F.struct("place", "key")).alias("exact"))
    pairs = near_names(open_.select(F.col("key").alias("text")), names.select(F.col("key").alias("text"))).filter(F.abs(F.length("a") - F.length("b")) <= 1)
    pairs = pairs.withColumn("jamo", jamo_ratio(F.col("a"), F.col("b"))).filter("jamo >= 0.8").select(F.col("a").alias("key"), F.col("b").alias("other"), "jamo")
    near = open_.select("query_id", "key").distinct().join(pairs, "key").join(names.select(F.col("key").alias("other"), "original"), "other")
    plain = F.greatest(F.lit(0.0), 1 - F.levenshtein("key", "other") / F.greatest(F.length("key"), F.length("other")))
    near = near.withColumn("score", F.round(0.5 * plain + 0.5 * F.col("jamo"), 9)).filter(F.col("score") >= least)
    fuzzy = near.groupBy("query_id").agg(F.min_by("original", F.struct(-F.col("score"), "other")).alias("fuzzy"))
    out = q.withColumn("token", token).join(exact, "query_id", "left").join(fuzzy, "query_id", "left").withColumn("years", Q.years(F.col("query"), today))
    source = F.when(F.col("token"), "token").when(F.col("exact").isNotNull(), "closed_world").when(F.col("fuzzy").isNotNull(), "fuzzy")
    year = lambda side: F.when(F.col("token"), F.col("y")).otherwise(F.col(f"years.{side}"))
    return out.select("query_id", year("lo").alias("year_lo"), year("hi").alias("year_hi"), F.when(F.col("token"), F.col("by_token")).otherwise(F.coalesce("exact", "fuzzy")).alias("drafter"), source.alias("source"))


def route_with_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, mode, confidence, reason, doc_id of queries (query_id, query) and hits (query_id, doc_id, title).

    A query for contents whose likest hit is 0.66 or more (or its only one) is about that document; others are routed by their words.
    """
    both = hits.join(queries, "query_id").withColumn("like", F.round(U.name_likeness(F.col("query"), F.col("title")), 9))
    top = both.withColumns({"turn": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("like"), "doc_id")), "n": F.count("*").over(Window.partitionBy("query_id"))}).filter("turn = 1").select("query_id", "doc_id", "like", "n")
    wants = F.col("query").rlike(f"(?i){Q.CONTENT}")
    out = queries.join(top, "query_id", "left").withColumn("one", F.coalesce(wants & ((F.col("n") == 1) | (F.col("like") >= 0.66)), F.lit(False))).withColumn("r", Q.route(F.col("query")))
    pick = lambda a, b: F.when(F.col("one"), a).otherwise(b)
    return out.select("query_id", pick(F.lit("DOCUMENT"), F.col("r.mode")).alias("mode"), pick(F.col("like"), F.col("r.confidence")).alias("confidence"), pick(F.lit("single_candidate"), Q.routing_reason(F.col("query"))).alias("reason"), F.when(F.col("one"), F.col("doc_id")).alias("doc_id"))


def coverage(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, top_score, coverage: the number of the query's domain words that its hits (query_id, rank, score, text) hold, of the first ten."""
    first = hits.filter("rank <= 10").join(queries, "query_id").withColumn("w", F.explode_outer(U.domain_words(F.col("query"))))
    met = F.when(F.lower("text").contains(F.col("w")), F.col("w"))
    return first.groupBy("query_id").agg(F.max("score").alias("top_score"), F.count_distinct(met).alias("coverage"))
