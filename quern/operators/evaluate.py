"""Retrieval evaluation, telemetry and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hit_at(rank: Column, k: int) -> Column:
    """Share of rows whose rank is k at most; a null rank is a miss."""
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def mrr_at(rank: Column, k: int) -> Column:
    """Mean of 1 / rank, 0 beyond k and for misses."""
    return F.avg(F.when(rank <= k, 1.0 / rank).otherwise(0.0))


def mrr_ranked(rank: Column) -> Column:
    """Mean of 1 / rank over rows that have a rank."""
    return F.avg(1.0 / rank)


def nearest_rank(value: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def index_percentile(values: Column, p: float) -> Column:
    """sorted[int(n p)] of an array."""
    n = F.size(values)
    return F.element_at(F.sort_array(values), F.least(n, F.floor(n * p).cast("int") + 1))


def exclusive_quantile(values: Column, p: float) -> Column:
    """The exclusive method: position (n + 1) p, interpolated, within the ends."""
    s, n = F.sort_array(values), F.size(values)
    pos = F.greatest(F.lit(1.0), F.least(n.cast("double"), (n + 1) * p))
    lo = F.floor(pos).cast("int")
    a = F.element_at(s, lo)
    return a + (pos - lo) * (F.element_at(s, F.least(n, lo + 1)) - a)


def schema_score(fields: Column, required: list[str], optional: list[str]) -> Column:
    """Share of the required and optional fields that are there."""
    wanted = F.array(*map(F.lit, [*required, *optional]))
    return F.size(F.array_intersect(fields, wanted)) / F.lit(len(required) + len(optional))


def schema_check(fields: Column, required: list[str], optional: list[str], tolerated: float = 0.0) -> Column:
    """struct valid, score, missing (required fields that are not there), present (optional ones that are), missing_rate.

    A response is valid with all required fields, or if no greater share of them than ``tolerated`` is missing.
    """
    need, may = (F.array(*map(F.lit, x)).cast("array<string>") for x in (required, optional))
    missing, present = F.array_except(need, fields), F.array_intersect(may, fields)
    rate = F.size(missing) / F.lit(len(required)) if required else F.lit(0.0)
    all_ = len(required) + len(optional)
    score = (F.lit(len(required)) - F.size(missing) + F.size(present)) / F.lit(all_) if all_ else F.lit(0.0)
    return F.struct((rate <= F.lit(tolerated)).alias("valid"), score.alias("score"), missing.alias("missing"), present.alias("present"), rate.alias("missing_rate"))


def low_confidence(log: DataFrame, day: Column, least: float = 0.7, first: int = 10) -> DataFrame:
    """Of each day the ``first`` decisions (ts, query, mode, confidence) below ``least``, in order of time, numbered."""
    low = log.filter(F.col("confidence") < least).withColumn("day", day)
    order = Window.partitionBy("day").orderBy("ts", "query", "mode", "confidence")
    return low.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= first).select("day", "turn", "query", "mode", "confidence")


def routing_stats(log: DataFrame, day: Column) -> DataFrame:
    """day, mode, count, share of the day, mean confidence, low (below 0.7)."""
    found = log.groupBy(day.alias("day"), "mode").agg(F.count("*").alias("count"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("confidence") < 0.7).alias("low"))
    return found.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("day")), 6))


def frequent_values(df: DataFrame, column: str, least: int, top: int = 20) -> DataFrame:
    """Values met ``least`` times or more, the most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("count")).filter(F.col("count") >= least).orderBy(F.desc("count"), column).limit(top)


def latest_percentiles(df: DataFrame, value: str, ts: str, key: str, n: int, by: str) -> DataFrame:
    """p50 and p95 (nearest rank) of each group's last n values."""
    w = Window.partitionBy(by).orderBy(F.desc(ts), F.desc(key))
    last = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return last.groupBy(by).agg(F.count("*").alias("n"), nearest_rank(value, 0.5).alias("p50"), nearest_rank(value, 0.95).alias("p95"))


def ewma_rate(events: DataFrame, by: str, ts: str, horizon: float = 60.0, span: int = 3600) -> DataFrame:
    """by, n, rate: events a second, averaged with weights that fall with time.

    Each event after dt seconds moves the rate to rate + a (1 / dt - rate), with a = 1 - exp(-dt / horizon). Over a group in
    order of time that is a sum of each step's a / dt times the exponentials of the time after it, so
    it needs no state from row to row: rate = sum (1 - exp(-dt / h)) / dt x exp(-(end - t) / h).
    The first event counts as one after 1e-6 seconds, the least dt. The sum is taken within spans of ``span`` seconds first, each brought to its own end; the spans, few for each group, add what lies between them.
    So a group of any size is spread over tasks by time.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    weigh = lambda dt, age: (1 - F.exp(-dt / horizon)) / dt * F.exp(-age / horizon)
    within = Window.partitionBy(by, "_span")
    own = events.select(by, seconds.alias("_t")).withColumn("_span", F.floor(F.col("_t") / span))
    since = F.col("_t") - F.lag("_t").over(within.orderBy("_t"))
    own = own.withColumn("_dt", F.when(since.isNotNull(), F.greatest(since, F.lit(1e-6)))).withColumn("_last", F.max("_t").over(within))
    part = F.coalesce(F.sum(weigh(F.col("_dt"), F.col("_last") - F.col("_t"))), F.lit(0.0))
    spans = own.groupBy(by, "_span").agg(F.count("*").alias("_n"), F.min("_t").alias("_first"), F.max("_t").alias("_last"), part.alias("_part"))
    whole = Window.partitionBy(by)
    joined = spans.withColumn("_gap", F.greatest(F.col("_first") - F.lag("_last").over(whole.orderBy("_span")), F.lit(1e-6))).withColumn("_end", F.max("_last").over(whole))
    between = F.coalesce(weigh(F.col("_gap"), F.col("_last") - F.col("_first")), F.lit(0.0))
    rate = F.sum((F.col("_part") + between) * F.exp((F.col("_last") - F.col("_end")) / horizon))
    return joined.groupBy(by).agg(F.sum("_n").alias("n"), F.round(rate, 9).alias("rate"))


def case_results(hits: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """query_id, hits_at_k, reciprocal rank, passed: of cases (query_id, expected, min_hits) against hits (query_id, value, rank)."""
    good = cases.join(hits, "query_id", "left").withColumn("_ok", F.col("value") == F.col("expected"))
    out = good.groupBy("query_id", "min_hits").agg(F.count_if(F.col("_ok") & (F.col("rank") <= k)).alias("hits_at_k"), F.coalesce(1.0 / F.min(F.when(F.col("_ok"), F.col("rank"))), F.lit(0.0)).alias("rr"))
    return out.select("query_id", "hits_at_k", "rr", (F.col("hits_at_k") >= F.col("min_hits")).alias("passed"))


def exposition(metrics: DataFrame) -> DataFrame:
    """Lines of text for a scraper, from name and value."""
    return metrics.select(F.format_string("%s %s", F.col("name"), F.col("value").cast("string")).alias("line"))


def verdicts(results: DataFrame) -> DataFrame:
    """``results`` (expected_mode, actual_mode, expected_citations, has_citations, error) with status PASS, FAIL or ERROR."""
    good = (F.col("actual_mode") == F.col("expected_mode")) & (F.col("has_citations") == F.col("expected_citations"))
    return results.withColumn("status", F.when(F.col("error").isNotNull(), "ERROR").when(good, "PASS").otherwise("FAIL"))


def verdict_report(judged: DataFrame, by: str) -> DataFrame:
    """For each group and for all of them (null): total, passed, failed, errors, mean latency and score of those without an error."""
    ok = F.col("status") != "ERROR"
    return judged.cube(by).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(n) for n, s in (("passed", "PASS"), ("failed", "FAIL"), ("errors", "ERROR"))],
        F.round(F.coalesce(F.avg(F.when(ok, F.col("latency"))), F.lit(0.0)), 6).alias("mean_latency"), F.round(F.coalesce(F.avg(F.when(ok, F.col("top_score"))), F.lit(0.0)), 6).alias("mean_score"),
    )


def coverage_check(results: DataFrame, least: int) -> DataFrame:
    """query_id, meets, ratio (1 at most): whether enough chunks were used."""
    return results.select("query_id", (F.col("chunks_used") >= least).alias("meets"), F.least(F.lit(1.0), F.col("chunks_used") / F.lit(max(1, least))).alias("ratio"))


def benchmark(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, hit, rr of retrieved (query_id, doc_id, rank) against expected (query_id, doc_id) documents."""
    met = hits.join(expected.distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return expected.select("query_id").distinct().join(met, "query_id", "left").select("query_id", F.col("first").isNotNull().alias("hit"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 9).alias("rr"))


def suite_summary(cases: DataFrame, latency: str = "latency") -> DataFrame:
    """One row of cases (passed, hits_at_k, min_hits, rr): total, passed, hit rate, mean reciprocal rank, p95 of the latency."""
    hit = F.avg((F.col("hits_at_k") >= F.col("min_hits")).cast("double"))
    return cases.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.round(hit, 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"), nearest_rank(latency, 0.95).alias("p95"))


def call_summary(calls: DataFrame, name: str, seconds: str, failed: Column) -> DataFrame:
    """One row: functions, calls, total time, errors, and the names with the longest, the shortest and the most calls (ties: the smallest name)."""
    each = calls.groupBy(name).agg(F.count("*").alias("n"), F.sum(seconds).alias("t"), F.max(seconds).alias("hi"), F.min(seconds).alias("lo"), F.count_if(failed).alias("e"))
    return each.agg(F.count("*").alias("functions"), F.sum("n").alias("calls"), F.round(F.sum("t"), 4).alias("total"), F.sum("e").alias("errors"), F.min_by(name, F.struct(-F.col("hi"), name)).alias("slowest"), F.min_by(name, F.struct("lo", name)).alias("fastest"), F.min_by(name, F.struct(-F.col("n"), name)).alias("most_called"))
