"""Queries of filters, aggregates, sets, deduplication and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import evaluate as E
from ..operators import retrieval as R
from ..functions import text as T
from ..sources import tables as S
from ..sources.tables import table
from .registry import Fixture, query
from .retrieval_queries import FX_FILES, _bm25, _bm25_sql


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '%URGENT%' AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def docs_filter_sort_limit(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_orderpriority like '%URGENT%' and o_orderdate >= '1995-01-01'")
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-03-01' AND '1995-06-30'")
def docs_range(spark, sf):
    # Compared as times, the range reaches the scan.
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").filter((day >= F.lit("1995-03-01").cast("timestamp_ntz")) & (day < F.lit("1995-07-01").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH {FX_FILES.sql()} SELECT doc_id, filename FROM fx_files WHERE lower(filename) = lower('2023-11-05_xrn-1620b2_교체.pdf')")
def docs_nocase(spark, sf):
    return C.nocase(FX_FILES.df(spark, sf), "filename", "2023-11-05_xrn-1620b2_교체.pdf").select("doc_id", "filename")


@query(f"""WITH {FX_FILES.sql()}, s AS (SELECT doc_id, filename, regexp_replace(lower(filename), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS slug FROM fx_files)
SELECT doc_id, filename FROM s WHERE contains(slug, 'report') OR contains('report', slug) ORDER BY abs(length(slug) - 6), doc_id LIMIT 1""")
def docs_fuzzy_slug(spark, sf):
    return C.fuzzy_slug(FX_FILES.df(spark, sf), "Re-port").select("doc_id", "filename")


@query("SELECT name, value, count(*) AS count FROM (SELECT 'all' AS name, '' AS value FROM documents UNION ALL SELECT 'lang', lang FROM documents WHERE trim(lang) <> '' UNION ALL SELECT 'source', source FROM documents WHERE trim(source) <> '') GROUP BY ALL")
def group_counts(spark, sf):
    return C.statistics(table(spark, sf, "documents"), "lang", "source")


@query("SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def distinct_counts(spark, sf):
    return table(spark, sf, "documents").filter("lang is not null").groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.countDistinct(F.md5("text")).alias("texts"))


@query("SELECT lang, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (n_chars BETWEEN 500 AND 4999) AS middle, count(*) FILTER (n_chars >= 5000) AS long FROM documents GROUP BY lang")
def bucket_counts(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").groupBy("lang").agg(F.count_if(n < 500).alias("short"), F.count_if(n.between(500, 4999)).alias("middle"), F.count_if(n >= 5000).alias("long"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 10")
def filtered_sum_topn(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), "o_custkey").limit(10)


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_keyword_freq(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT band, count(*) AS n, round(sum(amount), 2) AS total FROM (SELECT o_totalprice AS amount, CASE WHEN o_totalprice IS NULL OR o_totalprice = 0 THEN 'missing' WHEN o_totalprice >= 100000000 THEN 'high' WHEN o_totalprice BETWEEN 1 AND 999 THEN 'low' ELSE 'ok' END AS band FROM orders) GROUP BY band")
def amount_anomalies(spark, sf):
    return table(spark, sf, "orders").groupBy(C.amount_band(F.col("o_totalprice")).alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT doc_id, round(n_chars / nullif(len(string_split(text, chr(10))), 0), 6) AS ratio FROM documents WHERE n_chars / nullif(len(string_split(text, chr(10))), 0) < 80")
def ratio_candidates(spark, sf):
    found = C.thin_texts(table(spark, sf, "documents"), 80, F.col("n_chars"), F.size(F.split("text", "\n")))
    return found.select("doc_id", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {FX_FILES.sql()} SELECT * FROM (SELECT doc_id, concat_ws(', ', CASE WHEN drafter IS NULL OR trim(drafter) = '' THEN 'drafter' END, CASE WHEN date IS NULL OR trim(date) = '' THEN 'date' END) AS missing FROM fx_files) WHERE missing <> ''""")
def required_fields(spark, sf):
    return C.missing_fields(FX_FILES.df(spark, sf), "drafter", "date")


@query("""SELECT o_orderkey, round(items, 2) AS items, abs(items - o_totalprice) <= greatest(1, 0.01 * o_totalprice) AS sum_match, n FROM orders JOIN
(SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS items, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def line_item_sum_check(spark, sf):
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("items"), F.count("*").alias("n"))
    both = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(items, "o_orderkey")
    match = F.abs(F.col("items") - F.col("o_totalprice")) <= F.greatest(F.lit(1.0), 0.01 * F.col("o_totalprice"))
    return both.select("o_orderkey", F.round("items", 2).alias("items"), match.alias("sum_match"), "n")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY text")
def dedupe_exact(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("WITH " + _bm25_sql("robertson") + " SELECT doc_id, max(score) AS score, min(query_id) FILTER (score = best) AS query_id FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM bm25) GROUP BY doc_id")
def dedupe_best_score(spark, sf):
    return C.first_of_key(_bm25(spark, sf), "doc_id", F.desc("score"), "query_id").select("doc_id", "score", "query_id")


_KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(filename, '\\.[A-Za-z0-9]+$', ''), '[\\s\\-]+', '_', 'g'), '_*\\(\\d+\\)$', ''), '_\\d$', ''), '_+', '_', 'g') || lower(regexp_extract(filename, '(\\.[A-Za-z0-9]+)$', 1))"


@query(f"WITH {FX_FILES.sql()} SELECT key, min_by(doc_id, created_at) AS doc_id, count(*) AS copies FROM (SELECT *, {_KEY} AS key FROM fx_files) GROUP BY key")
def dedupe_filename(spark, sf):
    named = FX_FILES.df(spark, sf).withColumn("key", T.filename_key(F.col("filename")))
    return named.groupBy("key").agg(F.min_by("doc_id", "created_at").alias("doc_id"), F.count("*").alias("copies"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT *, line IS DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS new FROM l)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM m WHERE new OR pos = 0""")
def consecutive_lines(spark, sf):
    return C.consecutive_lines(table(spark, sf, "documents"))


FX_PAGES = Fixture("fx_pages", "doc_id int, page int, page_text string", [
    (1, 1, "Head  Line\nfirst\nbody\nfoot"), (1, 2, "head line\nsecond\nmore\nFoot"), (1, 3, "HEAD LINE\n\nthird\nfoot"), (2, 1, "a\nb"), (2, 2, "a\nc"), (3, 1, ""),
], also=("documents", "1000000 + doc_id - doc_id % 4", "1 + doc_id % 4", "text"))


@query(f"""WITH {FX_PAGES.sql()}, l AS (SELECT doc_id, page, list_filter(list_transform(string_split(page_text, chr(10)), lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM fx_pages),
h AS (SELECT doc_id, page, unnest(list_distinct(list_concat(l[1:2], l[-2:]))) AS line FROM l) SELECT doc_id, line, count(DISTINCT page) AS pages FROM h GROUP BY ALL HAVING count(DISTINCT page) >= 3""")
def repeated_lines(spark, sf):
    return C.repeated_lines(FX_PAGES.df(spark, sf))


FX_SNAPSHOTS = Fixture("fx_snapshots", "snap int, path string, hash string", [(1, "a", "1"), (1, "b", "2"), (1, "c", "3"), (2, "b", "2"), (2, "c", "4"), (2, "d", "5")], also=("documents", "1 + doc_id % 2", "concat(source, '/', doc_id - doc_id % 2)", "md5(text)"))


@query(f"WITH {FX_SNAPSHOTS.sql()} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'modified' ELSE 'same' END AS change FROM (SELECT * FROM fx_snapshots WHERE snap = 1) o FULL JOIN (SELECT * FROM fx_snapshots WHERE snap = 2) n ON o.path = n.path")
def snapshot_diff(spark, sf):
    both = FX_SNAPSHOTS.df(spark, sf)
    return C.snapshot_diff(both.filter("snap = 1"), both.filter("snap = 2"))


@query("SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'stale' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def two_way_difference(spark, sf):
    return C.two_way_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT count(d) AS in_a, count(l) AS in_b, count(*) FILTER (d IS NOT NULL AND l IS NOT NULL) AS in_both, count(*) AS in_any, round(100.0 * count(*) FILTER (d IS NOT NULL AND l IS NOT NULL) / count(*), 6) AS percent FROM (SELECT DISTINCT doc_id AS d FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS l FROM labels) ON d = l")
def consistency_ratio(spark, sf):
    return C.consistency(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT c_custkey, coalesce(n.total, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) AS total FROM orders GROUP BY o_custkey) n ON o_custkey = c_custkey")
def upsert_last_wins(spark, sf):
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return S.upsert(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), new, "c_custkey", "at")


@query("""WITH """ + _bm25_sql("robertson") + """, good AS (SELECT query_id, min(rank) FILTER (quality = 1) AS rank FROM bm25 LEFT JOIN labels USING (doc_id) GROUP BY query_id)
SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_at_10 FROM good""")
def hit_mrr_at_k(spark, sf):
    rank = F.col("rank")
    return _good(spark, sf).agg(F.count("*").alias("queries"), F.round(E.hit_at(rank, 3), 6).alias("hit_at_3"), F.round(E.mrr_at(rank, 10), 6).alias("mrr_at_10"))


def _good(spark, sf):
    hits = _bm25(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return hits.groupBy("query_id").agg(F.min(F.when(F.col("quality") == 1, F.col("rank"))).alias("rank"))


@query("""WITH """ + _bm25_sql("robertson") + """, good AS (SELECT query_id, min(rank) FILTER (quality = 1) AS rank FROM bm25 LEFT JOIN labels USING (doc_id) GROUP BY query_id) SELECT count(rank) AS ranked, round(avg(1.0 / rank), 6) AS mrr FROM good""")
def mrr_ranked_only(spark, sf):
    return _good(spark, sf).agg(F.count("rank").alias("ranked"), F.round(E.mrr_ranked(F.col("rank")), 6).alias("mrr"))


@query("SELECT event_type, count(*) AS n, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(value, 0.99) AS DOUBLE) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), *[E.nearest_rank("value", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])


FX_EVAL = Fixture("fx_eval", "query_id int, mode string, sources int, rank int, fields array<string>", [(1, "rag", 2, 1, ["answer", "sources"]), (2, "rag", 0, None, ["answer"]), (3, "chat", 0, 3, []), (4, "rag", 1, 12, ["answer", "sources", "mode", "extra"])], also=("documents", "1000000 + doc_id", "lang", "n_chars % 3", "n_chars % 14", "split('answer,sources', ',')"))


@query(f"WITH {FX_EVAL.sql()} SELECT round(avg(CASE WHEN mode = 'rag' THEN CASE WHEN sources > 0 THEN 1.0 ELSE 0.0 END END), 6) AS citation_rate, round(avg(len(list_intersect(fields, ['answer', 'sources', 'mode'])) / 3), 6) AS schema_score FROM fx_eval")
def citation_schema(spark, sf):
    cited = F.avg(F.when(F.col("mode") == "rag", F.when(F.col("sources") > 0, 1.0).otherwise(0.0)))
    return FX_EVAL.df(spark, sf).agg(F.round(cited, 6).alias("citation_rate"), F.round(F.avg(E.schema_score(F.col("fields"), ["answer", "sources"], ["mode"])), 6).alias("schema_score"))


@query("SELECT *, round(count / sum(count) OVER (PARTITION BY day), 6) AS share FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS mode, count(*) AS count, round(avg(value), 6) AS mean_confidence, count(*) FILTER (value < 0.7) AS low FROM events GROUP BY ALL)")
def routing_daily_stats(spark, sf):
    log = table(spark, sf, "events").select("ts", F.col("event_type").alias("mode"), F.col("value").alias("confidence"))
    return E.routing_stats(log, F.date_format("ts", "yyyy-MM-dd"))


@query("SELECT user_id, count(*) AS count FROM events GROUP BY user_id HAVING count(*) >= 3 ORDER BY count DESC, user_id LIMIT 20")
def frequent_values(spark, sf):
    return E.frequent_values(table(spark, sf, "events"), "user_id", 3)


@query("SELECT event_type, count(*) AS n, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 2000 GROUP BY event_type")
def latest_n_percentile(spark, sf):
    return E.latest_percentiles(table(spark, sf, "events"), "value", "ts", "event_id", 2000, "event_type")


@query("""SELECT event_type, count(*) AS n, round(coalesce(sum((1 - exp(-dt / 60)) / dt * exp((t - e) / 60)), 0), 9) AS rate FROM (SELECT event_type, t, max(t) OVER (PARTITION BY event_type) AS e, greatest(t - lag(t) OVER (PARTITION BY event_type ORDER BY t), 1e-6) AS dt FROM (SELECT event_type, epoch_us(ts) / 1e6 AS t FROM events)) GROUP BY event_type""")
def ewma_rate(spark, sf):
    return E.ewma_rate(table(spark, sf, "events"), "event_type", "ts")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_rollup(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


@query()
def approx_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.approx_count_distinct("l_orderkey").alias("orders"))


@query("SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, value FROM events) GROUP BY ALL")
def tumbling_window(spark, sf):
    w = F.window("ts", "1 hour")
    return table(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


@query("SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * k) AS window_start, value FROM events, range(0, 4) r(k)) GROUP BY ALL")
def sliding_window(spark, sf):
    w = F.window("ts", "1 hour", "15 minutes")
    return table(spark, sf, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "mean")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_window(spark, sf):
    w = F.session_window("ts", "30 minutes")
    return table(spark, sf, "events").groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("""WITH log AS (SELECT strftime(ts, '%Y-%m-%d') AS day, ts, CAST(event_id AS VARCHAR) AS query, event_type AS mode, value AS confidence FROM events WHERE value < 0.7)
SELECT day, CAST(turn AS INTEGER) AS turn, query, mode, confidence FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, query, mode, confidence) AS turn FROM log) WHERE turn <= 10""")
def low_confidence_decisions(spark, sf):
    log = table(spark, sf, "events").select("ts", F.col("event_id").cast("string").alias("query"), F.col("event_type").alias("mode"), F.col("value").alias("confidence"))
    return E.low_confidence(log, F.date_format("ts", "yyyy-MM-dd"))


@query("SELECT count(DISTINCT f) AS files FROM (SELECT source || '_' || (doc_id // 3) || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' ELSE '.pdf.bak' END AS f FROM documents) WHERE lower(f) LIKE '%.pdf' OR lower(f) LIKE '%.txt'")
def unique_files(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, (".PDF", ".txt", ".pdf", ".pdf.bak"))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat("source", F.lit("_"), F.expr("doc_id div 3").cast("string"), suffix)
    return C.unique_files(table(spark, sf, "documents").select(name.alias("filename")))


@query("""WITH r AS (SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'answer' END, CASE WHEN doc_id % 3 > 0 THEN 'sources' END, CASE WHEN doc_id % 5 = 0 THEN 'mode' END, CASE WHEN n_chars > 500 THEN 'pages' END, 'other'], lambda x: x IS NOT NULL) AS fields FROM documents),
c AS (SELECT doc_id, list_filter(['answer', 'sources', 'pages'], lambda x: NOT list_contains(fields, x)) AS missing, list_filter(['mode'], lambda x: list_contains(fields, x)) AS present FROM r)
SELECT doc_id, len(missing) / 3 <= 0.34 AS valid, round((3 - len(missing) + len(present)) / 4, 6) AS score, array_to_string(missing, ',') AS missing, array_to_string(present, ',') AS present, round(len(missing) / 3, 6) AS missing_rate FROM c""")
def schema_checks(spark, sf):
    when = lambda c, n: F.when(c, F.lit(n))
    d = F.col("doc_id")
    fields = F.array_compact(F.array(when(d % 2 == 0, "answer"), when(d % 3 > 0, "sources"), when(d % 5 == 0, "mode"), when(F.col("n_chars") > 500, "pages"), F.lit("other")))
    rows = table(spark, sf, "documents").select("doc_id", E.schema_check(fields, ["answer", "sources", "pages"], ["mode"], 0.34).alias("s"))
    text = lambda n: F.array_join(f"s.{n}", ",").alias(n)
    return rows.select("doc_id", "s.valid", F.round("s.score", 6).alias("score"), text("missing"), text("present"), F.round("s.missing_rate", 6).alias("missing_rate"))
