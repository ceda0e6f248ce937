"""Queries of the document table, cleaning, contexts and evaluation, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import queries as Q
from ..functions import text as T
from ..operators import catalog as C
from ..operators import cleaning as L
from ..operators import context as X
from ..operators import evaluate as E
from ..sources import tables as S
from ..sources.tables import table
from .registry import query
from .retrieval_queries import _bm25, _bm25_sql, _queries
from .understanding_queries import _asked, _list, _Q, _text

_DOCS = "SELECT doc_id, coalesce(text, '') AS text, source AS drafter, lang AS doctype, '20' || lpad(CAST(15 + doc_id % 10 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '-15' AS date FROM documents"


def _catalog(spark, sf):
    """Documents with the fields of a document table: drafter, doctype, and a date made from the id."""
    date = F.concat(F.lit("20"), F.lpad((15 + F.col("doc_id") % 10).cast("string"), 2, "0"), F.lit("-"), F.lpad((1 + F.col("doc_id") % 12).cast("string"), 2, "0"), F.lit("-15"))
    return S.document_table(spark, f"{sf}/documents.parquet").withColumn("date", date).withColumn("category", F.col("doctype"))


@query(f"SELECT doc_id, drafter, date FROM ({_DOCS}) WHERE contains(drafter, '1') AND CAST(left(date, 4) AS INTEGER) BETWEEN 2017 AND 2021 AND contains(doctype, 'e') AND date BETWEEN '2017-03-01' AND '2021-10-31'")
def docs_by_filters(spark, sf):
    return C.filtered(_catalog(spark, sf), "1", "2017-2021", "e", ("2017-03-01", "2021-10-31")).select("doc_id", "drafter", "date")


@query(f"SELECT doc_id, date FROM ({_DOCS}) WHERE contains(drafter, '2') ORDER BY date DESC, doc_id LIMIT 15")
def docs_by_drafter(spark, sf):
    return C.by_drafter(_catalog(spark, sf), "2", 15).select("doc_id", "date")


@query(f"SELECT doc_id, sha256(text) AS content_hash, left(text, 500) AS text_preview, CAST(length(text) - length(replace(text, chr(12), '')) + 1 AS INTEGER) AS page_count FROM ({_DOCS})")
def document_rows(spark, sf):
    return _catalog(spark, sf).select("doc_id", "content_hash", "text_preview", "page_count")


@query("SELECT doc_id, CASE WHEN n_chars = 0 THEN 'zero' WHEN n_chars < 100 OR n_chars / (1 + doc_id % 40) < 50 THEN 'low' ELSE 'ok' END AS quality FROM documents")
def poor_extraction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.extraction_quality(F.col("n_chars"), 1 + F.col("doc_id") % 40).alias("quality"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND user_id IN (SELECT user_id FROM events WHERE value > 100)")
def conjunctive_filter(spark, sf):
    return C.passing_all(table(spark, sf, "events"), "user_id", F.col("event_type") == "purchase", F.col("value") > 100).select("event_id", "user_id")


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'")
def intersection_of_results(spark, sf):
    e = table(spark, sf, "events")
    return C.in_all("user_id", *[e.filter(F.col("event_type") == t) for t in ("click", "error", "view")])


@query("WITH " + _bm25_sql("robertson") + " SELECT query_id, b.doc_id, rank, coalesce(quality, -1) AS quality, toxic FROM bm25 b LEFT JOIN (SELECT doc_id, any_value(quality) AS quality, any_value(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def lookup_with_default(spark, sf):
    hits = _bm25(spark, sf).select("query_id", "doc_id", "rank")
    return C.looked_up(hits, table(spark, sf, "labels"), "doc_id", {"quality": -1, "toxic": None})


@query("WITH " + _bm25_sql("robertson") + f", d AS ({_DOCS}) SELECT query_id, b.doc_id, drafter, date FROM bm25 b JOIN d USING (doc_id) WHERE drafter = 'src1' AND starts_with(date, '201')")
def filtered_lookup(spark, sf):
    hits = _bm25(spark, sf).select("query_id", "doc_id")
    return C.looked_up(hits, _catalog(spark, sf), "doc_id", {"drafter": "", "date": ""}, drafter="src1", year="201")


_CODES = "SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4}[0-9]+')) AS code FROM documents"


@query(f"SELECT upper(code) AS norm_code, min(code) AS code, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, left(source, 6) AS code FROM documents) GROUP BY upper(code) ORDER BY documents DESC, norm_code LIMIT 10")
def top_codes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.left("source", F.lit(6)).alias("code"))
    return C.top_codes(d.withColumn("norm_code", F.upper("code")), 10)


@query("SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2030-01-01') / 1e6 - epoch_us(greatest(ts, ts + INTERVAL '1 hour' * (event_id % 3))) / 1e6 > (SELECT epoch_us(TIMESTAMP '2030-01-01') / 1e6 - avg(epoch_us(ts)) / 1e6 FROM events)")
def expired_entries(spark, sf):
    e = table(spark, sf, "events").withColumn("used", F.col("ts") + F.make_interval(hours=(F.col("event_id") % 3).cast("int")))
    limit = e.agg(F.avg(F.unix_micros(F.to_timestamp(F.lit("2030-01-01")).cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)).first()[0]
    return C.expired(e, F.to_timestamp(F.lit("2030-01-01")), limit, "ts", "used").select("event_id")


@query("SELECT count(*) AS entries, CAST(sum(user_id) AS BIGINT) AS uses, round(avg(user_id), 6) AS mean_uses FROM events")
def cache_stats(spark, sf):
    return C.cache_stats(table(spark, sf, "events"), "user_id")


@query("SELECT r_regionkey, CAST(r_name AS VARCHAR) AS r_name, CAST(NULL AS BIGINT) AS pages, CAST(NULL AS VARCHAR) AS note FROM region")
def schema_evolution(spark, sf):
    return C.with_columns_of(table(spark, sf, "region"), "r_regionkey int, r_name string, pages bigint, note string")


@query(f"SELECT filename, date FROM (SELECT date || '_' || doc_id || '.pdf' AS filename, date FROM ({_DOCS})) WHERE date BETWEEN '2016-02-01' AND '2018-09-30'")
def files_between_days(spark, sf):
    files = _catalog(spark, sf).select(F.concat("date", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    return C.dated_between(files, "2016-02-01", "2018-09-30")


@query("SELECT count(*) AS documents, count(*) FILTER (source NOT IN ('src1', '')) AS known, count(DISTINCT source) FILTER (source NOT IN ('src1', '')) AS names, CAST(0 AS BIGINT) AS hangul, CAST(floor(count(*) FILTER (source NOT IN ('src1', '')) * 100 / count(*)) AS BIGINT) AS percent FROM documents")
def drafter_counts(spark, sf):
    return C.drafter_counts(table(spark, sf, "documents"), "src1", "source")


@query("WITH f AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') SELECT (SELECT count(DISTINCT user_id) FROM f) AS failed, (SELECT count(*) FROM f) AS errors, (SELECT list(user_id ORDER BY ts DESC, user_id DESC) FROM (SELECT * FROM f ORDER BY ts DESC, user_id DESC LIMIT 5)) AS recent")
def error_stats(spark, sf):
    return C.error_stats(table(spark, sf, "events").filter("event_type = 'error'"), "user_id", "ts")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT doc_id) FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2}')) AS bm25, (SELECT count(*) FROM embeddings) AS vectors, greatest(0, (SELECT count(*) FROM documents) - greatest((SELECT count(DISTINCT doc_id) FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2}')), (SELECT count(*) FROM embeddings))) AS unindexed")
def index_metrics(spark, sf):
    from .retrieval_queries import _index

    return C.index_metrics(table(spark, sf, "documents"), bm25=_index(spark, sf).texts.filter("dl > 0").select("doc_id").distinct(), vectors=table(spark, sf, "embeddings"))


@query("SELECT lang, round(avg(n_chars), 6) AS mean, CAST(sum(n_chars) AS BIGINT) AS total, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('fr') GROUP BY lang")
def mean_sum_count(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("lang").isNotNull() & ~F.col("lang").isin("fr"))
    return d.groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.sum("n_chars").alias("total"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))


@query(f"SELECT doc_id, left(date, 4) AS year FROM ({_DOCS}) ORDER BY year DESC, drafter, doc_id LIMIT 25")
def by_year_then_name(spark, sf):
    return _catalog(spark, sf).select("doc_id", F.left("date", F.lit(4)).alias("year"), "drafter").orderBy(F.desc("year"), "drafter", "doc_id").limit(25).drop("drafter")


# --- cleaning ---

_PAGED = "SELECT doc_id, '오전 9:30' || chr(10) || 'Report head ' || (doc_id % 3) || chr(10) || replace(coalesce(text, ''), ' ', chr(10)) || chr(10) || chr(10) || ' ' || chr(10) || 'page 1 of 3' || chr(12) || 'Report  HEAD ' || (doc_id % 3) || chr(10) || 'x' || chr(10) || 'x' || chr(10) || 'x' || chr(12) || 'report head ' || (doc_id % 3) || chr(10) || 'the end of it' || chr(10) AS text FROM documents"


def _paged(spark, sf):
    mark, nl = (F.col("doc_id") % 3).cast("string"), F.lit("\n")
    parts = [F.lit("오전 9:30\nReport head "), mark, nl, F.replace(F.coalesce("text", F.lit("")), F.lit(" "), nl), F.lit("\n\n \npage 1 of 3\fReport  HEAD "), mark, F.lit("\nx\nx\nx\freport head "), mark, F.lit("\nthe end of it\n")]
    return table(spark, sf, "documents").select("doc_id", F.concat(*parts).alias("text"))


@query(f"""WITH p AS ({_PAGED}), l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, {_text(L.NOISE['printed_at'])}) AND NOT regexp_matches(x, {_text(L.NOISE['printed_time'])}) AND NOT regexp_matches(x, {_text(L.NOISE['page_number'])})) AS ls, string_split(text, chr(10)) AS every FROM p),
g AS (SELECT doc_id, ls, len(list_filter(every, lambda x: regexp_matches(x, {_text(L.NOISE['printed_time'])}))) AS times, list_transform(string_split(array_to_string(ls, chr(10)), chr(12)), lambda x: string_split(x, chr(10))) AS ps FROM l),
e AS (SELECT doc_id, lower(trim(regexp_replace(k, '\\s+', ' ', 'g'))) AS k FROM (SELECT doc_id, unnest(flatten(list_transform(ps, lambda q: list_concat(list_slice(q, 1, 3), list_slice(q, greatest(len(q) - 2, 1), len(q)))))) AS k FROM g) WHERE length(trim(k)) > 5),
b AS (SELECT doc_id, list(k) AS bad FROM (SELECT doc_id, k FROM e GROUP BY ALL HAVING count(*) >= 3) GROUP BY doc_id),
r AS (SELECT g.doc_id, times, len(ls) AS n, list_filter(ls, lambda x: NOT list_contains(coalesce(bad, []), lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))))) AS ls FROM g LEFT JOIN b USING (doc_id)),
c AS (SELECT doc_id, times, n, ls, list_filter(ls, lambda x, i: NOT (i > 2 AND ls[i - 1] = x AND ls[i - 2] = x)) AS once FROM r),
z AS (SELECT *, list_transform(once, lambda x: CASE WHEN trim(x) = '' THEN '' ELSE x END) AS z FROM c), y AS (SELECT *, list_filter(z, lambda x, i: x <> '' OR i = 1 OR z[i - 1] <> '') AS y FROM z)
SELECT doc_id, md5(regexp_replace(array_to_string(y, chr(10)), '^\\n|\\n$', '', 'g')) AS cleaned, CAST(times AS INTEGER) AS times, CAST(n - len(ls) AS INTEGER) AS repeated, CAST(len(ls) - len(once) AS INTEGER) AS consecutive FROM y""")
def clean_text(spark, sf):
    found = L.cleaned(_paged(spark, sf))
    return found.select("doc_id", F.md5("cleaned").alias("cleaned"), F.element_at("noise", "printed_time").alias("times"), "repeated", "consecutive")


# --- contexts ---

_SENT = "SELECT doc_id, s, pos - 1 AS pos FROM (SELECT doc_id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]\\s+|\\n+'), lambda x: trim(x)), lambda x: length(x) >= 11) AS ss FROM documents))"
_HAS = "len(list_filter({0}, lambda w: contains(s, w)))"


@query(f"""WITH s AS ({_SENT}), l AS (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM s)
SELECT doc_id, pos, CAST(CASE WHEN regexp_matches(s, '\\d') OR {_HAS.format(_list(X.CORE_UNITS))} > 0 THEN 3 ELSE 0 END + {_HAS.format(_list(X.CORE_WORDS))} + CASE WHEN {_HAS.format(_list(X.CORE_MARKS))} > 0 THEN 2 ELSE 0 END + CASE WHEN pos = 0 OR pos = last THEN 1 ELSE 0 END AS DOUBLE) AS score FROM l""")
def core_sentence_scores(spark, sf):
    parts = X.sentences(table(spark, sf, "documents"), "doc_id", least=11)
    last = F.max("pos").over(X.Window.partitionBy("doc_id"))
    return parts.withColumn("_l", last).select("doc_id", "pos", X.core_score(F.col("sentence"), F.col("pos"), F.col("_l")).alias("score"))


@query("""WITH p AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '\\n{2,}'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM (SELECT doc_id, replace(coalesce(text, ''), '. ', chr(10) || chr(10)) AS t FROM documents)),
n AS (SELECT doc_id, t, ps, list_filter(range(1, len(ps) + 1), lambda k: list_sum(list_transform(ps[1:k], lambda x: length(x) + 2)) <= 600) AS ks FROM p) SELECT doc_id, CASE WHEN len(ks) > 0 THEN array_to_string(ps[1:len(ks)], chr(10) || chr(10)) ELSE left(t, 600) END AS cut FROM n""")
def paragraph_cut(spark, sf):
    t = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\n\n"))
    return table(spark, sf, "documents").select("doc_id", X.cut_at_paragraph(t, 600).alias("cut"))


@query("WITH " + _bm25_sql("robertson") + ", h AS (SELECT query_id, doc_id, rank, source, first_value(source) OVER (PARTITION BY query_id ORDER BY rank) AS s1 FROM bm25 JOIN documents USING (doc_id)), r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(source <> s1 AS INTEGER), rank) AS r FROM h) SELECT query_id, doc_id, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 5")
def same_document_first(spark, sf):
    hits = _bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return X.same_document_first(hits, "source", 5)


@query("WITH " + _bm25_sql("robertson") + ", h AS (SELECT query_id, doc_id, rank, regexp_matches(coalesce(text, ''), '[0-9]|die') AS m FROM bm25 JOIN documents USING (doc_id)), r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(NOT m AS INTEGER), rank) AS r FROM h) SELECT query_id, doc_id, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 6")
def priority_chunks_first(spark, sf):
    hits = _bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return X.priority_first(hits, "[0-9]|die", 6)


@query("SELECT doc_id, CASE WHEN n_chars >= 1200 THEN left(text, 1200) ELSE coalesce(left(text, 5000), left(coalesce(text, ''), 100)) END AS context FROM (SELECT doc_id, text, length(coalesce(text, '')) AS n_chars FROM documents)")
def full_text_if_short(spark, sf):
    t = F.coalesce("text", F.lit(""))
    snippet = F.when(F.length(t) >= 1200, F.left(t, F.lit(1200))).otherwise(F.left(t, F.lit(100)))
    return table(spark, sf, "documents").select("doc_id", X.full_text_if_short(snippet, F.col("text")).alias("context"))


@query(f"WITH s AS (SELECT doc_id, pos, length(s) AS n FROM ({_SENT})), a AS (SELECT count(DISTINCT doc_id) AS all_docs, CAST(sum(n) AS BIGINT) AS all_chars, CAST(sum(n) FILTER (pos < 3) AS BIGINT) AS kept_chars, count(*) AS all_sentences, count(*) FILTER (pos < 3) AS kept_sentences, count(DISTINCT doc_id) FILTER (pos < 3) AS kept_docs FROM s) SELECT all_docs, all_chars, kept_chars, all_sentences, kept_sentences, round(kept_chars / all_chars, 6) AS ratio, round(kept_chars / kept_docs, 6) AS mean_chars, round(kept_sentences / all_sentences, 6) AS kept_share FROM a")
def compression_stats(spark, sf):
    parts = X.sentences(table(spark, sf, "documents"), "doc_id", least=11)
    return X.compression_stats(parts, parts.filter("pos < 3"))


@query(f"WITH s AS (SELECT doc_id, len(string_split(s, ' ')) AS n FROM ({_SENT})) SELECT doc_id, count(*) AS chunks, round(avg(n), 1) AS mean, CAST(list_sort(list(n))[len(list(n)) // 2 + 1] AS INTEGER) AS median, CAST(max(n) AS INTEGER) AS largest, count(*) FILTER (n < 6) AS small, round(count(*) FILTER (n < 6) / count(*) * 100, 2) AS small_rate FROM s GROUP BY doc_id")
def chunk_stats(spark, sf):
    parts = X.sentences(table(spark, sf, "documents"), "doc_id", least=11)
    return X.chunk_stats(parts, "doc_id", F.size(F.split("sentence", " ")), 6)


# --- evaluation ---

_RESULTS = "SELECT event_id, event_type AS expected_mode, CASE event_id % 7 WHEN 0 THEN 'view' ELSE event_type END AS actual_mode, event_id % 2 = 0 AS expected_citations, event_id % 2 = 0 OR event_id % 11 = 0 AS has_citations, CASE WHEN event_id % 13 = 0 THEN 'failed' END AS error, value AS latency, value / 2 AS top_score FROM events"


@query(f"WITH j AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN actual_mode = expected_mode AND has_citations = expected_citations THEN 'PASS' ELSE 'FAIL' END AS status FROM ({_RESULTS})) SELECT expected_mode, count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'ERROR') AS errors, round(coalesce(avg(latency) FILTER (status <> 'ERROR'), 0), 6) AS mean_latency, round(coalesce(avg(top_score) FILTER (status <> 'ERROR'), 0), 6) AS mean_score FROM j GROUP BY CUBE (expected_mode)")
def verdict_report(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    results = e.select(
        "event_id", F.col("event_type").alias("expected_mode"), F.when(i % 7 == 0, "view").otherwise(F.col("event_type")).alias("actual_mode"), (i % 2 == 0).alias("expected_citations"),
        ((i % 2 == 0) | (i % 11 == 0)).alias("has_citations"), F.when(i % 13 == 0, "failed").alias("error"), F.col("value").alias("latency"), (F.col("value") / 2).alias("top_score"),
    )
    return E.verdict_report(E.verdicts(results), "expected_mode")


@query("WITH " + _bm25_sql("robertson") + " SELECT query_id, count(*) >= 8 AS meets, least(1.0, count(*) / 8) AS ratio FROM bm25 GROUP BY query_id")
def parsing_coverage(spark, sf):
    return E.coverage_check(_bm25(spark, sf).groupBy("query_id").agg(F.count("*").alias("chunks_used")), 8)


@query("WITH " + _bm25_sql("robertson") + ", x AS (SELECT item_id AS query_id, unnest([item_id, item_id + 3, item_id * 2]) AS doc_id FROM benchmark), m AS (SELECT query_id, min(rank) AS f FROM bm25 JOIN (SELECT DISTINCT * FROM x) USING (query_id, doc_id) GROUP BY ALL) SELECT query_id, f IS NOT NULL AS hit, round(coalesce(1.0 / f, 0), 9) AS rr FROM (SELECT DISTINCT query_id FROM x) LEFT JOIN m USING (query_id)")
def benchmark_queries(spark, sf):
    i = F.col("query_id")
    expected = _queries(spark, sf).select("query_id", F.explode(F.array(i, i + 3, i * 2)).alias("doc_id"))
    return E.benchmark(_bm25(spark, sf), expected)


@query("WITH " + _bm25_sql("robertson") + ", h AS (SELECT query_id, source, rank, score FROM bm25 JOIN documents USING (doc_id)), c AS (SELECT query_id, count(*) FILTER (source = 'src1' AND rank <= 3) AS hits_at_k, coalesce(1.0 / min(rank) FILTER (source = 'src1'), 0) AS rr, max(score) AS latency FROM h GROUP BY query_id) SELECT count(*) AS total, count(*) FILTER (hits_at_k >= 1) AS passed, round(avg(CASE WHEN hits_at_k >= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(rr), 6) AS mrr, CAST(quantile_disc(latency, 0.95) AS DOUBLE) AS p95 FROM c")
def validation_suite(spark, sf):
    hits = _bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("query_id", F.col("source").alias("value"), "rank", "score")
    cases = hits.groupBy("query_id").agg(F.max("score").alias("latency")).withColumns({"expected": F.lit("src1"), "min_hits": F.lit(1)})
    judged = E.case_results(hits, cases.drop("latency")).join(cases.select("query_id", "latency"), "query_id").withColumn("min_hits", F.lit(1))
    return E.suite_summary(judged)


@query("WITH e AS (SELECT event_type, count(*) AS n, sum(value) AS t, max(value) AS hi, min(value) AS lo, count(*) FILTER (value > 90) AS e FROM events GROUP BY event_type) SELECT count(*) AS functions, CAST(sum(n) AS BIGINT) AS calls, round(sum(t), 4) AS total, CAST(sum(e) AS BIGINT) AS errors, first(event_type ORDER BY hi DESC, event_type) AS slowest, first(event_type ORDER BY lo, event_type) AS fastest, first(event_type ORDER BY n DESC, event_type) AS most_called FROM e")
def call_summary(spark, sf):
    return E.call_summary(table(spark, sf, "events"), "event_type", "value", F.col("value") > 90)


@query("SELECT event_type || ' ' || count(*) AS line FROM events GROUP BY event_type")
def metric_lines(spark, sf):
    return E.exposition(table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value")))


# --- functions that stood without a query ---


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_가-힣]+'), lambda x: true)) AS n, md5(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_가-힣]+'), ' ')) AS words FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^\\x{00}-\\x{7F}]')")
def light_tokens(spark, sf):
    d = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit(""))).filter(~F.col("text").rlike(r"[^\x00-\x7F]")).withColumn("t", T.light_tokens(F.col("text")))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("words"))


@query("SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}\\-/_.]+', ' ', 'g'), ' '), lambda x: x <> ''), ' ')) AS words FROM documents WHERE lang = 'en'")
def index_tokens(spark, sf):
    d = table(spark, sf, "documents").filter("lang = 'en'")
    return d.select("doc_id", F.md5(F.array_join(T.index_tokens(F.coalesce("text", F.lit(""))), " ")).alias("words"))


@query(f"{_Q}, f AS (SELECT query_id, query || '.PDF' AS f FROM fx_asked) SELECT query_id, regexp_replace(regexp_replace(upper(replace(regexp_replace(f, '\\.[A-Za-z0-9]+$', ''), 'ß', 'ss')), '\\s+', '_', 'g'), '[^A-Z0-9_-]', '', 'g') || lower(regexp_extract(f, '(\\.[A-Za-z0-9]+)$', 1)) AS name FROM f")
def display_filename(spark, sf):
    return _asked(spark, sf).select("query_id", T.display_filename(F.concat("query", F.lit(".PDF"))).alias("name"))


@query(f"{_Q} SELECT query_id, trim(regexp_replace(translate(query, '‐‑‒–—−', '------'), '\\s+', ' ', 'g')) AS text FROM fx_asked")
def normalize_text(spark, sf):
    return _asked(spark, sf).select("query_id", T.normalize_text(F.col("query")).alias("text"))


@query(f"""{_Q} SELECT query_id, coalesce(nullif(concat_ws('|', CASE WHEN regexp_matches(query, {_text('(?i)' + Q.COST)}) THEN 'cost_intent' END, CASE WHEN regexp_matches(query, {_text('(?i)' + Q.LIST)}) THEN 'list_intent' END, CASE WHEN regexp_matches(query, {_text('(?i)' + Q.CONTENT)}) THEN 'content_intent' END,
 CASE WHEN regexp_matches(query, {_text(Q.REFERENCE)}) THEN 'doc_reference' END, CASE WHEN regexp_matches(query, {_text(Q.FILE)}) THEN 'filename_detected' END), ''), 'default_qa') AS reason, regexp_matches(query, '^[\\d\\s+\\-*/().=?]+$') OR regexp_matches(lower(query), '^(안녕|하이|hello|hi|thanks|고마워)') OR length(trim(query)) <= 2 AS chat FROM fx_asked""")
def routing_reason(spark, sf):
    return _asked(spark, sf).select("query_id", Q.routing_reason(F.col("query")).alias("reason"), Q.is_chat(F.col("query")).alias("chat"))


@query("WITH a AS (SELECT doc_id, 'see ' || source || CASE WHEN doc_id % 2 = 0 THEN ' and extra.pdf' ELSE '' END AS answer, [source, 'extra.pdf'] AS sources FROM documents), m AS (SELECT *, list_filter(sources, lambda s: NOT contains(answer, s)) AS missing FROM a) SELECT doc_id, CASE WHEN len(missing) > 0 THEN answer || chr(10) || array_to_string(list_transform(missing, lambda s: '- ' || s), chr(10)) ELSE answer END AS answer FROM m")
def ensured_citations(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("see "), F.col("source"), F.when(F.col("doc_id") % 2 == 0, " and extra.pdf").otherwise("")).alias("a"), F.array("source", F.lit("extra.pdf")).alias("s"))
    return d.select("doc_id", A.with_citations(F.col("a"), F.col("s")).alias("answer"))


@query("SELECT doc_id, md5(left(t, 2097152) || right(t, 2097152) || octet_length(encode(t)) || '|' || '2024-01-01') AS fingerprint FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^\\x{00}-\\x{7F}]'))")
def fast_fingerprint(spark, sf):
    d = table(spark, sf, "documents").withColumn("t", F.coalesce("text", F.lit(""))).filter(~F.col("t").rlike(r"[^\x00-\x7F]"))
    content = F.encode("t", "UTF-8")
    return d.select("doc_id", S.fast_fingerprint(content, F.octet_length("t"), F.lit("2024-01-01")).alias("fingerprint"))


_PRINTED = """printed AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') || chr(10) || 'see mode=getPrint here' || chr(10) || ' 1/2 ' || chr(10) || 'end  ' || chr(10) || chr(10) || chr(10) || 'x?idx=12&y' WHEN 1 THEN '1/3' || chr(10) || coalesce(text, '')
  WHEN 2 THEN 'one' || chr(10) || repeat('menu_depth=3 ', 20) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || 'two ' ELSE coalesce(text, '') END AS text FROM documents)"""


def _printed_clean() -> str:
    out = "regexp_replace(text, '(?m)^[ \\t\\n\\x0B\\f\\r]*[0-9]+/[0-9]+[ \\t\\n\\x0B\\f\\r]*$\\n', '', 'g')"
    for p in L.PRINT_REMAINS:
        out = f"regexp_replace({out}, '[^\\n]*{p}[^\\n]*\\n?', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '\\n{{4,}}', '', 'g'), '(?m)[ \\t]+$', '', 'g')"
    return f"regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


@query(f"WITH {_PRINTED}, c AS (SELECT doc_id, text, {_printed_clean()} AS c FROM printed) SELECT doc_id, md5(CASE WHEN length(c) < 50 AND length(text) > 100 THEN text ELSE c END) AS text FROM c")
def extracted_text_clean(spark, sf):
    text = F.coalesce("text", F.lit(""))
    forms = [F.concat(text, F.lit("\nsee mode=getPrint here\n 1/2 \nend  \n\n\nx?idx=12&y")), F.concat(F.lit("1/3\n"), text), F.lit("one\n" + "menu_depth=3 " * 20 + "\n\n\n\n\ntwo "), text]
    printed = table(spark, sf, "documents").select("doc_id", F.array(*forms)[(F.col("doc_id") % 4).cast("int")].alias("text"))
    out = printed.withColumn("c", L.without_print_remains(F.col("text")))
    return out.select("doc_id", F.md5("c").alias("text"))
