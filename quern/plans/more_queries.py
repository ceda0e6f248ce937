"""Queries of result lists: pinning, single documents, priorities, lookups, masks and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import queries as Q
from ..functions import text as T
from ..operators import catalog as C
from ..operators import context as X
from ..operators import fusion as U
from ..sources.tables import table
from .registry import Fixture, query
from .retrieval_queries import FX_FILES, _bm25, _bm25_sql


@query("WITH " + _bm25_sql("robertson") + """, h AS (SELECT query_id, doc_id, score, rank, source, first_value(source) OVER w AS s1, first_value(score) OVER w AS t1 FROM bm25 JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
f AS (SELECT *, source = s1 AND score >= greatest(0.1, 0.7 * t1) AS same FROM h), n AS (SELECT *, sum(CAST(same AS INTEGER)) OVER (PARTITION BY query_id) AS n FROM f),
k AS (SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM n WHERE n < 2 OR same) SELECT query_id, doc_id, source, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def single_document_mode(spark, sf):
    hits = _bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return U.single_document(hits).select("query_id", "doc_id", "source", "score", "rank")


@query("WITH " + _bm25_sql("robertson") + """, last AS (SELECT query_id, max_by(doc_id, rank) AS pinned FROM bm25 GROUP BY query_id), s AS (SELECT query_id, doc_id, CASE WHEN doc_id = pinned THEN 99.9 ELSE score END AS score FROM bm25 JOIN last USING (query_id))
SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s""")
def pinned_document(spark, sf):
    hits = _bm25(spark, sf)
    last = hits.groupBy("query_id").agg(F.max_by("doc_id", "rank").alias("pinned"))
    return U.pin(hits.join(last, "query_id"), F.col("pinned")).select("query_id", "doc_id", "score", "rank")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 0 WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 2 END AS source_rank FROM documents")
def priority_union(spark, sf):
    labels = table(spark, sf, "labels")
    sources = [labels.filter("quality = 1").select("doc_id").distinct(), labels.select("doc_id").distinct(), table(spark, sf, "documents").select("doc_id").distinct()]
    return C.priority_union("doc_id", *sources).select("doc_id", "source_rank")


FX_HITS = Fixture("fx_hits", "filename string, date string, drafter string, category string, content string, score double", [
    (f"{stem}{tail}{suffix}", (f"2024-0{k % 9 + 1}-02", None)[k % 5 == 0], ("kim", "", None)[k % 3], ("구매", None, " x ")[k % 4 % 3], ("text  one", None, "  ", "two\nlines " * 30)[k % 4], round(k * 37 % 101 / 100, 2))
    for k, (stem, tail, suffix) in enumerate((s, t, x) for s in ("a_b", "a b", "a-b", "report 2024", "c") for t in ("", " (1)", "_2", "(12)") for x in (".pdf", ".PDF", ".txt"))
], also=("documents", "concat(source, ' ', doc_id % 50, '.PDF')", "concat('2024-0', 1 + doc_id % 9)", "source", "lang", "text", "n_chars % 97"))
_KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(filename, '\\.[A-Za-z0-9]+$', ''), '[\\s\\-]+', '_', 'g'), '_*\\(\\d+\\)$', ''), '_\\d$', ''), '_+', '_', 'g') || lower(regexp_extract(filename, '(\\.[A-Za-z0-9]+)$', 1))"


@query(f"""WITH {FX_HITS.sql()}, k AS (SELECT *, {_KEY} AS key, trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')) AS t, concat_ws(' | ', nullif(trim(category), ''), nullif(trim(drafter), ''), nullif(trim(date), '')) AS about FROM fx_hits),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, filename) AS n FROM k) SELECT filename, score, CASE WHEN t = '' THEN about ELSE left(t, 200) END AS snippet FROM r WHERE n = 1""")
def result_list(spark, sf):
    return C.result_list(FX_HITS.df(spark, sf)).select("filename", "score", "snippet")


@query("WITH " + _bm25_sql("robertson") + """, m AS (SELECT query_id, doc_id, rank, regexp_matches(source, '^src1') AS m FROM bm25 JOIN documents USING (doc_id)) SELECT query_id, doc_id FROM (SELECT *, bool_or(m) OVER (PARTITION BY query_id) AS any_ FROM m) WHERE CASE WHEN any_ THEN m ELSE rank <= 6 END""")
def allowed_or_first(spark, sf):
    hits = _bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return C.allowed_or_first(hits, "^src1", 2, "source").select("query_id", "doc_id")


@query(f"WITH {FX_FILES.sql()} SELECT count(*) FILTER (e = 'pdf') AS pdf, count(*) FILTER (e = 'txt') AS txt, count(*) FILTER (e NOT IN ('pdf', 'txt')) AS other FROM (SELECT lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM fx_files)")
def extension_counts(spark, sf):
    return C.extension_counts(FX_FILES.df(spark, sf))


@query(f"WITH {FX_FILES.sql()} SELECT doc_id, filename FROM fx_files WHERE contains(filename, 'report') ORDER BY CASE WHEN filename = 'report' THEN 1 WHEN starts_with(filename, 'report') THEN 2 ELSE 3 END, doc_id LIMIT 1")
def title_lookup(spark, sf):
    return C.title_lookup(FX_FILES.df(spark, sf), "report", "filename").select("doc_id", "filename")


@query("SELECT doc_id, len(regexp_extract_all(m, '\\[email\\]')) AS emails, sha256(m) AS masked FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '\\d{6}-[1-4]\\d{6}', '[id]', 'g'), '\\b0\\d{1,2}-\\d{3,4}-\\d{4}\\b', '[phone]', 'g') AS m FROM documents)")
def mask_sensitive(spark, sf):
    m = T.mask_sensitive(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.regexp_count(m, F.lit(r"\[email\]")).cast("bigint").alias("emails"), F.sha2(F.encode(m, "UTF-8"), 256).alias("masked"))


FX_LINES = Fixture("fx_lines", "id int, text string", [(1, "한글\n漢字 행\nabc"), (2, "カナ"), (3, ""), (4, "가격 1l5,O00원")], also=("documents", "1000000 + doc_id", "text"))


@query(f"WITH {FX_LINES.sql()} SELECT id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '[\\x{{3001}}-\\x{{303f}}\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]')), chr(10)) AS text FROM fx_lines")
def drop_foreign_lines(spark, sf):
    return FX_LINES.df(spark, sf).select("id", T.drop_foreign_lines(F.col("text")).alias("text"))


FX_SCANS = Fixture("fx_scans", "id int, text string", list(enumerate(f.format(n) for f in ("합계 l{0},300,000 원", "HP O8 {0} , 0 0 0", "XRN{0}B2 워크스테이숀", "중 계 차  보 수", "I{0},000,000 and 3 3 6", "none {0}") for n in (10, 79, 42, 5))), also=("documents", "1000000 + doc_id", "text"))


def _repaired(column: str) -> str:
    for p, standing in T.OCR_ERRORS:
        column = f"regexp_replace({column}, '{p}', '{standing.replace('$', chr(92))}', 'g')"
    return f"trim(regexp_replace(regexp_replace({column}, '([가-힣])\\s+([가-힣])\\s+([가-힣])', '\\1\\2\\3', 'g'), '\\s+', ' ', 'g'))"


@query(f"WITH {FX_SCANS.sql()} SELECT id, {_repaired('text')} AS text FROM fx_scans")
def repair_ocr(spark, sf):
    return FX_SCANS.df(spark, sf).select("id", T.repair_ocr(F.col("text")).alias("text"))


@query("""WITH m AS (SELECT doc_id, left('{"lang":"' || lang || '","price":"***","text":"' || CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END || '"}', 200) AS j FROM (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g') AS t FROM documents) WHERE lang IS NOT NULL) SELECT doc_id, j AS masked FROM m""")
def masked_fields(spark, sf):
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", "")
    fields = F.create_map(F.lit("lang"), F.col("lang"), F.lit("price"), F.col("n_chars").cast("string"), F.lit("text"), t)
    return table(spark, sf, "documents").filter("lang is not null").select("doc_id", T.masked_fields(fields).alias("masked"))


DOMAIN = ["the", "license", "camera"]


@query("WITH " + _bm25_sql("robertson") + """, t AS (SELECT query_id, list(text) AS texts FROM bm25 JOIN documents USING (doc_id) GROUP BY query_id) SELECT query_id, CAST(len(list_filter(['the', 'license', 'camera'], lambda w: contains(b.text, w) AND len(list_filter(t.texts, lambda x: contains(x, w))) > 0)) AS INTEGER) AS coverage FROM t JOIN benchmark b ON b.item_id = query_id""")
def keyword_coverage(spark, sf):
    texts = _bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").groupBy("query_id").agg(F.collect_list("text").alias("texts"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return texts.join(asked, "query_id").select("query_id", X.keyword_coverage(F.col("query"), F.col("texts"), DOMAIN).alias("coverage"))


# --- questions: those of the benchmark with words that tell what they ask for ---

_ENDS = ["", " 오늘 어제", " 이번달 요약", " 이번 달 목록", " 왜?", " 금액", " 어떻게 어디", "다"]
_WISHES = "wishes AS (SELECT item_id AS query_id, left(coalesce(text, ''), item_id % 40) || [" + ", ".join(f"'{x}'" for x in _ENDS) + "][item_id % 8 + 1] AS query FROM benchmark)"


def _wishes(spark, sf):
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("item_id") % 8 + 1).cast("int"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.left(F.coalesce("text", F.lit("")), (F.col("item_id") % 40).cast("int")), end).alias("query"))


@query(f"WITH {_WISHES} SELECT query_id, replace(replace(replace(replace(query, '오늘', '2024년 03월 01일'), '어제', '2024년 02월 29일'), '이번달', '2024년 03월'), '이번 달', '2024년 03월') AS query FROM wishes")
def dated_queries(spark, sf):
    return _wishes(spark, sf).withColumn("query", Q.dated(F.col("query"), F.to_date(F.lit("2024-03-01"))))


def _met(words) -> str:
    return "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(lower(query), w))) > 0"


@query(f"WITH {_WISHES} SELECT query_id, CASE WHEN {_met(Q.QUICK_WORDS)} THEN false WHEN {_met(Q.ANALYSIS_WORDS)} THEN true ELSE length(query) > 25 END AS analysis, CASE WHEN {_met(Q.HARD_WORDS)} THEN 'complex' WHEN {_met(Q.PLAIN_WORDS)} THEN 'simple' ELSE 'complex' END AS kind FROM wishes")
def analysis_needs(spark, sf):
    return _wishes(spark, sf).select("query_id", Q.needs_analysis(F.col("query")).alias("analysis"), Q.plain_or_hard(F.col("query")).alias("kind"))


# --- pages of the document table, the latest documents, previews ---

_SHELF = "shelf AS (SELECT doc_id, CASE WHEN doc_id % 13 > 0 THEN source || '_' || doc_id || '.pdf' END AS filename, '/x/' || doc_id AS path, left(text, CAST(n_chars % 400 AS BIGINT)) AS text_preview, '2024-0' || (1 + doc_id % 9) AS date, CASE doc_id % 3 WHEN 0 THEN '[\"' || lang || '\", \"x\"]' WHEN 1 THEN 'no list' END AS keywords FROM documents)"


def _shelf(spark, sf):
    d = F.col("doc_id")
    words = F.when(d % 3 == 0, F.concat(F.lit('["'), "lang", F.lit('", "x"]'))).when(d % 3 == 1, F.lit("no list"))
    return table(spark, sf, "documents").select("doc_id", F.when(d % 13 > 0, F.concat("source", F.lit("_"), d.cast("string"), F.lit(".pdf"))).alias("filename"), F.concat(F.lit("/x/"), d.cast("string")).alias("path"), F.left("text", (F.col("n_chars") % 400).cast("int")).alias("text_preview"), F.concat(F.lit("2024-0"), (1 + d % 9).cast("string")).alias("date"), words.alias("keywords"))


@query(f"WITH {_SHELF} SELECT 'doc_' || doc_id AS id, coalesce(filename, '') AS filename, path, CAST(length(text_preview) AS INTEGER) AS text_length FROM shelf WHERE length(text_preview) >= 100 ORDER BY doc_id LIMIT 50 OFFSET 20")
def list_documents(spark, sf):
    return C.listed(_shelf(spark, sf), 20, 50)


@query(f"WITH {_SHELF} SELECT doc_id, filename, date, array_to_string(CASE WHEN doc_id % 3 = 0 THEN json_extract_string(keywords, '$[*]') ELSE [] END, '/') AS keywords FROM shelf WHERE filename IS NOT NULL ORDER BY date DESC, doc_id LIMIT 100")
def document_summaries(spark, sf):
    return C.summaries(_shelf(spark, sf)).select("doc_id", "filename", "date", F.array_join("keywords", "/").alias("keywords"))


@query(f"""WITH {_SHELF}, changes AS (SELECT '/x/' || (doc_id - doc_id % 3) AS path, text AS text_preview, doc_id AS turn FROM documents WHERE doc_id % 2 = 0), last AS (SELECT path, arg_max(left(text_preview, 1000), turn) AS preview FROM changes GROUP BY path)
SELECT doc_id, md5(coalesce(CASE WHEN l.path IS NOT NULL THEN preview ELSE text_preview END, '-')) AS text_preview, CASE WHEN l.path IS NOT NULL THEN 'now' ELSE 'before' END AS updated_at FROM shelf LEFT JOIN last l USING (path)""")
def updated_previews(spark, sf):
    changes = table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.concat(F.lit("/x/"), (F.col("doc_id") - F.col("doc_id") % 3).cast("string")).alias("path"), F.col("text").alias("text_preview"), F.col("doc_id").alias("turn"))
    out = C.with_previews(_shelf(spark, sf).withColumn("updated_at", F.lit("before")), changes, F.lit("now"))
    return out.select("doc_id", F.md5(F.coalesce("text_preview", F.lit("-"))).alias("text_preview"), "updated_at")
