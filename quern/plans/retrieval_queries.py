"""Queries of ranked retrieval and fusion over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as U
from ..operators import retrieval as R
from ..sources.tables import table
from .registry import Fixture, query

WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1)"
_INDEX = f"""
words AS (SELECT doc_id, unnest({WORDS.format("coalesce(text, '')")}) AS term FROM documents),
postings AS (SELECT term, doc_id, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf) AS dl FROM postings GROUP BY doc_id),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
totals AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM lengths) / (SELECT count(*) FROM documents) AS mean),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({WORDS.format("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL)
"""


def _bm25_sql(idf: str) -> str:
    weight = {"robertson": "ln((n - df + 0.5) / (df + 0.5))", "lucene": "ln(1 + (n - df + 0.5) / (df + 0.5))"}[idf]
    return f"""{_INDEX},
scored AS (
  SELECT query_id, doc_id, sum(qtf * {weight} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
  FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL
), bm25 AS (
  SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
    FROM scored WHERE round(score, 6) > 0) WHERE rank <= 10
)"""


def _index(spark, sf):
    return R.stored_index(table(spark, sf, "documents"), f"{sf}/documents.parquet")


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, sf, idf="robertson"):
    return R.bm25(_index(spark, sf), _queries(spark, sf), idf=idf)


@query("WITH " + _bm25_sql("robertson") + " SELECT * FROM bm25")
def bm25_robertson_topk(spark, sf):
    return _bm25(spark, sf)


@query("WITH " + _bm25_sql("lucene") + " SELECT * FROM bm25")
def bm25_lucene_topk(spark, sf):
    return _bm25(spark, sf, "lucene")


@query(f"""WITH {_INDEX}, met AS (SELECT query_id, doc_id, count(*) AS terms_met, CAST(sum(tf) AS BIGINT) AS tf_sum FROM asked JOIN postings USING (term) GROUP BY ALL)
SELECT query_id, doc_id, terms_met, tf_sum, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY terms_met DESC, tf_sum DESC, doc_id) AS rank FROM met) WHERE rank <= 10""")
def fts_or_match(spark, sf):
    return R.or_match(_index(spark, sf), _queries(spark, sf))


@query(f"""WITH {_INDEX} SELECT term, df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(tf) AS BIGINT) AS max_tf, round(avg(dl), 6) AS mean_dl FROM postings JOIN terms USING (term) JOIN lengths USING (doc_id) GROUP BY term, df""")
def index_term_stats(spark, sf):
    found = _index(spark, sf).postings.groupBy("term")
    return found.agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.round(F.avg("dl"), 6).alias("mean_dl"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _vector_queries(spark, sf):
    """The stated query set of searches: ids divisible by 20, against all rows."""
    return _vectors(spark, sf).filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"))


_VECTORS = "SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {0} AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0"
_D = "CAST({0}.embedding AS DOUBLE[])"
_COSINE = f"list_sum(list_transform(list_zip({_D.format('q')}, {_D.format('d')}), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform({_D.format('q')}, lambda x: x * x))) * sqrt(list_sum(list_transform({_D.format('d')}, lambda x: x * x))))"
_L2 = f"list_sum(list_transform(list_zip({_D.format('q')}, {_D.format('d')}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_TOP = "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) {1}, doc_id) AS rank FROM ({0})) WHERE rank <= 10"


@query(_TOP.format(_VECTORS.format(_COSINE), "DESC"))
def vector_cosine_topk(spark, sf):
    return R.vector_topk(_vectors(spark, sf), _vector_queries(spark, sf))


@query(_TOP.format(_VECTORS.format(_L2), "ASC"))
def vector_l2_topk(spark, sf):
    return R.vector_topk(_vectors(spark, sf), _vector_queries(spark, sf), metric="l2")


_BOTH = "WITH " + _bm25_sql("robertson") + ", lucene AS (" + _TOP.format(f"SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.6 / (tf + 1.6 * (0.25 + 0.75 * dl / mean))) AS score FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL", "DESC") + ")"
_RANK9 = " SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, round(score, 9) AS score FROM ({0}))"


def _two_lists(spark, sf):
    return R.bm25_lists(_index(spark, sf), _queries(spark, sf), [{"k1": 1.6, "idf": "lucene"}, {}])


@query(_BOTH + _RANK9.format("SELECT query_id, doc_id, coalesce(0.1 / (20 + v.rank), 0) + coalesce(0.9 / (20 + b.rank), 0) AS score FROM lucene v FULL JOIN bm25 b USING (query_id, doc_id)"))
def rrf_weighted(spark, sf):
    return U.rrf_weighted(*_two_lists(spark, sf))


@query(_BOTH + _RANK9.format("SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM lucene UNION ALL SELECT query_id, doc_id, rank FROM bm25) GROUP BY ALL"))
def rrf_plain(spark, sf):
    return U.rrf_plain(*_two_lists(spark, sf))


@query(_BOTH + _RANK9.format("SELECT query_id, doc_id, 0.1 * coalesce(v.s, 0) + 0.9 * coalesce(b.s, 0) AS score FROM (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS s FROM lucene) v FULL JOIN (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS s FROM bm25) b USING (query_id, doc_id)"))
def weighted_sum_fusion(spark, sf):
    return U.weighted_sum(*_two_lists(spark, sf))


@query("WITH " + _bm25_sql("robertson") + " SELECT query_id, doc_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm FROM bm25 WINDOW w AS (PARTITION BY query_id)")
def minmax_normalize(spark, sf):
    return U.minmax(_bm25(spark, sf)).select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


@query("WITH " + _bm25_sql("robertson") + """ SELECT *, round(top1 - top2, 6) AS delta12, round(top1 - top3, 6) AS delta13 FROM (SELECT query_id, count(*) AS hits,
coalesce(max(score) FILTER (rank = 1), 0) AS top1, coalesce(max(score) FILTER (rank = 2), 0) AS top2, coalesce(max(score) FILTER (rank = 3), 0) AS top3 FROM bm25 GROUP BY query_id)""")
def score_stats(spark, sf):
    return R.score_stats(_bm25(spark, sf))


_KW = """, pairs AS (SELECT b.query_id, b.doc_id, b.rank AS before, regexp_extract_all(lower(q.text), '[가-힣a-z0-9]+') AS qw, regexp_extract_all(lower(d.text), '[가-힣a-z0-9]+') AS dw
  FROM bm25 b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d USING (doc_id)),
reranked AS (SELECT query_id, doc_id, before, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (
  SELECT query_id, doc_id, before, round(least(1.0, 0.7 * len(list_intersect(qw, dw)) / len(list_distinct(list_concat(qw, dw))) + 0.3 * list_sum(list_transform(qw, lambda w: len(list_filter(dw, lambda x: x = w)))) / len(dw)), 6) AS score FROM pairs))"""


def _reranked(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    q = _queries(spark, sf).withColumnRenamed("text", "query")
    first = _bm25(spark, sf)
    both = first.select("query_id", "doc_id").join(docs, "doc_id").join(q, "query_id")
    return first, R.ranked(R.keyword_scores(both), "score")


@query("WITH " + _bm25_sql("robertson") + _KW + " SELECT query_id, doc_id, score, rank FROM reranked")
def keyword_rerank(spark, sf):
    return _reranked(spark, sf)[1]


@query("WITH " + _bm25_sql("robertson") + _KW + """ SELECT query_id, count(*) FILTER (rank < before) AS improved, count(*) FILTER (rank > before) AS degraded, count(*) FILTER (rank = before) AS unchanged,
round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, min(score) AS min_score, max(score) AS max_score FROM reranked GROUP BY query_id""")
def rerank_analysis(spark, sf):
    return U.rank_changes(*_reranked(spark, sf))


FX_RANKED = Fixture("fx_ranked", "query_id int, doc_id int, score double, filename string, content string, year string", [
    (1, 1, 0.9, "2024-03-01_lens.pdf", "렌즈 2,370,000원 구매", "2024"), (1, 2, 0.8, "2023-01-01_camera.pdf", "카메라 2370000 ECM-77BC", "2024"),
    (1, 3, 0.7, "mic.pdf", "마이크 홍길동", "2024"), (2, 1, 0.5, "2024-03-01_lens.pdf", "렌즈", None), (2, 4, 0.5, "x.pdf", "", None), (3, 5, 0.0, "zero.pdf", "0", "2020"),
], also=("documents", "1000000 + doc_id % 50", "doc_id", "(1 + n_chars % 97) / CAST(97 AS DOUBLE)", "concat(source, '.pdf')", "text", "concat('', 2015 + doc_id % 10)"))


@query(f"WITH {FX_RANKED.sql()} SELECT query_id, doc_id, round(CASE WHEN year IS NOT NULL AND contains(filename, year) THEN score * 1.5 ELSE score END, 6) AS score FROM fx_ranked")
def year_boost(spark, sf):
    return FX_RANKED.df(spark, sf).select("query_id", "doc_id", F.round(U.year_boost(F.col("score"), F.col("year"), F.col("filename"), F.lit("")), 6).alias("score"))


@query(f"""WITH {FX_RANKED.sql()} SELECT query_id, doc_id, round(score * (CASE WHEN contains(content, '2,370,000원') THEN 2.0 WHEN contains(replace(content, ',', ''), '2370000') THEN 1.8 ELSE 1.0 END)
 * (CASE WHEN contains(content, 'ECM-77BC') THEN 1.7 ELSE 1.0 END) * (CASE WHEN contains(content, '홍길동') THEN 1.5 ELSE 1.0 END), 6) AS score FROM fx_ranked""")
def keyword_boost(spark, sf):
    lists = [F.array(F.lit(x)) for x in ("2,370,000원", "ECM-77BC", "홍길동")]
    return FX_RANKED.df(spark, sf).select("query_id", "doc_id", F.round(F.col("score") * U.keyword_boost(*lists, F.col("content"), F.col("filename")), 6).alias("score"))


FX_PHASES = Fixture("fx_phases", "query_id int, doc_id int, vector_score double, bm25_score double, keyword_score double, rerank_score double, k int", [
    (q, d, round(0.15 + (d * 37 % 80) / 100, 4), round((d * 53 % 100) / 100, 4), round((d * 17 % 10) / 10, 4), round((d * 29 % 97) / 97, 6), 3 if q == 1 else 7) for q, n in ((1, 60), (2, 8)) for d in range(n)
], also=("documents", "1000000 + doc_id % 40", "doc_id", "(n_chars % 101) / CAST(101 AS DOUBLE)", "(n_chars % 89) / CAST(89 AS DOUBLE)", "(n_chars % 83) / CAST(83 AS DOUBLE)", "(n_chars % 79) / CAST(79 AS DOUBLE)", "5"))


@query(f"""WITH {FX_PHASES.sql()},
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, doc_id) AS r FROM fx_phases) WHERE r <= 50 AND vector_score >= 0.2),
two AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r2 FROM (SELECT *, round(0.5 * vector_score + 0.3 * bm25_score + 0.2 * keyword_score, 9) AS s FROM one)) WHERE r2 <= 20),
three AS (SELECT query_id, doc_id, k, CASE WHEN n > 10 THEN rerank_score ELSE s END AS score FROM two),
four AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM three)
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM four WHERE rank <= least(10, k)""")
def multilevel_filter(spark, sf):
    return U.multilevel(FX_PHASES.df(spark, sf), F.col("k"))


FX_FILES = Fixture("fx_files", "doc_id int, filename string, drafter string, date string, amount bigint, created_at string, content_hash string", [
    (1, "2024-03-01_렌즈_구매.pdf", "kim", "2024-03-01", 2370000, "2024-03-02", "a"), (2, "2024-03-01_렌즈_구매 (1).pdf", "kim", "2024-03-01", 2370000, "2024-03-03", "a"),
    (3, "2023-11-05_XRN-1620B2_교체.PDF", "lee", "2023-11-05", 0, "2023-11-06", "b"), (4, "LVM 180A manual.pdf", "", None, None, "2022-01-01", "c"),
    (5, "report_1.pdf", None, "2023", 150000000, "2023-05-05", "d"), (6, "report.pdf", "park", "2023-05-01", 999, "2023-05-04", "d"),
], also=("documents", "1000000 + doc_id", "concat(source, '-', doc_id, '_', lang, '.pdf')", "source", "concat('2024-01-0', 1 + doc_id % 9)", "n_chars * 1000", "concat('2024-02-0', 1 + doc_id % 9)", "md5(text)"))
FX_QUERIES = Fixture("fx_queries", "query_id int, query string", [
    (1, "2024년 총액은?"), (2, "이 문서 요약해줘"), (3, "2024년 문서 목록 보여줘"), (4, "렌즈 구매 이유가 뭐야"), (5, "이 문서"), (6, "XRN-1620B2 교체 왜 했어"), (7, "총액 요약해줘 얼마"), (8, "hello world"), (9, "report.pdf 내용 알려줘"), (10, "A와 B 비교해줘"),
], also=("benchmark", "1000000 + item_id", "text"))


#: A stated set of ten queries, for what is scored against every file.
FX_FEW = Fixture("fx_queries", FX_QUERIES.schema, FX_QUERIES.rows)


@query(f"""WITH {FX_FEW.sql()}, {FX_FILES.sql()}, t AS (
 SELECT query_id, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS q,
  list_distinct(list_filter(regexp_split_to_array(lower(replace(regexp_replace(regexp_replace(filename, '^\\d{{4}}-\\d{{2}}-\\d{{2}}_', ''), '\\.\\w+$', ''), '_', ' ')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS f FROM fx_queries, fx_files),
s AS (SELECT *, greatest(len(list_intersect(q, f)) / greatest(len(list_distinct(list_concat(q, f))), 1), len(list_intersect(q, f)) / greatest(len(q), 1)) AS likeness FROM t)
SELECT query_id, doc_id, CAST(CASE WHEN likeness >= 0.8 THEN 30 WHEN likeness >= 0.6 THEN 20 WHEN likeness >= 0.4 THEN 10 ELSE 0 END AS DOUBLE) AS bonus FROM s""")
def filename_bonus(spark, sf):
    both = FX_FILES.df(spark, sf).join(F.broadcast(FX_FEW.df(spark)))
    return both.select("query_id", "doc_id", R.filename_bonus(F.col("query"), F.col("filename")).alias("bonus"))


@query(f"""WITH {FX_FEW.sql()}, {FX_FILES.sql()}, t AS (
 SELECT query_id, doc_id, lower(query) AS phrase, lower(filename) AS name, lower(filename) || ' ' || '' || ' ' || lower(coalesce(drafter, '')) AS body,
  list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS q FROM fx_queries, fx_files),
r AS (SELECT *, len(list_filter(q, lambda w: contains(body, w))) AS met FROM t),
r2 AS (SELECT *, 0.7 * (CASE WHEN contains(body, phrase) THEN least(1.0, met / len(q) + 0.3) ELSE met / len(q) END) AS ratio FROM r)
SELECT query_id, doc_id, round(least(10.0, greatest(0.0, 6 * (CASE WHEN ratio = 0 AND met = 0 THEN 1e-6 ELSE ratio END) + least(4.0, 0.4 * len(list_filter(q, lambda w: contains(name, w))) + CASE WHEN len(q) >= 2 AND contains(name, phrase) THEN 1.5 ELSE 0.0 END))), 6) AS score FROM r2""")
def relevance_rescore(spark, sf):
    both = FX_FILES.df(spark, sf).join(F.broadcast(FX_FEW.df(spark)))
    return both.select("query_id", "doc_id", F.round(R.relevance(F.col("query"), F.col("filename"), F.lit(""), F.col("drafter")), 6).alias("score"))


FX_CODES = Fixture("fx_codes", "doc_id int, code string, norm_code string", [(1, "XRN-1620B2", "XRN1620B2"), (2, "LVM 180A", "LVM180A"), (3, "xrn 1620b2", "XRN1620B2"), (3, "COM/GW/AP", "COMGWAP")], also=("documents", "1000000 + doc_id", "concat(source, '-', doc_id)", "upper(concat(source, doc_id))"))
FX_CODE_QUERIES = Fixture("fx_code_queries", "query_id int, code string", [(1, "XRN–1620B2"), (2, "lvm-180a"), (3, "COM/GW"), (4, "report")], also=("benchmark", "1000000 + item_id", "concat('src', item_id % 20, '-', item_id)"))


def _variants_sql(code: str) -> str:
    base = f"upper(trim(regexp_replace(translate({code}, '‐‑‒–—−', '------'), '\\s+', ' ', 'g')))"
    return f"list_sort(list_distinct([{base}, replace({base}, '-', ' '), replace({base}, '/', ' '), replace({base}, '/', '-'), regexp_replace({base}, '[-/\\s]', '', 'g')]))"


@query(f"""WITH {FX_CODES.sql()}, {FX_FILES.sql()}, {FX_CODE_QUERIES.sql()},
v AS (SELECT query_id, unnest({_variants_sql('code')}) AS variant FROM fx_code_queries),
h AS (SELECT q.query_id, c.doc_id, 3.0 AS score, 'code' AS match_type FROM fx_codes c JOIN fx_code_queries q ON c.norm_code = regexp_replace(upper(q.code), '[^A-Z0-9]', '', 'g')
 UNION ALL SELECT query_id, doc_id, CASE WHEN list_contains(regexp_split_to_array(upper(filename), '[-_\\s.]+'), variant) THEN 1.5 ELSE 1.0 END, CASE WHEN list_contains(regexp_split_to_array(upper(filename), '[-_\\s.]+'), variant) THEN 'filename_token' ELSE 'filename_part' END
 FROM v JOIN fx_files ON contains(upper(filename), variant)),
b AS (SELECT query_id, doc_id, CAST(max(score) AS DOUBLE) AS score, max_by(match_type, score) AS match_type FROM h GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""")
def exact_code_lookup(spark, sf):
    return R.code_hits(FX_CODES.df(spark, sf), FX_FILES.df(spark, sf), FX_CODE_QUERIES.df(spark, sf))


@query()
def cascade_search(spark, sf):
    """Benchmark items as queries over all documents (the source as file name and drafter)."""
    from .cascade import cascade

    docs = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(".pdf")).alias("filename"), "text", F.col("source").alias("drafter"))
    codes = docs.select("doc_id", F.explode(F.transform(R.T.extract_codes(F.col("text")), R.T.normalize_code)).alias("norm_code"))
    return cascade(docs, codes, _queries(spark, sf).withColumnRenamed("text", "query"), index=_index(spark, sf))


@query(f"WITH {FX_FILES.sql()} SELECT doc_id, filename, CASE WHEN regexp_matches(filename, '_[0-9]\\.pdf$') THEN 'copy' ELSE 'single' END AS kind FROM fx_files WHERE regexp_matches(lower(filename), '\\.(pdf|txt)$')")
def filename_copies(spark, sf):
    kind = F.when(F.col("filename").rlike(r"_[0-9]\.pdf$"), "copy").otherwise("single")
    return FX_FILES.df(spark, sf).filter(F.lower("filename").rlike(r"\.(pdf|txt)$")).select("doc_id", "filename", kind.alias("kind"))
