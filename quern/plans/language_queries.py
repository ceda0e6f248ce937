"""Queries of query understanding and of contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import queries as Q
from ..functions import text as T
from ..operators import context as X
from ..operators import retrieval as R
from ..sources.tables import table
from .registry import Fixture, query
from .retrieval_queries import FX_QUERIES, _bm25, _bm25_sql, _queries

_FX = f"WITH {FX_QUERIES.sql()}"


def _matches(pattern: str, column: str = "query", flags: str = "i") -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{flags}')"


@query(f"""{_FX}, i AS (SELECT *, {_matches(Q.COST)} AS cost_intent, {_matches(Q.LIST)} AS list_intent, {_matches(Q.CONTENT)} AS content_intent, {_matches(Q.REFERENCE)} AS ref, {_matches(Q.FILE, flags='c')} AS file, {_matches(Q.DOCUMENT_KIND)} AS kind, {_matches(Q.QUESTION)} AS qa FROM fx_queries)
SELECT query_id, CASE WHEN cost_intent THEN 'COST' WHEN (file OR ref OR kind) AND content_intent THEN 'DOCUMENT' WHEN list_intent THEN 'SEARCH' WHEN qa THEN 'QA' WHEN file OR ref THEN 'SEARCH' ELSE 'QA' END AS mode,
CAST(CASE WHEN cost_intent THEN 0.95 WHEN (file OR ref OR kind) AND content_intent THEN 0.9 WHEN list_intent THEN 0.9 WHEN qa THEN 0.8 WHEN file OR ref THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence, cost_intent, list_intent, content_intent FROM i""")
def route_queries(spark, sf):
    return FX_QUERIES.df(spark, sf).select("query_id", Q.route(F.col("query")).alias("r")).select("query_id", "r.*")


FX_YEARS = Fixture("fx_years", "id int, query string, today string", [(1, "작년 문서", "2025-06-01"), (2, "2023~25 비용", "2025-06-01"), (3, "2023-2025년", "2025-06-01"), (4, "'24 구매", "2025-06-01"), (5, "렌즈", "2025-06-01"), (6, "재작년", "2025-06-01"), (7, "98년 문서", "2025-06-01"), (8, "2024년 3월", "2025-06-01")], also=("documents", "1000000 + doc_id", "text", "'2025-06-01'"))


@query(f"""WITH {FX_YEARS.sql()}, y AS (SELECT *, CAST(year(CAST(today AS DATE)) AS INTEGER) AS ty, regexp_extract(query, '''?(\\d{{4}}|\\d{{2}})년?\\s*[~\\-–]\\s*''?(\\d{{4}}|\\d{{2}})(?:\\D|$)', 1) AS a, regexp_extract(query, '''?(\\d{{4}}|\\d{{2}})년?\\s*[~\\-–]\\s*''?(\\d{{4}}|\\d{{2}})(?:\\D|$)', 2) AS b,
 nullif(regexp_extract(query, '(?:^|\\D)((?:19|20)\\d{{2}})(?:\\D|$)', 1), '') AS four, coalesce(nullif(regexp_extract(query, '''(\\d{{2}})(?:\\D|$)', 1), ''), nullif(regexp_extract(query, '(?:^|\\D)(\\d{{2}})년', 1), '')) AS two FROM fx_years),
n AS (SELECT *, list_transform([a, b, two], lambda x: CASE WHEN length(x) = 4 THEN CAST(x AS INTEGER) WHEN length(x) = 2 THEN CASE WHEN ty // 100 * 100 + CAST(x AS INTEGER) > ty + 20 THEN ty // 100 * 100 + CAST(x AS INTEGER) - 100 ELSE ty // 100 * 100 + CAST(x AS INTEGER) END END) AS v,
 CASE WHEN contains(query, '재작년') THEN ty - 2 WHEN contains(query, '작년') THEN ty - 1 WHEN contains(query, '올해') THEN ty END AS rel FROM y)
SELECT id, CAST(CASE WHEN rel IS NULL AND v[1] IS NOT NULL AND v[2] IS NOT NULL THEN least(v[1], v[2]) ELSE coalesce(rel, CAST(four AS INTEGER), v[3]) END AS INTEGER) AS lo, CAST(CASE WHEN rel IS NULL AND v[1] IS NOT NULL AND v[2] IS NOT NULL THEN greatest(v[1], v[2]) ELSE coalesce(rel, CAST(four AS INTEGER), v[3]) END AS INTEGER) AS hi FROM n""")
def parse_years(spark, sf):
    return FX_YEARS.df(spark, sf).select("id", Q.years(F.col("query"), F.to_date("today")).alias("y")).select("id", "y.*")


@query(f"{_FX} SELECT query_id, CASE " + " ".join(f"WHEN {_matches(p)} THEN '{n}'" for n, p in Q.TYPES.items()) + " ELSE 'general' END AS type FROM fx_queries")
def question_type(spark, sf):
    return FX_QUERIES.df(spark, sf).select("query_id", Q.question_type(F.col("query")).alias("type"))


@query(f"{_FX}, c AS (SELECT query_id, CASE WHEN {_matches(Q.COMPARISON, 'lower(query)')} THEN 'comparison' WHEN {_matches(Q.HARD, 'lower(query)')} THEN 'complex' WHEN {_matches(Q.EASY, 'lower(query)')} THEN 'simple' WHEN len(regexp_split_to_array(trim(query), '\\s+')) > 5 THEN 'complex' ELSE 'simple' END AS complexity FROM fx_queries) SELECT *, CAST(CASE complexity WHEN 'comparison' THEN 10 WHEN 'complex' THEN 7 ELSE 3 END AS INTEGER) AS k FROM c")
def query_complexity(spark, sf):
    return FX_QUERIES.df(spark, sf).select("query_id", Q.complexity(F.col("query")).alias("complexity"), Q.adaptive_k(F.col("query")).alias("k"))


@query(f"{_FX} SELECT query_id, CASE " + " ".join(f"WHEN {_matches(p, 'lower(query)')} THEN '{n}'" for n, p in Q.SECTIONS.items()) + " END AS section FROM fx_queries")
def detect_section(spark, sf):
    return FX_QUERIES.df(spark, sf).select("query_id", Q.section(F.col("query")).alias("section"))


FX_KEYS = Fixture("fx_keys", "id int, query string", list(enumerate(f.format(a, b) for f in ("{0} {1}", "{0}  {1}?", "{1}, {0}!", " {0}/{1}", "{0}.") for a in ("LVM-180A", "lvm 180a", "NVR", "녹화기", "a b c", "XRN_1620 b2") for b in ("사양", "비용", "full ver", "2024"))), also=("documents", "1000000 + doc_id", "text"))
_PLAIN = "regexp_replace(regexp_replace(lower(trim(query)), '[?!.,;:]', '', 'g'), '[-/_]', ' ', 'g')"
# Patterns that look at both sides of a space without taking them: twice is enough for pieces of one character.
_JOINED = "regexp_replace(regexp_replace({0}, '([a-z0-9])\\s+([a-z0-9])', '\\1\\2', 'g'), '([a-z0-9])\\s+([a-z0-9])', '\\1\\2', 'g')"


@query(f"""WITH {FX_KEYS.sql()}, c AS (SELECT id, trim(regexp_replace({_JOINED.format(_PLAIN)}, '\\s+', ' ', 'g')) AS q FROM fx_keys)
SELECT id, left(sha256(array_to_string(list_transform(string_split(q, ' '), lambda x: CASE WHEN x = '녹화기' THEN 'nvr' ELSE x END), ' ')), 16) AS key FROM c""")
def smart_key(spark, sf):
    return FX_KEYS.df(spark, sf).select("id", Q.smart_key(F.col("query"), synonyms={"녹화기": "nvr"}).alias("key"))


SYNONYMS = {"렌즈": ["lens", "광학계"], "비용": ["금액", "가격"]}


@query(f"{_FX} SELECT query_id, unnest(list_distinct(list_concat([query], CASE WHEN contains(query, '렌즈') THEN [replace(query, '렌즈', 'lens'), replace(query, '렌즈', '광학계')] ELSE [] END, CASE WHEN contains(query, '비용') THEN [replace(query, '비용', '금액'), replace(query, '비용', '가격')] ELSE [] END))) AS expanded FROM fx_queries")
def expand_synonyms(spark, sf):
    return FX_QUERIES.df(spark, sf).select("query_id", F.explode(Q.expansions(F.col("query"), SYNONYMS)).alias("expanded"))


FX_SPELLINGS = Fixture("fx_spellings", "id int, code string", [(1, "XRN–1620B2"), (2, "lvm/180a"), (3, "COM/GW AP"), (4, "FX3")], also=("pages", "1000000 + page_id", "url"))


@query(f"WITH {FX_SPELLINGS.sql()}, b AS (SELECT id, upper(trim(regexp_replace(translate(code, '‐‑‒–—−', '------'), '\\s+', ' ', 'g'))) AS b FROM fx_spellings) SELECT id, unnest(list_distinct([b, replace(b, '-', ' '), replace(b, '/', ' '), replace(b, '/', '-'), regexp_replace(b, '[-/\\s]', '', 'g')])) AS variant FROM b")
def expand_variants(spark, sf):
    return FX_SPELLINGS.df(spark, sf).select("id", F.explode(T.code_variants(F.col("code"))).alias("variant"))


_W = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))"
_RUNS = "list_distinct(regexp_extract_all(lower({0}), '[가-힣a-zA-Z0-9]+'))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SENTENCES = """, first AS (SELECT b.query_id, b.doc_id, d.text, q.text AS query FROM bm25 b JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = b.query_id WHERE b.rank = 1),
parts AS (SELECT query_id, query, list_filter(list_transform(regexp_split_to_array(text, '[.!?]\\s+|\\n+'), lambda x: trim(x)), lambda x: length(x) >= 10) AS s FROM first),
e AS (SELECT query_id, query, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos, len(s) - 1 AS last FROM parts),
rated AS (SELECT query_id, CAST(pos AS INTEGER) AS pos, sentence, round((5 * len(list_intersect(""" + _RUNS.format("query") + ", " + _RUNS.format("sentence") + ")) / len(" + _RUNS.format("query") + ") + 2 * (" + " + ".join(f"len(regexp_extract_all(sentence, {_quoted('(?i)' + p)}))" for p in X.IMPORTANT) + ") + " + " + ".join(f"CASE WHEN contains(lower(sentence), '{w.lower()}') THEN {n} ELSE 0 END" for w, n in X.VALUED.items()) + """ + CASE WHEN pos = 0 THEN 1.0 WHEN pos = last THEN 0.5 ELSE 0 END)
 * CASE WHEN length(sentence) < 20 THEN 0.5 WHEN length(sentence) > 200 THEN 0.8 ELSE 1.0 END, 6) AS score FROM e)"""


def _scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    first = _bm25(spark, sf).filter("rank = 1").join(docs, "doc_id").join(_queries(spark, sf).withColumnRenamed("text", "query"), "query_id")
    return X.scored_sentences(first, F.col("query"), "query_id")


@query("WITH " + _bm25_sql("robertson") + _SENTENCES + " SELECT query_id, pos, sentence, score FROM rated")
def sentence_scores(spark, sf):
    return _scored(spark, sf)


@query("WITH " + _bm25_sql("robertson") + _SENTENCES + """ SELECT query_id, pos, sentence, score FROM (SELECT *, row_number() OVER w AS r, sum(length(sentence)) OVER (PARTITION BY query_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS run, count(*) OVER (PARTITION BY query_id) AS n, sum(length(sentence)) OVER (PARTITION BY query_id) AS total FROM rated WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, pos))
WHERE r <= greatest(1, floor(n * 0.7)) AND (run <= total * 0.7 OR r = 1)""")
def compress_stop(spark, sf):
    return X.compress_stop(_scored(spark, sf), "query_id")


@query("WITH RECURSIVE " + _bm25_sql("robertson") + _SENTENCES + """, ordered AS (SELECT query_id, pos, length(sentence) AS n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS k FROM rated),
walk AS (SELECT query_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST([] AS INTEGER[]) AS kept FROM (SELECT DISTINCT query_id FROM ordered)
  UNION ALL SELECT w.query_id, o.k, CASE WHEN used + n <= 600 THEN used + n ELSE used END, CASE WHEN used + n <= 600 THEN list_append(kept, pos) ELSE kept END FROM walk w JOIN ordered o ON o.query_id = w.query_id AND o.k = w.k + 1)
SELECT query_id, list_sort(arg_max(kept, k)) AS kept FROM walk GROUP BY query_id""")
def compress_skip(spark, sf):
    return X.compress_skip(_scored(spark, sf), "query_id", 600)


@query("WITH " + _bm25_sql("robertson") + """, c AS (SELECT query_id, rank, trim(text) AS t FROM bm25 JOIN documents USING (doc_id) WHERE trim(text) <> ''), r AS (SELECT *, sum(length(t) + 2) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM c),
k AS (SELECT query_id, rank, CASE WHEN run - 2 > 3600 THEN left(t, CAST(3600 - (run - length(t) - 2) AS BIGINT)) ELSE t END AS t FROM r WHERE run - length(t) - 2 < 3600)
SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS context, CAST(count(*) AS INTEGER) AS chunks_used FROM k GROUP BY query_id""")
def hydrate_context(spark, sf):
    return X.hydrated(_bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"))


@query()
def chunk_overlap(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunked("text")).alias("chunk", "text"))


@query("SELECT doc_id, round(len(regexp_extract_all(text, '[가-힣]')) / greatest(length(text), 1), 6) AS hangul, round(len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1), 6) AS latin FROM documents")
def language_ratio(spark, sf):
    hangul, latin = T.language_ratio(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.round(hangul, 6).alias("hangul"), F.round(latin, 6).alias("latin"))


@query("SELECT doc_id, CAST(greatest(len(regexp_extract_all(text, '[가-힣]')), len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("WITH " + _bm25_sql("robertson") + ", s AS (SELECT query_id, max(score) FILTER (rank = 1) AS t1, coalesce(max(score) FILTER (rank = 2), 0) AS t2, count(*) AS hits FROM bm25 GROUP BY query_id) SELECT query_id, CASE WHEN hits >= 1 AND round(t1 - t2, 6) < 0.05 THEN 'SEARCH' ELSE 'QA' END AS mode, CAST(CASE WHEN hits >= 1 AND round(t1 - t2, 6) < 0.05 THEN 0.5 ELSE 0.5 END AS DOUBLE) AS confidence FROM s")
def route_with_retrieval(spark, sf):
    stats = R.score_stats(_bm25(spark, sf))
    return stats.select("query_id", Q.downgraded(F.lit("QA"), F.lit(0.5), F.col("hits"), F.col("delta12")).alias("r")).select("query_id", "r.*")
