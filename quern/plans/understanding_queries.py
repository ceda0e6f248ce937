"""Queries of query understanding over a few hundred generated queries, and over the benchmark's hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import queries as Q
from ..functions import understanding as U
from ..operators import people as P
from ..sources.tables import table
from .registry import Fixture, query
from .retrieval_queries import _bm25, _bm25_sql, _queries

_HEADS = ["", "2024년 ", "year:2023 ", "작년 ", "'24 ", "🏷 pdf · 📅 2024-10-24 · ✍ 김하늘 · ", "latest "]
_SUBJECTS = ["중계차 보수", "무선마이크 구매", "LVM-180A 교체", "문서", "김하늘 과장", "hello", "1+1", "drafter:이바다 렌즈", "COM/GW_AP", "최 나 무"]
_ENDS = [" 내용 요약해줘", " 자세히 알려줘", " 전부 보여줘", "은 얼마", "", "은?", " 최근 목록에서는", " 비용이 얼마나 될까요?", " 2024-03-01_렌즈_구매.pdf"]
FX_ASKED = Fixture("fx_asked", "query_id int, query string", [(k, h + s + e) for k, (h, s, e) in enumerate((h, s, e) for h in _HEADS for s in _SUBJECTS for e in _ENDS)], also=("benchmark", "1000000 + item_id", "text"))
FX_PEOPLE = Fixture("fx_people", "drafter string", [("김하늘",), ("이바다 팀장",), ("최나무",), ("최나무(부장)",), ("중계자",), ("",), (None,), ("미상",), ("Lee JH",)], also=("documents", "source"))
TODAY = "2025-06-01"
_Q = f"WITH {FX_ASKED.sql()}"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


def _any(column: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({column}, w))) > 0"


def _sub(column: str, *pairs: tuple[str, str]) -> str:
    for pattern, standing in pairs:
        column = f"regexp_replace({column}, {_text(pattern)}, {_text(standing)}, 'g')"
    return column


def _asked(spark, sf):
    return FX_ASKED.df(spark, sf)


_TOKENS = "regexp_extract_all(query, '[A-Za-z0-9\\-_/]+|[가-힣]+')"
_NORMAL = _sub("lower(trim(" + _sub("query", (r"\s+", " ")) + "))", ("(자|상)세(히|하게)(요|좀)?", r"\1세히"), (r"풀[\s\-]?버(전|젼)", "풀버전"))


@query(f"{_Q} SELECT query_id, trim({_sub('query', ('🏷[^·]+·\\s*', ''), ('📅[^·]+·\\s*', ''), ('✍[^·]+', ''), ('\\s+pdf\\s+', ' '), ('\\s+', ' '))}) AS query FROM fx_asked")
def strip_ui_tags(spark, sf):
    return _asked(spark, sf).select("query_id", U.strip_ui_tags(F.col("query")).alias("query"))


@query(f"""{_Q}, d AS (SELECT query_id, {_NORMAL} AS q FROM fx_asked), m AS (SELECT query_id, {_any('q', U.DETAIL)} OR regexp_matches(q, {_text('|'.join(U.DETAIL_IN_CONTEXT))}) AS merge,
 {' OR '.join(f"regexp_matches(q, {_text('(?i)' + p)})" for p in Q.SECTIONS.values())} AS section, {_any('q', U.SUMMARY_WORDS)} AS summary FROM d),
n AS (SELECT query_id, merge, CASE WHEN merge THEN 'DETAILED' WHEN section THEN 'SECTION' WHEN summary THEN 'SUMMARY' ELSE 'QA' END AS mode FROM m)
SELECT query_id, mode, lower(mode) AS prompt, CAST(CASE mode WHEN 'DETAILED' THEN 1500 WHEN 'SECTION' THEN 900 WHEN 'SUMMARY' THEN 600 ELSE 800 END AS INTEGER) AS max_tokens, CAST(CASE WHEN merge THEN 8 ELSE 5 END AS INTEGER) AS top_k, merge, CAST(CASE WHEN merge THEN 3200 ELSE 2000 END AS INTEGER) AS max_context FROM n""")
def query_depth(spark, sf):
    return _asked(spark, sf).select("query_id", U.depth(F.col("query")).alias("d")).select("query_id", "d.*")


_FORCED = f"""CASE WHEN lower(trim(query)) IN ({', '.join(map(_text, U.SMALLTALK))}) OR regexp_matches(lower(trim(query)), {_text(U.GREETING)}) THEN 'smalltalk'
 WHEN regexp_matches(trim(query), {_text(U.SIMPLE_MATH)}) THEN 'simple_math' WHEN len({_TOKENS}) < 3 AND NOT ({_any('lower(query)', U.DOMAIN)}) THEN 'short_query' END"""


@query(f"{_Q} SELECT query_id, {_FORCED} AS reason, CAST(len({_TOKENS}) AS INTEGER) AS tokens, list_filter({_list(U.DOMAIN)}, lambda w: contains(lower(query), w)) AS domain FROM fx_asked")
def forced_chat(spark, sf):
    return _asked(spark, sf).select("query_id", U.forced_chat(F.col("query")).alias("reason"), U.token_count(F.col("query")).alias("tokens"), U.domain_words(F.col("query")).alias("domain"))


@query("WITH " + _bm25_sql("robertson") + f""", a AS (SELECT item_id AS query_id, text AS query FROM benchmark), h AS (SELECT b.query_id, query, score, lower(text) AS t, list_filter({_list(U.DOMAIN)}, lambda w: contains(lower(query), w)) AS ws FROM bm25 b JOIN a USING (query_id) JOIN documents USING (doc_id)),
c AS (SELECT query_id, max(score) AS top_score FROM h GROUP BY ALL), k AS (SELECT query_id, count(DISTINCT w) AS coverage FROM (SELECT query_id, t, unnest(ws) AS w FROM h) WHERE contains(t, w) GROUP BY ALL)
SELECT query_id, top_score, coalesce(coverage, 0) AS coverage, CASE WHEN {_FORCED} IS NULL AND top_score >= 0.35 THEN 'rag' ELSE 'chat' END AS mode,
 CASE WHEN {_FORCED} IS NULL AND top_score >= 0.25 AND {_any('lower(query)', U.DOMAIN)} AND len({_TOKENS}) >= 4 AND coalesce(coverage, 0) >= 2 THEN 'rag' ELSE 'chat' END AS strict_mode FROM c LEFT JOIN k USING (query_id) JOIN a USING (query_id)""")
def search_or_chat(spark, sf):
    asked = _queries(spark, sf).withColumnRenamed("text", "query")
    met = P.coverage(asked, _bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")).join(asked, "query_id")
    modes = {"mode": "normalized", "strict_mode": "absolute"}
    return met.select("query_id", "top_score", "coverage", *[U.gate(F.col("query"), F.col("top_score"), F.col("coverage"), policy).alias(name) for name, policy in modes.items()])


@query(f"""{_Q} SELECT query_id, CAST(nullif(regexp_extract(query, '(\\d{{4}})\\s*년?', 1), '') AS INTEGER) AS year, nullif(regexp_extract(query, '([가-힣]{{2,4}})\\s*(문서|기안서|작성|기안|의)', 1), '') AS drafter FROM fx_asked""")
def plain_filters(spark, sf):
    return _asked(spark, sf).select("query_id", U.plain_filters(F.col("query")).alias("f")).select("query_id", "f.*")


_NAME = f"lower(regexp_replace(replace(trim(regexp_replace({{0}}, '[\\(\\)\\[\\]{{{{}}}}]', '', 'g')), ' ', ''), '({'|'.join(U.ROLES)})\\s*', '', 'g'))"
_NOT = f"list_contains({_list(U.NOT_NAMES)}, {{0}})"


@query(f"""{_Q}, {FX_PEOPLE.sql()}, names AS (SELECT key, first(drafter ORDER BY -length(drafter), drafter) AS original FROM (SELECT DISTINCT drafter, {_NAME.format('drafter')} AS key FROM fx_people WHERE drafter <> '') GROUP BY key),
d AS (SELECT query_id, query, regexp_extract(query, {_text(U.YEAR_DIRECTIVE)}, 1) AS ydir, nullif(trim(regexp_extract(query, {_text(U.DRAFTER_DIRECTIVE)}, 1)), '') AS ddir FROM fx_asked),
t AS (SELECT d.*, n.original AS by_token, CASE WHEN length(ydir) = 4 THEN CAST(ydir AS INTEGER) WHEN length(ydir) = 2 THEN 2000 + CAST(ydir AS INTEGER) END AS ytok FROM d LEFT JOIN names n ON n.key = {_NAME.format('ddir')}),
runs AS (SELECT query_id, unnest(r) AS c, unnest(range(len(r))) AS place FROM (SELECT query_id, regexp_extract_all(query, '[가-힣]{{2,4}}') AS r FROM t WHERE ytok IS NULL AND by_token IS NULL)),
spaced AS (SELECT query_id, array_to_string(list_filter(regexp_split_to_array(s, ' +'), lambda w: NOT {_NOT.format('w')}), '') AS c, 1000 + place AS place FROM (SELECT query_id, unnest(r) AS s, unnest(range(len(r))) AS place FROM (SELECT query_id, regexp_extract_all(query, '[가-힣]{{1,2}}(?: +[가-힣]{{1,2}}){{1,3}}') AS r FROM t WHERE ytok IS NULL AND by_token IS NULL))),
cand AS (SELECT *, {_NAME.format('c')} AS key FROM (SELECT * FROM runs UNION ALL SELECT * FROM spaced) WHERE length(c) BETWEEN 2 AND 4 AND NOT {_NOT.format('c')}),
exact AS (SELECT query_id, arg_min(original, place) AS exact FROM cand JOIN names USING (key) WHERE length(key) BETWEEN 2 AND 4 GROUP BY ALL)
SELECT query_id, CAST(CASE WHEN ytok IS NOT NULL OR by_token IS NOT NULL THEN ytok END AS INTEGER) AS year,
 CASE WHEN ytok IS NOT NULL OR by_token IS NOT NULL THEN by_token ELSE exact END AS drafter, CASE WHEN ytok IS NOT NULL OR by_token IS NOT NULL THEN 'token' WHEN exact IS NOT NULL THEN 'closed_world' END AS source FROM t LEFT JOIN exact USING (query_id)""")
def parse_filters(spark, sf):
    """Exact names: no candidate is like a name and not the same here; likeness has a unit test, years outside of directives have ``parse_years``."""
    return P.parse_filters(_asked(spark, sf), FX_PEOPLE.df(spark, sf), F.to_date(F.lit(TODAY))).select("query_id", F.when(F.col("source") == "token", F.col("year_lo")).alias("year"), "drafter", "source")


@query(f"WITH {FX_PEOPLE.sql()} SELECT DISTINCT drafter FROM fx_people WHERE drafter IS NOT NULL AND drafter NOT IN ('', '미상', '작성자 미상')")
def drafter_names(spark, sf):
    return P.drafter_names(FX_PEOPLE.df(spark, sf))


_BARE = "regexp_replace(replace(lower({0}), '&', 'and'), '[\\s_·,:()\\\\\\[\\]\\-]+', '', 'g')"


@query("WITH " + _bm25_sql("robertson") + f""", a AS (SELECT item_id AS query_id, '요약 ' || substr(text, 1, 20) AS query FROM benchmark), h AS (SELECT query_id, doc_id, query, {_BARE.format('query')} AS x, {_BARE.format("substr(text, 1, 30)")} AS y FROM bm25 JOIN a USING (query_id) JOIN documents USING (doc_id)),
s AS (SELECT *, round(least(1.0, CASE WHEN contains(x, y) OR contains(y, x) THEN 0.8 ELSE 0.0 END + greatest(0.0, 0.4 - abs(length(x) - length(y)) * 0.01)), 9) AS likeness FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY likeness DESC, doc_id) AS turn, count(*) OVER (PARTITION BY query_id) AS n FROM s)
SELECT query_id, CASE WHEN n = 1 OR likeness >= 0.66 THEN doc_id END AS doc_id, CASE WHEN n = 1 OR likeness >= 0.66 THEN likeness END AS likeness FROM n WHERE turn = 1""")
def route_with_hits(spark, sf):
    """Benchmark items as queries for contents; the head of each hit's text is its title."""
    asked = _queries(spark, sf).select("query_id", F.concat(F.lit("요약 "), F.left("text", F.lit(20))).alias("query"))
    hits = _bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(30)).alias("title")), "doc_id")
    return P.route_with_hits(asked, hits).join(hits.select("query_id").distinct(), "query_id").select("query_id", "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("confidence")).alias("likeness"))


@query(f"{_Q} SELECT query_id, list_filter(list_transform({_TOKENS}, lambda t: lower(t)), lambda t: length(t) > 1 AND NOT list_contains({_list(U.PARTICLES + U.STOPWORDS)}, t)) AS tokens FROM fx_asked")
def search_tokens(spark, sf):
    return _asked(spark, sf).select("query_id", U.search_tokens(F.col("query")).alias("tokens"))


@query(f"""{_Q}, t AS (SELECT DISTINCT unnest({_TOKENS}) AS token FROM fx_asked) SELECT token, list_sort(list_filter(list_distinct([token, replace(token, '-', ''), replace(token, '-', ' '), replace(token, '_', ''), replace(token, '_', ' '), replace(token, '/', ''), replace(token, '/', ' ')]), lambda v: length(v) > 1)) AS variants FROM t""")
def token_variants(spark, sf):
    return _asked(spark, sf).select(F.explode(U.quick_tokens(F.col("query"))).alias("token")).distinct().select("token", U.token_variants(F.col("token")).alias("variants"))


ABBREVIATIONS = {"중계차": "방송중계차량", "LVM": "모니터", "ENG": "뉴스취재"}


@query(f"{_Q} SELECT query_id, list_filter([{', '.join(f'CASE WHEN contains(query, {_text(a)}) THEN replace(query, {_text(a)}, {_text(b)}) WHEN contains(query, {_text(b)}) THEN replace(query, {_text(b)}, {_text(a)}) END' for a, b in ABBREVIATIONS.items())}], lambda x: x IS NOT NULL) AS queries FROM fx_asked")
def abbreviation_expansion(spark, sf):
    return _asked(spark, sf).select("query_id", U.swapped_abbreviations(F.col("query"), ABBREVIATIONS).alias("queries"))


@query(f"{_Q} SELECT query_id, CASE WHEN {_any('query', U.RECENT)} THEN list_slice(list_filter([{', '.join(f'CASE WHEN NOT contains(query, {_text(w)}) THEN query || {_text(chr(32) + w)} END' for w in ('최신', '신규', '2025'))}], lambda x: x IS NOT NULL), 1, 2) ELSE [] END AS queries FROM fx_asked")
def recency_expansion(spark, sf):
    return _asked(spark, sf).select("query_id", U.recent_queries(F.col("query"), F.to_date(F.lit(TODAY))).alias("queries"))


_SWAPPED = ", ".join(f"regexp_replace(query, {_text('([' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+)' + a)}, {_text(chr(92) + '1' + b)}, 'g')" for a, b in U.SWAPS)


@query(f"{_Q}, s AS (SELECT query_id, query, [{_SWAPPED}] AS qs FROM fx_asked), d AS (SELECT query_id, query, list_filter(qs, lambda x, i: x <> query AND list_position(qs, x) = i) AS qs FROM s) SELECT query_id, list_slice(qs, 1, 2) AS queries FROM d")
def particle_expansion(spark, sf):
    return _asked(spark, sf).select("query_id", U.swapped_particles(F.col("query")).alias("queries"))


@query(f"{_Q} SELECT query_id, trim({_sub('query', *U.ENDINGS, (chr(92) + 's+', ' '))}) AS query FROM fx_asked")
def query_cleaning(spark, sf):
    return _asked(spark, sf).select("query_id", U.cleaned(F.col("query")).alias("query"))


@query(f"""{_Q} SELECT query_id, CAST(len(list_filter(regexp_split_to_array(trim(query), '\\s+'), lambda x: x <> '')) AS INTEGER) AS tokens, regexp_matches(query, '\\d') AS has_numbers, regexp_matches(query, '{U.MODEL_CODE}') AS has_codes, regexp_matches(query, '{U.AMOUNT}') AS has_amounts, CAST(length(query) AS INTEGER) AS length FROM fx_asked""")
def query_analysis(spark, sf):
    return _asked(spark, sf).select("query_id", U.analysis(F.col("query")).alias("a")).select("query_id", "a.*")


@query(f"""{_Q}, f AS (SELECT query_id, coalesce(nullif(regexp_extract(query, {_text(U.DATED_FILE[0])}, 1), ''), nullif(regexp_extract(query, {_text(U.DATED_FILE[1])}, 1), '')) AS f FROM fx_asked) SELECT query_id, CASE WHEN ends_with(lower(f), '.pdf') THEN f ELSE f || '.pdf' END AS filename FROM f""")
def named_file(spark, sf):
    return _asked(spark, sf).select("query_id", U.named_file(F.col("query")).alias("filename"))


WEIGHTS = {"data": 1.5, "model": 1.0, "training": 2.0, "the": 0.5, "and": 0.25}
_W = ", ".join(f"('{w}', {x})" for w, x in WEIGHTS.items())


@query("WITH " + _bm25_sql("robertson") + f""", w(word, weight) AS (VALUES {_W}), h AS (SELECT query_id, doc_id, lower(q.text) AS q, lower(d.text) AS t FROM bm25 b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d USING (doc_id)),
m AS (SELECT query_id, doc_id, sum(least(weight, weight * 0.3 * (length(t) - length(replace(t, word, ''))) / length(word))) / sum(weight) AS s FROM h JOIN w ON contains(q, word) GROUP BY ALL)
SELECT query_id, doc_id, round(least(1.0, coalesce(s, 0.0)), 6) AS score FROM h LEFT JOIN m USING (query_id, doc_id)""")
def domain_keyword_score(spark, sf):
    asked = _queries(spark, sf).withColumnRenamed("text", "query")
    both = _bm25(spark, sf).select("query_id", "doc_id").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(asked, "query_id")
    return both.select("query_id", "doc_id", F.round(U.keyword_weight(F.col("text"), F.col("query"), WEIGHTS), 6).alias("score"))
