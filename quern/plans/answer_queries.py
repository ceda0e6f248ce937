"""Queries of answer checks, search modes and field extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import extract as X
from ..functions.queries import COST, FILE, LIST, QUESTION, REFERENCE, TYPES
from ..sources.tables import table
from .registry import Fixture, query
from .retrieval_queries import FX_QUERIES
from .understanding_queries import _asked, _Q, _text

FX_ANSWERS = Fixture("fx_answers", "id int, answer string, best double, files array<string>", [
    (1, "총 2,370,000원입니다 [2024-03-01_lens.pdf] 구매 문서를 근거로 하였고 자세한 내용은 문서에 있습니다.", 0.7, ["2024-03-01_lens.pdf", "b.pdf"]), (2, "찾을 수 없습니다", 0.5, ["b.pdf"]), (3, "see x.pdf and b.pdf", 0.95, ["b.pdf"]), (4, "", 0.9, []), (5, "답변을 드릴 수 없습니다. 카메라 구매", 0.2, ["c.pdf"]),
], also=("documents", "1000000 + doc_id", "text", "0.5", "split(source, ',')"))
_CITED = "list_distinct(regexp_extract_all(answer, '([^\\s\\[\\](),:]+\\.pdf)', 1))"
_KNOWN = "list_filter(cited, lambda c: len(list_filter(files, lambda a: contains(a, c) OR contains(c, a))) > 0)"


@query(f"""WITH {FX_ANSWERS.sql()}, c AS (SELECT *, {_CITED} AS cited FROM fx_answers), k AS (SELECT *, {_KNOWN} AS valid FROM c)
SELECT id, array_to_string(valid, ',') AS valid, CAST(len(cited) - len(valid) AS INTEGER) AS invalid, length(trim(answer)) >= 15 AND NOT regexp_matches(answer, '{A.REFUSALS}') AND regexp_matches(answer, '{A.SUBSTANCE}') AS meaningful,
round(CASE WHEN len(files) = 0 THEN 0 ELSE greatest(0, least(1, best + least(0.2, 0.1 * len(valid)) - CASE WHEN length(answer) < 50 THEN 0.1 WHEN length(answer) > 1000 THEN 0.05 ELSE 0 END - CASE WHEN regexp_matches(answer, '{A.DOUBTS}') THEN 0.2 ELSE 0 END)) END, 6) AS confidence FROM k""")
def answer_checks(spark, sf):
    c = A.citations(F.col("answer"), F.col("files"))
    sure = F.round(A.confidence(F.col("answer"), F.col("best"), F.col("files")), 6)
    return FX_ANSWERS.df(spark, sf).select("id", F.array_join(c["valid"], ",").alias("valid"), F.size(c["invalid"]).alias("invalid"), A.is_meaningful(F.col("answer")).alias("meaningful"), sure.alias("confidence"))


@query(f"WITH {FX_QUERIES.sql()} SELECT query_id, CASE WHEN regexp_matches(lower(query), '{A.PLAIN}') THEN 'basic' WHEN regexp_matches(lower(query), '{A.WIDE}') THEN 'hybrid' WHEN length(query) > 20 THEN 'hybrid' ELSE 'basic' END AS mode, regexp_matches(query, '{A.WHOLE}') OR length(query) > 50 AS whole FROM fx_queries")
def search_modes(spark, sf):
    return FX_QUERIES.df(spark, sf).select("query_id", A.search_mode(F.col("query")).alias("mode"), A.wants_whole_document(F.col("query")).alias("whole"))


_DOC = f"(regexp_matches(query, {_text(FILE)}) OR regexp_matches(query, {_text(REFERENCE)}))"
_BODY = "regexp_matches(query, '요약|정리|개요|내용|미리보기')"


@query(f"""{_Q}, a AS (SELECT query_id, list_filter([CASE WHEN regexp_matches(query, {_text('(?i)' + COST)}) THEN {{'c': 0.95, 'm': 'COST', 'r': 'cost_intent'}} END, CASE WHEN {_DOC} AND {_BODY} THEN {{'c': 0.9, 'm': 'DOCUMENT', 'r': 'doc_reference+content'}} END,
 CASE WHEN regexp_matches(query, {_text('(?i)' + LIST)}) THEN {{'c': 0.9, 'm': 'SEARCH', 'r': 'list_intent'}} END, CASE WHEN regexp_matches(query, {_text(QUESTION)}) THEN {{'c': 0.8, 'm': 'QA', 'r': 'qa_keywords'}} END, CASE WHEN {_DOC} AND NOT {_BODY} THEN {{'c': 0.6, 'm': 'DOCUMENT', 'r': 'doc_reference_only'}} END], lambda x: x IS NOT NULL) AS l FROM fx_asked),
u AS (SELECT query_id, unnest(CASE WHEN len(l) > 0 THEN l ELSE [{{'c': 0.5, 'm': 'QA', 'r': 'default'}}] END) AS x FROM a) SELECT query_id, CAST(x.c AS DOUBLE) AS confidence, x.m AS mode, x.r AS reason FROM u""")
def alternative_modes(spark, sf):
    return _asked(spark, sf).select("query_id", F.inline(A.alternatives(F.col("query"))))


@query(f"""{_Q}, k AS (SELECT query_id, query, len(regexp_split_to_array(trim(query), '\\s+')) AS words, CASE {" ".join(f"WHEN regexp_matches(query, {_text('(?i)' + p)}) THEN '{n}'" for n, p in TYPES.items())} ELSE 'general' END AS kind FROM fx_asked),
w AS (SELECT query_id, CAST(CASE WHEN kind = 'general' AND words > 5 THEN 0.3 WHEN kind = 'amount' OR regexp_matches(query, '[A-Z]+-?[0-9]+') OR words <= 2 THEN 0.05 ELSE 0.1 END AS DOUBLE) AS vector FROM k) SELECT query_id, vector, round(1 - vector, 6) AS bm25 FROM w""")
def search_weights(spark, sf):
    return _asked(spark, sf).select("query_id", A.weights(F.col("query")).alias("w")).select("query_id", "w.*")


FX_AUTHORS = Fixture("fx_authors", "id int, query string", list(enumerate(f.format(n) for n in ("김하늘", "이바다", "박나무", "한별", "lens") for f in ("{0} 기안서", "작성자: {0}", "{0}이 작성한 문서", "{0}가 기안하신 서류", "기안자 {0}", "{0} 작성문서 목록", "{0}", "제안자{0} 문서", "2024년 {0} 작성한"))), also=("benchmark", "1000000 + item_id", "text"))


@query(f"""WITH {FX_AUTHORS.sql()}, n AS (SELECT id, query, trim(coalesce(nullif(regexp_extract(query, '([가-힣]{{2,4}}?)(?:이|가)?\\s*(?:작성|기안|제안)\\s*(?:한|하신)', 1), ''), nullif(regexp_extract(query, '(?:작성자|기안자|제안자)[\\s:]*([가-힣]{{2,4}})', 1), ''), nullif(regexp_extract(query, '([가-힣]{{2,4}})\\s+(?:기안서|작성문서)', 1), ''))) AS name FROM fx_authors)
SELECT id, unnest(CASE WHEN name IS NULL THEN [query] ELSE [name, '기안자 ' || name, '작성자 ' || name, name || ' 기안서', name || ' 문서'] END) AS expanded FROM n""")
def author_expansion(spark, sf):
    return FX_AUTHORS.df(spark, sf).select("id", F.explode(A.author_queries(F.col("query"))).alias("expanded"))


@query("SELECT page_id, 'doc:' || left(sha1(url), 10) AS reference FROM pages")
def file_references(spark, sf):
    return table(spark, sf, "pages").select("page_id", A.file_reference(F.col("url")).alias("reference"))


@query("SELECT item_id, list_transform(range(64), lambda i: CAST(CAST('0x' || substr(sha256(text), (i % 32) * 2 + 1, 2) AS INTEGER) / 255 - 0.5 AS FLOAT)) AS vector FROM benchmark")
def hash_vectors(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", A.hash_vector(F.col("text"), 64).alias("vector"))


FX_FIELDS = Fixture("fx_fields", "id int, text string", [
    (1, "단가: 333,000원 수량: 2 VAT 별도 총액 732,600원"), (2, "총액: 3.5억원 부가세 포함"), (3, "카메라와 렌즈, 모니터. 문서번호: AB-12 주식회사 한빛 담당 010-1234-5678 a@B.co 2024.3.5"), (4, "nothing"), (5, None),
], also=("documents", "1000000 + doc_id", "text"))


FX_SUMS = Fixture("fx_sums", "id int, text string", list(enumerate([" ".join(x for x in p if x) for p in ((a, b, c, d) for a in ("단가: 333,000원", "unit price 1,200", "개당 2.5만원", "") for b in ("수량: 2", "3 EA", "4개입", "") for c in ("금액: 666,000", "소계 1.2억", "") for d in ("VAT 별도 총액 732,600원", "부가세 10,000 부가세 포함 합계: 3.5억원", "면세", ""))] + [None])), also=("documents", "1000000 + doc_id", "text"))


def _field_sql(name: str) -> str:
    found = []
    for p in X.FINANCE[name]:
        # RE2 looks neither ahead nor behind: what must not follow is matched instead.
        text, p = ("text || ' '", p.replace(r"()(?![가-힣\w])", r"()[^가-힣0-9A-Za-z_]")) if "(?!" in p else ("text", p)
        n, u = (f"regexp_extract({text}, '{p}', {g})" for g in (1, 2))
        found.append(f"CAST(round(TRY_CAST(replace({n}, ',', '') AS DECIMAL(20,4)) * CASE WHEN starts_with({u}, '억') THEN 100000000 WHEN starts_with({u}, '만') THEN 10000 ELSE 1 END, 0) AS BIGINT)")
    return f"coalesce({', '.join(found)})"


@query(f"""WITH {FX_SUMS.sql()}, f AS (SELECT id, text, {", ".join(f"{_field_sql(n)} AS {n}" for n in X.FINANCE)} FROM fx_sums)
SELECT id, unit_price, quantity, coalesce(amount, unit_price * quantity) AS amount, vat, total, CASE WHEN regexp_matches(text, '(?i)부가세\\s*포함|VAT\\s*포함') THEN 'included' WHEN regexp_matches(text, '(?i)부가세\\s*별도|VAT\\s*별도') THEN 'excluded' WHEN regexp_matches(text, '면세|영세') THEN 'none' ELSE 'unknown' END AS vat_mode FROM f""")
def financial_fields(spark, sf):
    return FX_SUMS.df(spark, sf).select("id", X.finances(F.col("text")).alias("f")).select("id", "f.*")


@query()
def document_metadata(spark, sf):
    return FX_FIELDS.df(spark, sf).select("id", F.to_json(X.metadata(F.col("text"))).alias("metadata"))
