"""Queries of text, codes, money, dates, tables and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import money as M
from ..functions import text as T
from ..sources.tables import table
from .registry import Fixture, query
from .retrieval_queries import FX_FILES


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '[*_`#]+', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages")
def html_strip_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


FX_TEXT = Fixture("fx_text", "id int, text string", [(1, "XRN-1620B2 and lvm 180a"), (2, "FX3, THIS-1 코드LVM180A는"), (3, "no codes here"), (4, "DeckLink 4K Extreme 12G"), (5, None)], also=("documents", "1000000 + doc_id", "text"))


@query(f"WITH {FX_TEXT.sql()} SELECT id, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS code FROM fx_text")
def normalize_code(spark, sf):
    return FX_TEXT.df(spark, sf).select("id", T.normalize_code(F.col("text")).alias("code"))


@query()
def extract_codes(spark, sf):
    return FX_TEXT.df(spark, sf).select("id", F.posexplode(T.extract_codes(F.col("text"))).alias("pos", "code"))


FX_MONEY = Fixture("fx_money", "id int, text string, cell string, keyword string", [
    (1, "총액 1억 2,300만 원", "1억 2,300만", "총액"), (2, "예산 5천만원", "5천만", "예산"), (3, "합계: 12,000,000원 (VAT 별도)", "1,200만원", "합계"), (4, "단가 333,000원 × 2EA", "₩333,000", "단가"),
    (5, "금액 없음", "abc", "금액"), (6, "합계 2000개", "1 234 567", "합계"), (7, "비용 합계 9,999", "", "합계"), (8, "총계 10,000,000", "3.5억", "총계"), (9, None, None, "x"),
], also=("documents", "1000000 + doc_id", "text", "source", "lang"))


@query(f"""WITH {FX_MONEY.sql()}, i AS (SELECT id, unnest(regexp_extract_all(text, '((?:₩\\s*)?(?:\\d{{1,3}}(?:[,.\\s]\\d{{3}})+|\\d{{4,}}))\\s*(?:원)?\\s*[xX×＊]\\s*(\\d+)', 1)) AS p, unnest(regexp_extract_all(text, '((?:₩\\s*)?(?:\\d{{1,3}}(?:[,.\\s]\\d{{3}})+|\\d{{4,}}))\\s*(?:원)?\\s*[xX×＊]\\s*(\\d+)', 2)) AS q FROM fx_money)
SELECT id, CAST(regexp_replace(p, '\\D', '', 'g') AS BIGINT) AS price, CAST(q AS BIGINT) AS quantity FROM i""")
def line_items(spark, sf):
    return FX_MONEY.df(spark, sf).select("id", F.inline(M.line_items(F.col("text"))))


_N, _M = (7, 12, 150, 999, 1000, 12345, 2370000, 98765432), ("1.5", "3", "12", "0.25", "1,200")
_CELLS = [f(n) for n in _N for f in ("{:,}".format, "{}".format, "₩{:,} 원".format, "{:,}원".format, " {:,}.00 ".format, lambda n: f"{n:,}".replace(",", " "), "약 {}개".format)]
_CELLS += [f.format(m, n) for m in _M for n in _N for f in ("{0}억", "{0}억 {1}만", "{0}만원", "{0}천만원", "{0}백만", "{0} 억원", "총 {0}천만 {1}만")] + ["abc", "", "-", None]
FX_CELLS = Fixture("fx_cells", "id int, cell string", list(enumerate(_CELLS)), also=("documents", "1000000 + doc_id", "concat(n_chars, ' ')"))


def _unit_sql(unit: str, n: int) -> str:
    return f"coalesce(TRY_CAST(replace(regexp_extract(s, '([\\d,]+(?:\\.\\d+)?)\\s*{unit}', 1), ',', '') AS DECIMAL(24,4)) * {n}, 0)"


@query(f"""WITH {FX_CELLS.sql()}, s AS (SELECT id, regexp_replace(trim(cell), '(\\d)\\s+(\\d)', '\\1\\2', 'g') AS s FROM fx_cells)
SELECT id, CASE WHEN regexp_matches(s, '\\d\\s*(억|천만|백만|만)') THEN CAST(round({" + ".join(_unit_sql(u, n) for u, n in (("억", 10**8), ("천만", 10**7), ("백만", 10**6), ("만", 10**4)))}, 0) AS BIGINT)
 ELSE TRY_CAST(regexp_replace(regexp_replace(s, '[^\\d.]', '', 'g'), '\\..*$', '') AS BIGINT) END AS value FROM s""")
def normalize_number(spark, sf):
    return FX_CELLS.df(spark, sf).select("id", M.normalize_number(F.col("cell")).alias("value"))


_LABELS = ["합계", "총계:", "비용 합계 ", "합계(VAT 별도) :", "합계 검증", "소계", "합계 ₩", "총계 KRW "]
FX_TOTALS = Fixture("fx_totals", "id int, text string", list(enumerate([f"앞 줄\n{label} {n:,}{tail}" for label in _LABELS for n in (999, 9999, 10000, 1234567, 50000000) for tail in ("원", "개", "개월", " 개 입니다", ".", "")] + ["none", None])), also=("documents", "1000000 + doc_id", "text"))


@query(f"""WITH {FX_TOTALS.sql()}, f AS (SELECT id, text, replace(regexp_extract(regexp_replace(text, '합계\\s*검증', '__', 'g'), '(?:비용\\s*합계|합계\\s*\\(VAT\\s*별도\\)|합계|총계)\\s*[:\\s]*(?:₩|KRW)?\\s*([\\d\\.,]+)', 1), ',', '') AS f FROM fx_totals)
SELECT id, CASE WHEN NOT regexp_matches(text || ' ', '합계\\s*[\\d,]+\\s*개[^가-힣0-9A-Za-z_]') AND regexp_full_match(f, '\\d{{1,18}}') AND TRY_CAST(f AS BIGINT) >= 10000 THEN TRY_CAST(f AS BIGINT) END AS total FROM f""")
def claimed_total(spark, sf):
    return FX_TOTALS.df(spark, sf).select("id", M.claimed_total(F.col("text")).alias("total"))


FX_FINANCE = Fixture("fx_finance", "id int, unit bigint, quantity bigint, amount bigint, vat bigint, total bigint, mode string", [(1, 100, 2, 200, 20, 220, "excluded"), (2, 100, 2, 300, 20, 300, "included"), (3, 100, None, 100, None, 150, "none")], also=("lineitem", "l_orderkey % 1000000 + 1000", "floor(l_extendedprice / 50)", "floor(l_quantity)", "floor(l_extendedprice)", "floor(l_extendedprice * l_tax)", "floor(l_extendedprice * (1 + l_tax))", "l_returnflag"))


@query(f"WITH {FX_FINANCE.sql()} SELECT id, concat_ws(',', CASE WHEN abs(unit * quantity - amount) > abs(amount) * 0.05 THEN 'unit_x_quantity' END, CASE WHEN abs(vat * 10 - amount) > abs(amount) * 0.02 THEN 'vat' END, CASE WHEN abs(total - e) > abs(e) * 0.015 THEN 'total' END) AS failed FROM (SELECT *, CASE WHEN mode = 'excluded' THEN amount + coalesce(vat, 0) ELSE amount END AS e FROM fx_finance)")
def financial_consistency(spark, sf):
    failed = M.financial_consistency(*map(F.col, ("unit", "quantity", "amount", "vat", "total", "mode")))
    return FX_FINANCE.df(spark, sf).select("id", F.array_join(failed, ",").alias("failed"))


_DAYS = [(y, m, d) for y in (2019, 2024) for m in (1, 3, 10, 12) for d in (1, 5, 15, 31)]
_SHAPES = ["{0}/{1}/{2}", "{0}.{1}.{2}", "{0}-{1}-{2}", "{0}년 {1}월 {2}일", "{0}년{1}월{2}일", "{3}. {1}. {2}", "{0}{1:02d}{2:02d}", "({0}.{1}.{2}) 10:30", "{0}-{1}-{2} ~ {0}-12-31", "{3}-{1}-{2}"]
FX_DATES = Fixture("fx_dates", "id int, raw string", list(enumerate([f.format(y, m, d, y % 100) for f in _SHAPES for y, m, d in _DAYS] + ["soon", "", None])), also=("orders", "o_orderkey % 100000000 + 1000", "concat('', o_orderdate)"))


def _day_sql(p: str, century: str = "") -> str:
    return f"'{century}' || regexp_extract(s, '{p}', 1) || '-' || lpad(regexp_extract(s, '{p}', 2), 2, '0') || '-' || lpad(regexp_extract(s, '{p}', 3), 2, '0')"


_FOUR, _SIGNS, _TWO, _RUN, _SHORT = "^(\\d{4})\\s*년\\s*(\\d{1,2})\\s*월\\s*(\\d{1,2})\\s*일", "^(\\d{4})[-./](\\d{1,2})[-./](\\d{1,2})", "^(\\d{2})\\.\\s*(\\d{1,2})\\.\\s*(\\d{1,2})$", "^(20\\d{2})(\\d{2})(\\d{2})$", "^(\\d{2})-(\\d{1,2})-(\\d{1,2})$"


@query(f"""WITH {FX_DATES.sql()}, s AS (SELECT id, raw, trim(regexp_replace(trim(regexp_replace(raw, '[(){{}}\\[\\]]', ' ', 'g')), '\\s+\\d{{1,2}}:\\d{{2}}.*$', '')) AS s FROM fx_dates)
SELECT id, CASE WHEN regexp_matches(s, '{_FOUR}') THEN {_day_sql(_FOUR)} WHEN regexp_matches(s, '{_TWO}') THEN {_day_sql(_TWO, "20")} WHEN regexp_matches(s, '{_SIGNS}') THEN {_day_sql(_SIGNS)} WHEN regexp_matches(s, '{_RUN}') THEN {_day_sql(_RUN)} WHEN regexp_matches(s, '{_SHORT}') THEN {_day_sql(_SHORT, "20")} ELSE raw END AS date FROM s""")
def normalize_date(spark, sf):
    return FX_DATES.df(spark, sf).select("id", D.normalize_date(F.col("raw")).alias("date"))


@query(f"WITH {FX_FILES.sql()} SELECT doc_id, CASE WHEN regexp_matches(filename, '\\d{{4}}[-_]\\d{{2}}[-_]\\d{{2}}') THEN regexp_replace(regexp_extract(filename, '\\d{{4}}[-_]\\d{{2}}[-_]\\d{{2}}'), '_', '-', 'g') END AS date, CASE WHEN contains(filename, '구매') THEN '구매' WHEN contains(filename, '교체') THEN '수리' ELSE 'general' END AS category, replace(regexp_replace(regexp_replace(filename, '^\\d{{4}}-\\d{{2}}-\\d{{2}}_', ''), '\\.pdf$', '', 'i'), '_', ' ') AS title FROM fx_files")
def filename_metadata(spark, sf):
    from ..operators.catalog import category_of

    f = F.col("filename")
    return FX_FILES.df(spark, sf).select("doc_id", D.filename_date(f).alias("date"), category_of(f, {"구매": "구매", "교체": "수리"}).alias("category"), T.title_of(f).alias("title"))


RULES = {"purchase": (["구매", "price"], ["폐기"], 1.0), "repair": (["수리", "교체", "repair"], [], 1.2), "english": (["the", "and", "that"], ["der", "les"], 0.5), "german": (["der", "und", "nicht"], [], 0.5), "french": (["les", "des", "est"], [], 0.5)}
_SCORES = ", ".join(f"round((({' + '.join(f'CAST(contains(lower(text), {chr(39)}{w}{chr(39)}) AS INTEGER)' for w in yes)}) + 2 * ({' + '.join(f'CAST(contains(lower(source), {chr(39)}{w}{chr(39)}) AS INTEGER)' for w in yes)})) * {weight} - 2 * ({' + '.join(f'CAST(contains(lower(text), {chr(39)}{w}{chr(39)}) AS INTEGER)' for w in no) or '0'}), 6) AS {kind}" for kind, (yes, no, weight) in RULES.items())


@query(f"WITH s AS (SELECT doc_id, {_SCORES} FROM documents), b AS (SELECT doc_id, greatest({', '.join(RULES)}) AS best, CASE " + " ".join(f"WHEN {k} = greatest({', '.join(RULES)}) THEN '{k}'" for k in RULES) + " END AS name FROM s) SELECT doc_id, CASE WHEN best > 0 THEN name ELSE 'other' END AS name, CAST(greatest(best, 0) AS DOUBLE) AS score, round(greatest(best, 0) / (greatest(best, 0) + 1), 6) AS confidence FROM b")
def doctype_classify(spark, sf):
    scores = F.transform(D.doctype_scores(F.col("text"), F.col("source"), RULES), lambda s: F.struct(F.round(s["score"], 6).alias("score"), s["name"].alias("name")))
    return table(spark, sf, "documents").select("doc_id", D.doctype(scores).alias("d")).select("doc_id", "d.*")


WORDS = {"license": ["license", "copyright"], "contact": ["@", "phone"], "code": ["function", "return"]}


@query("SELECT doc_id, coalesce(nullif(concat_ws(' / ', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{c}' END" for c, w in WORDS.items()) + "), ''), 'other') AS category FROM documents")
def category_classify(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.categories(F.col("text"), WORDS).alias("category"))


FX_JSON = Fixture("fx_json", "id int, response string", [(1, '```json\n{"a": 1, "b": [1, 2,],}\n```'), (2, 'x {"s": "a } b"} y {"t": {"u": 2}} z'), (3, "none"), (4, '{"broken": '), (5, None)], also=("conversations", "1000000 + conv_id", "text"))


@query()
def json_blocks(spark, sf):
    return FX_JSON.df(spark, sf).select("id", D.last_json_block("response").alias("block"))


@query("""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS v, CASE o_orderkey % 4 WHEN 0 THEN [CAST(floor(o_totalprice) AS BIGINT), 7] WHEN 1 THEN [CAST(floor(o_totalprice * 1.05) AS BIGINT), CAST(floor(o_totalprice * 2) AS BIGINT)] WHEN 2 THEN [CAST(5 AS BIGINT)] ELSE CAST([] AS BIGINT[]) END AS src FROM orders),
n AS (SELECT *, list_sort(list_transform(src, lambda s: {'d': abs(s - v), 's': s}))[1] AS near FROM a), j AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN list_contains(src, v) THEN 'keep' WHEN near.d <= abs(v) * 0.1 THEN 'correct' ELSE 'remove' END AS action FROM n)
SELECT o_orderkey, action, CASE action WHEN 'keep' THEN v WHEN 'correct' THEN near.s END AS audited FROM j""")
def numeric_audit(spark, sf):
    """Prices of orders against what a source is made to say."""
    whole = lambda c: F.floor(c).cast("bigint")
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    source = F.when(k % 4 == 0, F.array(whole(p), F.lit(7).cast("bigint"))).when(k % 4 == 1, F.array(whole(p * 1.05), whole(p * 2))).when(k % 4 == 2, F.array(F.lit(5).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    found = D.audited(F.when(k % 11 != 0, whole(p)), source)
    return table(spark, sf, "orders").select("o_orderkey", found.alias("a")).select("o_orderkey", "a.action", F.col("a.value").alias("audited"))
