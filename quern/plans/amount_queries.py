"""Queries of amounts of money over documents, to which papers with amounts are added."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import amounts as A
from ..operators import tables as B
from ..sources.tables import table
from .registry import Fixture, query

_PARTS = ["총액 1억 2,300만 원", "예산 5천만원", "합계: 12,000,000원 (VAT 별도)", "단가 333,000원 × 2EA", "금액 없음", "합계 2000개", "비용 합계 9,999", "총계 10,000,000", "₩1 234 567", "3.5억", "120만", "견적 4500만, 합계 45.000.000", "x" * 70, "\n"]
FX_BILLS = Fixture("fx_bills", "doc_id bigint, text string", [(-1 - k, " ".join(_PARTS[(k * a + b) % len(_PARTS)] for a, b in ((1, 0), (5, 3), (3, 7), (11, 2)))) for k in range(60)] + [(-100, None), (-101, ""), (-102, "총액 7,000 x " * 400), (-103, "합계 합계 5000 단가 6000 총액"), (-104, "12,345 12,345")])
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
KEYWORDS = ["총액", "합계", "견적", "단가", "금액", "total", "price"]


def _bills(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").unionByName(FX_BILLS.df(spark))


def places_sql(name: str, pattern: str, groups: int = 0, source: str = "bills") -> str:
    """Tables ``name`` (doc_id, s, e, g0, g1, ...) of the places of matches."""
    found = ", ".join(f"regexp_extract_all(text, '{pattern}', {g}) AS m{g}" for g in range(groups + 1))
    gap = "list_sum(list_transform(gaps[1:k], lambda x: length(x)))"
    seen = "coalesce(list_sum(list_transform(m0[1:k - 1], lambda x: length(x))), 0)"
    return f"""{name}_cut AS (SELECT doc_id, text, string_split_regex(text, '{pattern}') AS gaps, {found} FROM {source}),
{name} AS (SELECT doc_id, text, CAST({gap} + {seen} AS BIGINT) AS s, CAST({gap} + {seen} + length(m0[k]) AS BIGINT) AS e, {", ".join(f"m{g}[k] AS g{g}" for g in range(groups + 1))}
  FROM (SELECT *, unnest(range(1, len(m0) + 1)) AS k FROM {name}_cut))"""


_VALUE = "CAST(round_even(CASE WHEN replace({0}, ',', '') = '' THEN 0 ELSE TRY_CAST(replace({0}, ',', '') AS DECIMAL(28, 6)) END * {1}, 0) AS BIGINT)"
_NUMBER = r"([\p{Nd},]+(?:\.\p{Nd}+)?)"
_WON = rf"(?:₩{_SPACE}*)?(?:\p{{Nd}}{{1,3}}(?:(?:[,.]|{_SPACE})\p{{Nd}}{{3}})+|\p{{Nd}}{{4,}}){_SPACE}*(?:원)?"
_AMOUNTS = f"""{FX_BILLS.sql()},
bills AS (SELECT doc_id, coalesce(text, '') AS text FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM fx_bills)),
{places_sql("eok", f"{_NUMBER}{_SPACE}*억(?:{_SPACE}*{_NUMBER}{_SPACE}*만)?", 2)},
{places_sql("man", f"{_NUMBER}{_SPACE}*만", 1)},
{places_sql("won", _WON)},
spans AS (
  SELECT doc_id, {_VALUE.format("g1", 100000000)} + {_VALUE.format("coalesce(g2, '')", 10000)} AS value, s, e, CASE WHEN {_VALUE.format("coalesce(g2, '')", 10000)} > 0 THEN 'eok+man' ELSE 'eok' END AS kind FROM eok
), units AS (
  SELECT * FROM spans WHERE value >= 1000
  UNION ALL SELECT doc_id, {_VALUE.format("g1", 10000)}, s, e, 'man' FROM man m
  WHERE NOT regexp_matches(substr(text, e + 1, 1), '[가-힣\\p{{L}}\\p{{N}}_]') AND {_VALUE.format("g1", 10000)} >= 1000 AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.doc_id = m.doc_id AND x.s <= m.s AND m.s < x.e)
), plain AS (
  SELECT doc_id, TRY_CAST(regexp_replace(g0, '[^\\p{{Nd}}]', '', 'g') AS BIGINT) AS value, s, e, 'krw' AS kind FROM won w
  WHERE NOT regexp_matches(substr(text, s, 1), '\\p{{Nd}}') AND NOT EXISTS (SELECT 1 FROM units x WHERE x.doc_id = w.doc_id AND x.s <= w.s AND w.s < x.e)
), amounts AS (SELECT * FROM units UNION ALL SELECT * FROM plain WHERE value >= 1000)"""


@query(f'WITH {_AMOUNTS} SELECT doc_id, value, s AS start, e AS "end", kind FROM amounts')
def amount_candidates(spark, sf):
    return A.amounts(A.with_key(_bills(spark, sf))).select("doc_id", "value", "start", "end", "kind")


_WORDS = ", ".join(f"({n}, '{w}')" for n, w in enumerate(KEYWORDS))
_PLACED = ", ".join(places_sql(f"word{n}", f"(?i){w}") for n, w in enumerate(KEYWORDS))


@query(f"""WITH {_AMOUNTS}, {_PLACED},
words AS ({" UNION ALL ".join(f"SELECT doc_id, s AS place, {n} AS n FROM word{n}" for n in range(len(KEYWORDS)))}),
near AS (SELECT a.*, abs(a.s - w.place) AS distance, w.n, row_number() OVER (PARTITION BY a.doc_id, a.s, a.kind ORDER BY abs(a.s - w.place), w.n) AS turn FROM amounts a JOIN words w USING (doc_id)),
sure AS (
  SELECT doc_id, value, s, e, kind, substr(b.text, greatest(s - 40, 0) + 1, e + 40 - greatest(s - 40, 0)) AS context, distance,
    round(least(1.0, CASE WHEN n IN (0, 1) THEN 1.5 WHEN n = 3 THEN 0.8 ELSE 1.0 END::DOUBLE / (1 + distance) * (1 + CAST(s AS DOUBLE) / length(b.text) * 0.1)), 9) AS confidence
  FROM near JOIN bills b USING (doc_id) WHERE turn = 1 AND distance <= 80)
SELECT doc_id, value, s AS start, e AS "end", kind, context, distance, confidence FROM sure
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, CASE kind WHEN 'man' THEN 1 WHEN 'krw' THEN 2 ELSE 0 END, s) = 1""")
def nearest_amount(spark, sf):
    return A.nearest_amounts(_bills(spark, sf), KEYWORDS)


@query(f"""WITH {_AMOUNTS},
items AS (SELECT doc_id, unnest(regexp_extract_all(text, '((?:₩\\s*)?(?:\\d{{1,3}}(?:[,.\\s]\\d{{3}})+|\\d{{4,}}))\\s*(?:원)?\\s*[xX×＊]\\s*(\\d+)', 1)) AS p, unnest(regexp_extract_all(text, '((?:₩\\s*)?(?:\\d{{1,3}}(?:[,.\\s]\\d{{3}})+|\\d{{4,}}))\\s*(?:원)?\\s*[xX×＊]\\s*(\\d+)', 2)) AS q FROM bills),
totals AS (SELECT doc_id, sum(price * n) AS total FROM (SELECT doc_id, TRY_CAST(regexp_replace(p, '\\D', '', 'g') AS BIGINT) AS price, TRY_CAST(q AS BIGINT) AS n FROM items) WHERE price BETWEEN 10000 AND 5000000 AND n BETWEEN 1 AND 50 GROUP BY doc_id HAVING sum(price * n) BETWEEN 100000 AND 50000000),
middle AS (SELECT doc_id, value FROM (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY value) AS turn, count(*) OVER (PARTITION BY doc_id) AS n FROM amounts WHERE value >= 10000 AND value < 10000000) WHERE turn = n // 2 + 1)
SELECT doc_id, CASE WHEN coalesce(total, value) BETWEEN 1000 AND 99999999 THEN CAST(coalesce(total, value) AS BIGINT) END AS amount FROM bills LEFT JOIN totals USING (doc_id) LEFT JOIN middle USING (doc_id)""")
def document_amount(spark, sf):
    return A.document_amounts(_bills(spark, sf))


# --- cost tables: papers with tables among the documents, some with misspelt headers, sums that differ and rows without amounts ---

_HEADS = ["품명  수량  단가  금액", "품목\t\t수량  \t금액", "모 델  비 고", "번호  수 량  가격", "수량 | 단가", "품명  규격  금액  합계  비고", "없음"]
_ROWS = [["렌즈  2  1,000  2,000", "마이크  1  500  500"], ["A  3  1.2만  ", "B  2  500"], ["", "케이블  10  300  ", "x", "뒤  1  1  1"], ["가  1,000", "합계  9,999", "나  2,000"], ["한 칸"], []]
_TAILS = ["합계: 2,500원", "총계 100,000\nVAT: 250", "합계: 12,500원 부가세 : 1만원", ""]
FX_BOOKS = Fixture("fx_books", "doc_id bigint, text string", [(-1 - k, "\n".join(["앞 줄", h, *r, "", t])) for k, (h, r, t) in enumerate((h, r, t) for h in _HEADS for r in _ROWS for t in _TAILS)] + [(-999, None)])
_KEYS = "|".join(f".{a}{b}|{a}.{b}|{a}{b}." for a, b in B.KEYS)
_CELLS = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '[|\\t]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]{{2,}}', '  ', 'g'), '  '), lambda c: trim(c)), lambda c: c <> '')"
_NUM = "TRY_CAST(replace(nullif(regexp_extract({0}, '{1}', 1), ''), ',', '') AS DECIMAL(24, 4))"
_PARSED = """CASE WHEN regexp_matches({0}, '[0-9]\\s*(억|천만|백만|만)') THEN CAST(round(%s, 0) AS BIGINT)
  ELSE TRY_CAST(nullif(regexp_replace(regexp_replace(regexp_replace({0}, '[^0-9.]', '', 'g'), '\\..*$', ''), '[^0-9]', '', 'g'), '') AS BIGINT) END""" % " + ".join(f"coalesce({_NUM.format('{0}', '([0-9,]+(?:\\.[0-9]+)?)\\s*' + u)} * {n}, 0)" for u, n in (("억", 10**8), ("천만", 10**7), ("백만", 10**6), ("만", 10**4))).replace("{{0}}", "{0}")


def _number(cell: str) -> str:
    return _PARSED.replace("{0}", f"regexp_replace(regexp_replace(trim({cell}), '([0-9])\\s+([0-9])', '\\1\\2', 'g'), '([0-9])\\s+([0-9])', '\\1\\2', 'g')")


def _place(kind: str) -> str:
    case = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in B.COLUMNS) + " END"
    return f"list_max(list_transform(range(1, len(header) + 1), lambda i: CASE WHEN list_transform(header, lambda x: {case})[i] = '{kind}' THEN i END))"


_CLAIM = r"(?:비용\s*합계|합계\s*\(VAT\s*별도\)|합계|총계)\s*[:\s]*(?:₩|KRW)?\s*([\d\.,]+)"


@query(f"""WITH {FX_BOOKS.sql()},
books AS (SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS lines FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM fx_books)),
lined AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM books),
celled AS (SELECT *, {_CELLS.format("line")} AS cells FROM lined),
scored AS (SELECT *, CASE WHEN len(cells) BETWEEN 2 AND 10 AND pos <= 300 THEN CASE WHEN kinds > 0 THEN kinds WHEN near THEN 0.8 ELSE 0 END ELSE 0 END AS score FROM (
  SELECT *, {" + ".join(f"CAST(regexp_matches(line, '{p}') AS INTEGER)" for p in B.HEADERS)} AS kinds, len(list_filter(cells, lambda c: regexp_full_match(c, '{_KEYS}'))) > 0 AS near FROM celled)),
heads AS (SELECT doc_id, pos AS h, cells AS header FROM scored WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1),
starts AS (SELECT doc_id, h, header, min(pos) FILTER (len(cells) >= 2) AS s FROM heads JOIN celled USING (doc_id) WHERE pos > h GROUP BY ALL),
stops AS (SELECT doc_id, h, header, s, min(pos) FILTER (len(cells) < 2) AS fewer, min(pos) FILTER (regexp_matches(line, '{B.ENDS}')) AS ends FROM starts JOIN celled USING (doc_id) WHERE pos >= s GROUP BY ALL),
placed AS (SELECT *, {", ".join(f"{_place(n)} AS {n}_at" for n, _ in B.COLUMNS)} FROM stops),
parsed AS (SELECT doc_id, pos, coalesce(CASE WHEN name_at <= len(cells) THEN cells[name_at] END, cells[1]) AS name, {", ".join(f"CASE WHEN {n}_at <= len(cells) THEN {_number(f'cells[{n}_at]')} END AS {n}" for n in ("quantity", "unit_price", "amount"))}
  FROM placed JOIN celled USING (doc_id) WHERE pos >= s AND pos < coalesce(fewer, 1000000000) AND pos <= coalesce(ends, 1000000000)),
items AS (SELECT doc_id, count(*) AS n_items, md5(string_agg(concat_ws('/', name, coalesce(CAST(quantity AS VARCHAR), '-'), coalesce(CAST(unit_price AS VARCHAR), '-'), coalesce(CAST(coalesce(amount, quantity * unit_price) AS VARCHAR), '-')), chr(10) ORDER BY pos)) AS items,
  CAST(sum(coalesce(amount, quantity * unit_price, 0)) AS BIGINT) AS total FROM parsed GROUP BY doc_id),
sums AS (SELECT doc_id, CASE WHEN regexp_matches(text, '합계\\s*[\\d,]+\\s*개(?:[^가-힣\\w]|$)') THEN NULL WHEN TRY_CAST(replace(regexp_extract(text, '{_CLAIM}', 1), ',', '') AS BIGINT) >= 10000 AND regexp_full_match(replace(regexp_extract(text, '{_CLAIM}', 1), ',', ''), '[0-9]+') THEN TRY_CAST(replace(regexp_extract(text, '{_CLAIM}', 1), ',', '') AS BIGINT) END AS claimed,
  {_number("nullif(regexp_extract(text, '" + B.VAT + "', 1) || regexp_extract(text, '" + B.VAT + "', 2), '')")} AS vat FROM books),
judged AS (SELECT doc_id, array_to_string(header, '/') AS header, coalesce(n_items, 0) AS n_items, coalesce(items, md5('')) AS items, coalesce(total, 0) AS total, CASE WHEN n_items > 0 THEN claimed END AS claimed_total, CASE WHEN n_items > 0 THEN vat END AS vat,
  CASE WHEN n_items > 0 THEN claimed IS NULL OR (abs(total - claimed) <= greatest(1, floor(claimed * 0.01)) AND (vat IS NULL OR abs(total + vat - claimed) <= greatest(1, floor(claimed * 0.01)))) END AS sum_match
  FROM books LEFT JOIN heads USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN sums USING (doc_id))
SELECT *, CASE WHEN header IS NULL THEN 'failed' WHEN n_items = 0 OR NOT sum_match THEN 'partial' ELSE 'success' END AS parse_status, CASE WHEN header IS NULL THEN 'header_not_found' WHEN n_items = 0 THEN 'items_empty' WHEN NOT sum_match THEN 'sum_mismatch' END AS reason FROM judged""")
def table_parse(spark, sf):
    books = table(spark, sf, "documents").select("doc_id", "text").unionByName(FX_BOOKS.df(spark))
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    line = lambda x: F.concat_ws("/", x["name"], dash(x["quantity"]), dash(x["unit_price"]), dash(x["amount"]))
    out = B.cost_tables(books)
    return out.withColumns({"n_items": F.size("items").cast("bigint"), "items": F.md5(F.array_join(F.transform("items", line), "\n")), "header": F.array_join("header", "/")})


@query(f"""WITH {_AMOUNTS},
items AS (SELECT doc_id, unnest(regexp_extract_all(text, '((?:₩\\s*)?(?:\\d{{1,3}}(?:[,.\\s]\\d{{3}})+|\\d{{4,}}))\\s*(?:원)?\\s*[xX×＊]\\s*(\\d+)', 1)) AS p, unnest(regexp_extract_all(text, '((?:₩\\s*)?(?:\\d{{1,3}}(?:[,.\\s]\\d{{3}})+|\\d{{4,}}))\\s*(?:원)?\\s*[xX×＊]\\s*(\\d+)', 2)) AS q FROM bills),
totals AS (SELECT doc_id, sum(price * n) AS total FROM (SELECT doc_id, TRY_CAST(regexp_replace(p, '\\D', '', 'g') AS BIGINT) AS price, TRY_CAST(q AS BIGINT) AS n FROM items) WHERE price BETWEEN 10000 AND 5000000 AND n BETWEEN 1 AND 50 GROUP BY doc_id HAVING sum(price * n) BETWEEN 100000 AND 50000000),
middle AS (SELECT doc_id, value FROM (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY value) AS turn, count(*) OVER (PARTITION BY doc_id) AS n FROM amounts WHERE value >= 10000 AND value < 10000000) WHERE turn = n // 2 + 1),
found AS (SELECT doc_id, CAST(coalesce(total, value) AS BIGINT) AS total FROM bills LEFT JOIN totals USING (doc_id) LEFT JOIN middle USING (doc_id) WHERE coalesce(total, value) BETWEEN 1000 AND 99999999),
rows_ AS (SELECT doc_id, total, 'validated_total' AS kind, total AS amount, 0 AS position FROM found
  UNION ALL SELECT doc_id, NULL, 'candidate', value, s FROM amounts WHERE doc_id NOT IN (SELECT doc_id FROM found))
SELECT doc_id, total, kind, amount, '₩' || format('{{:,}}', amount) AS formatted, CAST(position AS INTEGER) AS position, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY amount DESC, position) AS INTEGER) AS turn FROM rows_""")
def prose_amounts(spark, sf):
    return A.prose_amounts(_bills(spark, sf))


# Lines of a target file made of the documents: every third has a line, every fifth of these a comment, every seventh no path; and two of unknown ids.
_LINES = """lines AS (SELECT CASE WHEN doc_id % 5 = 0 THEN '# ' ELSE '  ' END || doc_id || CASE WHEN doc_id % 7 = 0 THEN '' ELSE chr(9) || ' ' || source || '.pdf ' END AS value FROM (SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, 'bill' FROM fx_bills) WHERE doc_id % 3 = 0
  UNION ALL VALUES (''), ('123456789' || chr(9) || 'gone.pdf'))"""


@query(f"""WITH {_AMOUNTS}, {_LINES},
targets AS (SELECT DISTINCT CAST(trim(string_split(trim(value), chr(9))[1]) AS BIGINT) AS doc_id FROM lines WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#') AND len(string_split(trim(value), chr(9))) >= 2),
items AS (SELECT doc_id, unnest(regexp_extract_all(text, '((?:₩\\s*)?(?:\\d{{1,3}}(?:[,.\\s]\\d{{3}})+|\\d{{4,}}))\\s*(?:원)?\\s*[xX×＊]\\s*(\\d+)', 1)) AS p, unnest(regexp_extract_all(text, '((?:₩\\s*)?(?:\\d{{1,3}}(?:[,.\\s]\\d{{3}})+|\\d{{4,}}))\\s*(?:원)?\\s*[xX×＊]\\s*(\\d+)', 2)) AS q FROM bills),
totals AS (SELECT doc_id, sum(price * n) AS total FROM (SELECT doc_id, TRY_CAST(regexp_replace(p, '\\D', '', 'g') AS BIGINT) AS price, TRY_CAST(q AS BIGINT) AS n FROM items) WHERE price BETWEEN 10000 AND 5000000 AND n BETWEEN 1 AND 50 GROUP BY doc_id HAVING sum(price * n) BETWEEN 100000 AND 50000000),
middle AS (SELECT doc_id, value FROM (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY value) AS turn, count(*) OVER (PARTITION BY doc_id) AS n FROM amounts WHERE value >= 10000 AND value < 10000000) WHERE turn = n // 2 + 1),
anew AS (SELECT doc_id, CASE WHEN coalesce(total, value) BETWEEN 1000 AND 99999999 THEN CAST(coalesce(total, value) AS BIGINT) END AS amount FROM bills LEFT JOIN totals USING (doc_id) LEFT JOIN middle USING (doc_id))
SELECT b.doc_id, CASE WHEN t.doc_id IS NULL THEN length(b.text) ELSE a.amount END AS amount, CASE WHEN t.doc_id IS NOT NULL THEN a.amount IS NOT NULL END AS ok FROM bills b JOIN anew a USING (doc_id) LEFT JOIN targets t USING (doc_id)
UNION ALL SELECT doc_id, NULL, false FROM targets WHERE doc_id NOT IN (SELECT doc_id FROM bills)""")
def reindexed_amounts(spark, sf):
    """Every document with the amount it had (its length) or, if it is a target, the one found anew."""
    bills = _bills(spark, sf).withColumn("amount", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    named = table(spark, sf, "documents").select("doc_id", "source").unionByName(FX_BILLS.df(spark).select("doc_id", F.lit("bill").alias("source"))).filter("doc_id % 3 = 0")
    path = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("\t "), "source", F.lit(".pdf ")))
    lines = named.select(F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("# ")).otherwise(F.lit("  ")), F.col("doc_id").cast("string"), path).alias("value"))
    lines = lines.unionByName(spark.createDataFrame([("",), ("123456789\tgone.pdf",)], "value string"))
    out, report = A.reindexed(bills, A.reindex_targets(lines))
    return out.select("doc_id", "amount").join(report.select("doc_id", "ok"), "doc_id", "full")


@query("SELECT doc_id, source || '-' || doc_id AS code, ' ' || upper(source || doc_id) || ' ' AS padded_norm FROM documents")
def padded_codes(spark, sf):
    codes = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("code"), F.upper(F.concat("source", F.col("doc_id").cast("string"))).alias("norm_code"))
    return A.padded_codes(codes).select("doc_id", "code", "padded_norm")
