"""Queries of document metadata over a few hundred generated documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..sources.tables import table
from .registry import Fixture, query
from .understanding_queries import TODAY, _list, _text

_LEADS = ["기안자: 김하늘\n기안일자: 2024-3-5", "작성자 이바다 팀장\n2023.11.05 작성", "제목: 렌즈 교체 검토의 건\n2022년 1월 9일", "회의록\n참석자: 셋\n안건: 카메라부 장비", "부서: 영상편집팀\n소속: 기술", ""]
_BODIES = ["노후 장비의 고장으로 교체가 필요합니다. 수명 경과, 장애 다수!\n모델 LVM-180A 카메라", "소모품 구매의 건\n품목 수량 단가 금액\n납품업체: 한빛 미디어(주)", "견적 비교 결과 선정\n업체명: 12-34", "폐기 대상: HP Z840, 모니터", "점검 일정만 적습니다 short."]
_SUMS = ["총액: 1,650,000원\nVAT: 165,000원", "합계 : 3억", "금액 2.5만 원 예정", "소계: 12,000,000 (부가세 별도)", "1.5억 견적, 300,000,000원 한도", "없음"]
_FILES = ["2024-03-01_렌즈_구매.pdf", "2023-11-05_기술부_김하늘_카메라 수리.pdf", "notes.txt", "2022_점검 1_x.pdf"]
FX_PAPERS = Fixture("fx_papers", "id int, text string, filename string, drafter string", [
    (k, "\n".join(x for x in p if x), _FILES[k % 4], (None, "", "박나무", "홍")[k // 4 % 4]) for k, p in enumerate((a, b, c) for a in _LEADS for b in _BODIES for c in _SUMS)
], also=("documents", "1000000 + doc_id", "text", "concat(source, '_', lang, '.pdf')", "source"))
_P = f"WITH {FX_PAPERS.sql()}"


def _papers(spark, sf):
    return FX_PAPERS.df(spark, sf)


def _rx(pattern: str, group: int = 1, column: str = "text") -> str:
    return f"nullif(regexp_extract({column}, {_text(pattern)}, {group}), '')"


def _has(pattern: str, column: str = "text") -> str:
    return f"regexp_matches({column}, {_text(pattern)})"


def _first(pairs, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in pairs) + f" ELSE {otherwise} END"


def _words(column: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({column}, w))) > 0"


_DAYS = "list_transform(regexp_extract_all(text, '(?:19|20)\\d{2}[-./]\\d{1,2}[-./]\\d{1,2}'), lambda x: regexp_split_to_array(x, '[-./]'))"


@query(f"""{_P} SELECT id, list_reverse_sort(list_distinct(list_transform(list_filter({_DAYS}, lambda p: CAST(p[1] AS INTEGER) BETWEEN 1990 AND 2035 AND CAST(p[2] AS INTEGER) BETWEEN 1 AND 12 AND CAST(p[3] AS INTEGER) BETWEEN 1 AND 31), lambda p: p[1] || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[3], 2, '0')))) AS days FROM fx_papers""")
def all_dates(spark, sf):
    return _papers(spark, sf).select("id", M.all_days(F.col("text")).alias("days"))


def _dept_sql() -> str:
    pairs = []
    for p, bare in M.DEPARTMENTS:
        name = f"regexp_extract(text, {_text(p)}, 1)"
        pairs.append((_has(p), f"CASE WHEN regexp_matches({name}, '부|팀|실|과|센터|본부') THEN {name} ELSE {name} || '부' END" if bare else name))
    return _first(pairs)


@query(f"{_P} SELECT id, {_dept_sql()} AS department, {_first([(_words('lower(text)', w), _text(n)) for n, w in M.TYPES])} AS type, {_first([(_words('lower(text)', w), _text(n)) for n, w in M.SIMPLE_TYPES], _text('기타문서'))} AS simple_type, coalesce({', '.join(_rx(p) for p in M.DRAFTERS)}) AS drafter FROM fx_papers")
def department_and_type(spark, sf):
    t = F.col("text")
    return _papers(spark, sf).select("id", M.department(t).alias("department"), M.type_by_words(t).alias("type"), M.type_by_words(t, M.SIMPLE_TYPES, "기타문서").alias("simple_type"), M.drafter(t).alias("drafter"))


@query(f"""{_P}, n AS (SELECT id, unnest(list_filter(regexp_split_to_array(text || chr(10) || 'Lee JH' || chr(10) || '김하늘' || chr(10) || 'J. Kim 7', '\\n'), lambda x: x <> '')) AS name FROM fx_papers)
SELECT id, name, NOT regexp_matches(trim(name), '{'|'.join(M.NO_AUTHOR)}') AND trim(name) <> '' AND (regexp_full_match(trim(name), '[가-힣]{{2,4}}') OR regexp_full_match(trim(name), '[A-Za-z][A-Za-z.\\- ,]{{1,30}}')) AS valid FROM n""")
def author_validation(spark, sf):
    more = F.concat_ws("\n", F.col("text"), F.lit("Lee JH"), F.lit("김하늘"), F.lit("J. Kim 7"))
    names = _papers(spark, sf).select("id", F.explode(F.filter(F.split(more, "\n"), lambda x: x != "")).alias("name"))
    return names.select("id", "name", M.is_author(F.col("name")).alias("valid"))


def _tagged_date_sql() -> str:
    of = lambda p, c: f"regexp_extract({c}, {_text(p)}, 1) || '-' || lpad(regexp_extract({c}, {_text(p)}, 2), 2, '0') || '-' || lpad(regexp_extract({c}, {_text(p)}, 3), 2, '0')"
    own = [(p, "text", f"text_{m}", c) for p, m, c in M.DATES] + [(r"(20\d{2})[-_](0?[1-9]|1[0-2])[-_](0?[1-9]|[12]\d|3[01])", "filename", "filename_fallback", 0.8)]
    return f"{_first([(_has(p, c), of(p, c)) for p, c, _, _ in own], _text(TODAY))} AS value, {_first([(_has(p, c), _text(m)) for p, c, m, _ in own], _text('current_date_fallback'))} AS method, CAST({_first([(_has(p, c), str(x)) for p, c, _, x in own], '0.1')} AS DOUBLE) AS confidence"


@query(f"{_P} SELECT id, {_tagged_date_sql()} FROM fx_papers")
def tagged_date(spark, sf):
    return _papers(spark, sf).select("id", M.tagged_date(F.col("text"), F.col("filename"), F.to_date(F.lit(TODAY))).alias("d")).select("id", "d.*")


_AMOUNT = {p: f"TRY_CAST(replace({_rx(p)}, ',', '') AS BIGINT)" for p, _, _ in M.AMOUNTS}


@query(f"{_P} SELECT id, {_first([(f'{_AMOUNT[p]} BETWEEN 1000 AND 1000000000', _AMOUNT[p]) for p, _, _ in M.AMOUNTS])} AS value, {_first([(f'{_AMOUNT[p]} BETWEEN 1000 AND 1000000000', _text(m)) for p, m, _ in M.AMOUNTS], _text(''))} AS method, CAST({_first([(f'{_AMOUNT[p]} BETWEEN 1000 AND 1000000000', str(c)) for p, _, c in M.AMOUNTS], '0.0')} AS DOUBLE) AS confidence FROM fx_papers")
def tagged_amount(spark, sf):
    return _papers(spark, sf).select("id", M.tagged_amount(F.col("text")).alias("a")).select("id", "a.*")


def _title_sql() -> str:
    clean = lambda p: f"trim(regexp_replace(regexp_replace({_rx(p)}, '[^\\p{{L}}\\p{{N}}_\\s\\-&().]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"coalesce({', '.join(f'CASE WHEN length({clean(p)}) BETWEEN 5 AND 100 THEN {clean(p)} END' for p, _ in M.TITLES)})"


def _vendor_sql() -> str:
    clean = lambda p: f"trim(regexp_replace(regexp_replace({_rx(p)}, '\\s+', ' ', 'g'), '^[()]+|[()]+$', '', 'g'))"
    return f"coalesce({', '.join(f'CASE WHEN length({clean(p)}) >= 2 AND NOT regexp_matches({clean(p)}, {_text(chr(94) + chr(91) + chr(92) + chr(100) + chr(92) + chr(115) + chr(92) + chr(45) + chr(93) + chr(43) + chr(36))}) THEN {clean(p)} END' for p, _ in M.VENDORS)})"


@query(f"{_P} SELECT id, {_title_sql()} AS title, {_vendor_sql()} AS vendor, list_sort(list_distinct(flatten([{', '.join(f'regexp_extract_all(text, {_text(p)}, 1)' for p in M.GEAR)}]))) AS gear FROM fx_papers")
def title_vendor_gear(spark, sf):
    t = F.col("text")
    return _papers(spark, sf).select("id", M.title(t).alias("title"), M.vendor(t).alias("vendor"), F.array_sort(M.gear(t)).alias("gear"))


def _money_sql(c: str) -> str:
    eok, man = (f"CAST(nullif(regexp_extract({c}, {_text(M.UNITS)}, {g}), '') AS DECIMAL(20,4)) * {n}" for g, n in ((1, 10**8), (2, 10**4)))
    return f"coalesce(CAST(round(coalesce({eok}, {man}), 0) AS BIGINT), TRY_CAST(replace(nullif(regexp_extract({c}, {_text(M.WON)}, 1), ''), ',', '') AS BIGINT))"


@query(f"""{_P}, w AS (SELECT id, text, nullif(regexp_extract(text, '(?is)((?:합계|총액|견적|금액).{{0,160}})', 1), '') AS near FROM fx_papers)
SELECT id, {_money_sql('text')} AS first_money, {_has(M.DECISIONS)} AS decided, CAST(coalesce({', '.join(f"CAST(round(TRY_CAST(replace({_rx(p)}, ',', '') AS DECIMAL(24,4)) * CASE WHEN starts_with(coalesce({_rx(p, 2)}, '원'), '억') THEN 100000000 WHEN starts_with(coalesce({_rx(p, 2)}, '원'), '만') THEN 10000 ELSE 1 END, 0) AS BIGINT)" for p in M.TOTAL_LABELS)}) AS BIGINT) AS claimed,
 CAST(TRY_CAST(replace({_rx(M.VAT_LABEL)}, ',', '') AS DECIMAL(24,4)) AS BIGINT) AS vat FROM w""")
def money_in_prose(spark, sf):
    t = F.col("text")
    return _papers(spark, sf).select("id", M.money(t).alias("first_money"), t.rlike(M.DECISIONS).alias("decided"), M.labelled(t, M.TOTAL_LABELS).alias("claimed"), M.labelled(t, [M.VAT_LABEL]).alias("vat"))


def _bounded(pattern: str) -> str:
    """Word boundaries of all letters, not of ASCII alone."""
    return pattern.replace(r"\bAS\b", r"(?:^|[^\p{L}\p{N}_])AS(?:[^\p{L}\p{N}_]|$)")


_KIND = f"lower(filename || chr(10) || left(text, 2000))"


@query(f"{_P}, s AS (SELECT id, text, {_KIND} AS s FROM fx_papers) SELECT id, CASE WHEN {_has(M.MINUTES_SIGN, 's')} AND len(list_filter({_list(M.MINUTES)}, lambda w: contains(s, w))) >= 2 THEN 'minutes' ELSE {_first([(_has(_bounded(p), 's'), _text(n)) for n, p in M.KINDS], _text('generic'))} END AS kind, list_filter([{', '.join(f'CASE WHEN {_has(p)} THEN {_text(p)} END' for p in M.HEADERS)}], lambda x: x IS NOT NULL) AS headers FROM s")
def document_kind(spark, sf):
    return _papers(spark, sf).select("id", M.document_kind(F.col("filename"), F.col("text")).alias("kind"), M.found_headers(F.col("text")).alias("headers"))


@query(f"""{_P}, p AS (SELECT id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: trim(s)), lambda s: length(s) BETWEEN 8 AND 240 AND {_words('s', M.REASONS)}) AS ps FROM fx_papers),
u AS (SELECT id, unnest(ps) AS s, unnest(range(len(ps))) AS i FROM p), r AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY len(list_filter({_list(M.REASONS)}, lambda w: contains(s, w))) * 2.0 + least(length(s), 160) / 160.0 DESC, i) AS n FROM u)
SELECT id, s AS reason FROM fx_papers LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (id)""")
def replacement_reason(spark, sf):
    return _papers(spark, sf).select("id", M.reason(F.col("text")).alias("reason"))


@query(f"""{_P}, f AS (SELECT id, filename, drafter, string_split(filename, '_') AS p FROM fx_papers), n AS (SELECT *, list_filter([p[2], p[3]], lambda x: x IS NOT NULL AND length(x) BETWEEN 2 AND 4 AND NOT regexp_matches(x, '\\d') AND NOT contains(x, '기술')) AS g FROM f)
SELECT id, coalesce(nullif(trim(drafter), ''), g[1], CASE WHEN id % 3 = 0 THEN '영상팀' END, '미확인') AS drafter FROM n""")
def drafter_resolution(spark, sf):
    dept = F.when(F.col("id") % 3 == 0, "영상팀").otherwise("")
    return _papers(spark, sf).select("id", M.resolved_drafter(F.col("drafter"), F.col("filename"), dept, ("기술",)).alias("drafter"))


@query(f"""{_P}, d AS (SELECT id, drafter, CASE id % 4 WHEN 0 THEN '2024. 3. 5' WHEN 1 THEN '2023/11/5' WHEN 2 THEN '20220109' END AS a, CASE id % 3 WHEN 0 THEN '2024-03-09 10:20' END AS b, filename FROM fx_papers),
n AS (SELECT id, drafter, CASE id % 4 WHEN 0 THEN '2024. 3. 5' WHEN 1 THEN '2023-11-05' WHEN 2 THEN '2022-01-09' END AS a, CASE WHEN b IS NOT NULL THEN '2024-03-09' END AS b, regexp_extract(filename, '^(20\\d{{2}}-\\d{{2}}-\\d{{2}})', 1) AS f FROM d),
s AS (SELECT id, drafter, coalesce(a, b, '{M.NONE}') AS display, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ' / ' || b ELSE coalesce(a, b, '{M.NONE}') END AS detail FROM n)
SELECT id, display, '**기안자/부서:** ' || coalesce(drafter, '{M.NONE}') || ' / ' || '{M.NONE}' || chr(10) || '**기안일자 / 시행일자:** ' || detail || chr(10) || '**유형/카테고리:** 구매' || CASE WHEN id % 2 = 0 THEN chr(10) || '**문서번호:** N-' || id ELSE '' END AS shown FROM s""")
def metadata_display(spark, sf):
    draft = F.expr("CASE id % 4 WHEN 0 THEN '2024. 3. 5' WHEN 1 THEN '2023/11/5' WHEN 2 THEN '20220109' END")
    df = _papers(spark, sf).withColumn("d", M.dates_of(draft, F.when(F.col("id") % 3 == 0, "2024-03-09 10:20"), F.lit("notes.txt")))
    number = F.when(F.col("id") % 2 == 0, F.concat(F.lit("N-"), F.col("id").cast("string")))
    return df.select("id", "d.display", M.meta_display(F.col("drafter"), F.lit(None).cast("string"), F.col("d.detail"), F.lit("구매"), number, F.lit(None).cast("string")).alias("shown"))


@query("""WITH x AS (SELECT doc_id, n_chars, CAST(doc_id % 5 AS INTEGER) AS q, CASE WHEN doc_id % 3 = 0 THEN n_chars * 10 END AS claimed, n_chars * (doc_id % 5) AS amount FROM documents),
m AS (SELECT *, lambda_ FROM (SELECT *, 1 AS lambda_ FROM x))
SELECT doc_id, CASE WHEN q = 0 THEN '**💰 비용**' || chr(10) || '- 비용 정보를 찾을 수 없습니다' ELSE '**💰 비용**' || chr(10) || '- item: ₩' || format('{:,}', n_chars) || ' × ' || q || ' = ₩' || format('{:,}', amount) || chr(10) || chr(10) || '**소계:** ₩' || format('{:,}', amount)
 || CASE WHEN claimed IS NOT NULL AND claimed <> amount THEN chr(10) || chr(10) || '⚠️ **검증:** 문서 합계 ₩' || format('{:,}', claimed) || '와 차이 있음' ELSE '' END END AS shown FROM m""")
def cost_display(spark, sf):
    """Each document's length as a price."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 5).cast("int").alias("q"))
    item = F.struct(F.lit("item").alias("name"), F.col("q").alias("quantity"), F.col("n_chars").alias("unit_price"), (F.col("n_chars") * F.col("q")).alias("amount"))
    items = F.filter(F.array(item), lambda i: i["quantity"] > 0)
    claimed = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") * 10)
    return d.select("doc_id", M.cost_display(items, F.col("n_chars") * F.col("q"), F.lit(None).cast("bigint"), claimed).alias("shown"))


_IP = "CASE event_id % 5 WHEN 0 THEN '10.0.0.' || event_id % 250 WHEN 1 THEN '8.8.4.4' WHEN 2 THEN '172.20.1.1' WHEN 3 THEN '' END"
_IP2 = "CASE event_id % 3 WHEN 0 THEN '192.168.1.9' WHEN 1 THEN '1.2.3.4' END"


@query(f"""WITH e AS (SELECT event_id, {_IP} AS a, {_IP2} AS b FROM events), s AS (SELECT *, CASE WHEN regexp_matches(coalesce(a, ''), '{M.PRIVATE}') THEN 'rule' WHEN regexp_matches(coalesce(b, ''), '{M.PRIVATE}') THEN 'model' WHEN coalesce(a, '') <> '' THEN 'rule' WHEN b IS NOT NULL THEN 'model' ELSE 'none' END AS source FROM e)
SELECT event_id, CASE source WHEN 'rule' THEN a WHEN 'model' THEN b END AS value, source FROM s""")
def picked_ip(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(_IP).alias("a"), F.expr(_IP2).alias("b"))
    return e.select("event_id", M.picked_ip(F.col("a"), F.col("b")).alias("p")).select("event_id", "p.*")


_MODEL = "CASE p_partkey % 6 WHEN 0 THEN 'HRD-442' WHEN 1 THEN 'NR-16' WHEN 2 THEN 'LVM-180A' WHEN 3 THEN 'ATEM 4K' WHEN 4 THEN 'X-1' END"
_MAKER = "CASE p_partkey % 4 WHEN 0 THEN 'Hanwha Vision' WHEN 1 THEN 'IDIS' WHEN 2 THEN 'TVLogic' WHEN 3 THEN 'Blackmagic Design' END"


@query(f"""WITH p AS (SELECT p_partkey, {_MODEL} AS model, {_MAKER} AS maker FROM part) SELECT p_partkey, list_filter([{', '.join(f"CASE WHEN regexp_matches(model, {_text(x)}) AND maker <> {_text(n)} THEN model || ' is made by {n}, not by ' || maker END" for x, n in M.MAKERS)}], lambda x: x IS NOT NULL) AS warnings FROM p""")
def maker_warnings(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr(_MODEL).alias("model"), F.expr(_MAKER).alias("maker"))
    return p.select("p_partkey", M.maker_warnings(F.col("model"), F.col("maker")).alias("warnings"))


@query("SELECT doc_id, trim(regexp_replace(translate(lower(coalesce(text, '')), '_-', '  '), '\\s+', ' ', 'g')) AS plain FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^\\x{00}-\\x{7F}]')")
def doctype_text(spark, sf):
    """ASCII texts, so that the normal form does not differ by engine."""
    d = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return d.filter(~F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", M.doctype_text(F.col("text")).alias("plain"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' +', ' ', 'g'), '[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '(?i)\\n\\s*페이지\\s+\\d+\\s*/\\s*\\d+\\s*\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS plain FROM documents")
def dry_run_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.dry_run_text(F.coalesce("text", F.lit(""))).alias("plain"))


_YEAR = "CASE o_orderkey % 5 WHEN 0 THEN '연도없음' WHEN 1 THEN '' WHEN 2 THEN CAST(year(o_orderdate) AS {0}) WHEN 3 THEN 'x20' ELSE '0' || CAST(year(o_orderdate) AS {0}) END"


@query(f"WITH y AS (SELECT o_orderkey, {_YEAR.format('VARCHAR')} AS y, CAST(year(o_orderdate) AS VARCHAR) AS z FROM orders), n AS (SELECT *, CASE WHEN y NOT IN ('', '연도없음', 'N/A', '없음', '-') THEN TRY_CAST(y AS INTEGER) END AS n FROM y) SELECT o_orderkey, n AS year, CASE WHEN n IS NOT NULL THEN n = CAST(z AS INTEGER) ELSE y = z END AS same FROM n")
def year_numbers(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(_YEAR.format("STRING")).alias("y"), F.year("o_orderdate").cast("string").alias("z"))
    return o.select("o_orderkey", M.year_number(F.col("y")).alias("year"), M.same_year(F.col("y"), F.col("z")).alias("same"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'docs/category_' || coalesce(regexp_extract(url, '://([^./]*)', 1), '') || '/a b.pdf' ELSE coalesce(url, '') END AS path FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 AND regexp_extract(path, 'category_([^/]*)', 1) <> '' THEN regexp_extract(path, 'category_([^/]*)', 1) ELSE 'general' END AS category, CASE WHEN starts_with(path, 'docs/') THEN substr(path, 6) ELSE path END AS below, replace(path, ' ', '_') AS name FROM p""")
def path_parts(spark, sf):
    host = F.coalesce(F.regexp_extract("url", "://([^./]*)", 1), F.lit(""))
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("docs/category_"), host, F.lit("/a b.pdf"))).otherwise(F.coalesce("url", F.lit("")))
    p = table(spark, sf, "pages").select("page_id", path.alias("path"))
    category = F.when(F.col("page_id") % 2 == 0, M.category_in_path(F.col("path"))).otherwise("general")
    return p.select("page_id", category.alias("category"), M.relative_path(F.col("path"), "docs/").alias("below"), M.spaceless_name(F.col("path")).alias("name"))


_RESPONSE = "CASE doc_id % 4 WHEN 0 THEN 'x ```json\n{{\"a\": {{\"b\": ' || doc_id || '}}}}\n``` y' WHEN 1 THEN 'so {{\"k\": [{{\"v\": ' || doc_id || '}}]}} and {{\"z\": 1}}' WHEN 2 THEN 'none {{ open' ELSE '{{}} {{\"late\": 2}}' END".format()


@query(f"""WITH r AS (SELECT doc_id, {_RESPONSE} AS r FROM documents) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN regexp_extract(r, '(\\{{"a".*\\}}\\}})', 1) WHEN 1 THEN regexp_extract(r, '(\\{{"k".*\\]\\}})', 1) WHEN 3 THEN '{{}}' END AS object FROM r""")
def first_json_object(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", F.expr(_RESPONSE).alias("r"))
    return r.select("doc_id", M.first_object(F.col("r")).alias("object"))
