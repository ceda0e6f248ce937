"""Metadata of business documents as column expressions: dates, people, kinds, money in prose, tables' totals, displays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .documents import normalize_date
from .extract import scaled
from .text import nfkc

NONE = "정보 없음"
#: fixed values: kinds of documents by words in them, the first that matches; minutes need two of three words
KINDS = (
    ("proc_eval", r"(?i)(기술\s*검토서|구매\s*검토서|검토의\s*건|견적\s*비교|도입\s*검토|교체\s*검토|선정|권고|proposal)"),
    ("consumables", r"(?i)(소모품|consumable|구매\s*의\s*건|납품|발주)"),
    ("repair", r"(?i)(수리(?:\s*내역)?|불량|고장|장애|\bAS\b|A/S)"),
    ("disposal", r"(?i)(폐기|불용|SCRAP|disposal|폐기의\s*건)"),
)
MINUTES = ("안건", "참석자", "결정")
MINUTES_SIGN = r"(?i)(회의록|회의\s*결과|회의\s*일시|회의\s*장소|참석자|안건|결정\s*사항)"
#: fixed values: types by words in lower-cased text, in order
TYPES = (
    ("구매", ("구매", "구입", "발주", "조달", "입찰", "계약서", "견적")),
    ("수리", ("수리", "정비", "a/s", "as", "고장", "수선", "보수", "유지보수")),
    ("임대", ("임대", "임차", "렌탈", "대여", "리스")),
    ("신청", ("신청서", "요청서", "의뢰서", "신청", "요청")),
    ("보고", ("보고서", "보고", "결과", "분석", "현황", "실적")),
    ("회의", ("회의록", "회의", "미팅", "협의", "논의")),
    ("검수", ("검수", "검사", "시험", "테스트", "점검")),
)
SIMPLE_TYPES = (("구매기안서", ("구매",)), ("수리/교체", ("수리", "교체")), ("장애보고서", ("장애",)), ("기술검토서", ("검토",)))
#: fixed values: departments, and whether a bare name gets 부
DEPARTMENTS = (
    (r"(카메라|조명|음향|영상|스튜디오|중계|편집|송출)(?:\s*(부|팀|실))?", True),
    (r"(제작[1-9]|보도|교양|예능|드라마|스포츠|시사)(?:\s*(부|국|팀))?", False),
    (r"(기술|제작|경영|편성|심의|홍보)\s*(본부|국|센터)", False),
    (r"부서\s*:\s*([가-힣A-Za-z]+(?:부|팀|실|과|센터|본부))", False),
    (r"소속\s*:\s*([가-힣A-Za-z]+)", False),
    (r"담당\s*:\s*([가-힣A-Za-z]+)", False),
)
#: fixed values: drafters by label, and what no drafter's name holds
DRAFTERS = (r"기안자\s*[:\s]*([가-힣]{2,4})", r"작성자\s*[:\s]*([가-힣]{2,4})", r"기안\s*[:\s]*([가-힣]{2,4})")
NO_AUTHOR = ("팀", "부", "실", "국", "대표", "이사", "차장", "과장", "담당")
#: fixed values: fields with the way they were found and how sure that is
DATES = (
    (r"(?:기안일자|검토일자|작성일자|시행일자)\s*[:：]?\s*(20\d{2})[-./\s](0?[1-9]|1[0-2])[-./\s](0?[1-9]|[12]\d|3[01])", "explicit_label", 0.9),
    (r"(20\d{2})[-./](0?[1-9]|1[0-2])[-./](0?[1-9]|[12]\d|3[01])", "date_format", 0.7),
    (r"(20\d{2})\s*년\s*(0?[1-9]|1[0-2])\s*월\s*(0?[1-9]|[12]\d|3[01])\s*일", "korean_format", 0.7),
)
AMOUNTS = (
    (r"(?:총액|합계|금액|총\s*금액)\s*[:：]?\s*[₩\s]*([0-9,]+)\s*원?", "total_amount", 0.9),
    (r"검토\s*금액\s*[:：]?\s*[₩\s]*([0-9,]+)\s*원?", "review_amount", 0.7),
    (r"([0-9,]+)\s*원\s*(?:\(|$)", "amount_with_won", 0.7),
)
TITLES = ((r"제목\s*[:：]?\s*(.{5,100})", "labeled_title"), (r"(?m)^\s*(.{10,80})\s*검토[의서]?\s*건", "review_title"), (r"(?m)^\s*(.{10,80})\s*구매\s*검토", "purchase_title"))
VENDORS = ((r"(?:업체명|납품업체|공급사|제조사|벤더)\s*[:：]?\s*([\p{L}\p{N}_&().\- ]{2,50})", "labeled_vendor"), (r"(?:견적서|납품)\s*:\s*([\p{L}\p{N}_&().\- ]{2,30})", "quote_vendor"))
GEAR = (r"(?i)([A-Z]+-[0-9A-Z]+)", r"(?i)(워크스테이션|모니터|마이크|카메라|트라이포드|짐벌|드론)", r"(?i)(HP\s+Z\d+|LG\s+\d+\w+|삼성\s+\w+)")
#: fixed values: money in prose
UNITS, WON = r"(?:(\d+(?:\.\d+)?)\s*억)|(?:(\d+(?:\.\d+)?)\s*만)", r"([\d]{1,3}(?:[,]\d{3})+|\d+)\s*원?"
TOTAL_LABELS = (
    r"(?i)(?:총\s?액|총계|합계)\s*[:\s]+([\d,\.]+)\s*(원|만원|억|억원|KRW|₩)?",
    r"(?i)(?:총\s?금액|결제금액)\s*[:\s]+([\d,\.]+)\s*(원|만원|억|억원|KRW|₩)?",
    r"(?i)소계\s*[:\s]+([\d,\.]+)\s*(원|만원|억|억원|KRW|₩)?",
)
VAT_LABEL = r"(?i)(?:부가세|VAT|세액)\s*[:\s]+([\d,\.]+)\s*(원|만원|억|억원|KRW|₩)?"
DECISIONS = r"(선정|결정|조치|확정|권고|채택|승인)"
#: fixed values: headers of cost tables
HEADERS = (r"(품목|모델|품명)", r"(수량)", r"(단가)", r"(금액|합계)", r"(비고|규격|사양)")
#: fixed values: words of reasons for a replacement
REASONS = ("경과", "노후", "고장", "성능 저하", "단종", "용량 부족", "장애", "불안정", "끊김", "스트리밍", "열화", "수명")
#: fixed values: makers by the heads of their models
MAKERS = ((r"^(HRD|XRN)", "Hanwha Vision"), (r"^NR-\d", "IDIS"), (r"^(LVM|RMK)", "TVLogic"), (r"DECKLINK|ATEM", "Blackmagic Design"))
#: fixed values: private networks
PRIVATE = r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def day(year: Column, month: Column, day_: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day_, 2, "0"))


def all_days(text: Column) -> Column:
    """All days from 1990 to 2035 in the text, each once, the latest first."""
    pattern = F.lit(r"((?:19|20)\d{2}[-./]\d{1,2}[-./]\d{1,2})")
    parts = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: F.split(x, "[-./]"))
    good = F.filter(parts, lambda p: p[0].cast("int").between(1990, 2035) & p[1].cast("int").between(1, 12) & p[2].cast("int").between(1, 31))
    return F.sort_array(F.array_distinct(F.transform(good, lambda p: day(p[0], p[1], p[2]))), asc=False)


def department(text: Column) -> Column:
    """The first department; a bare technical one gets 부."""
    out = F.lit(None).cast("string")
    for pattern, bare in reversed(DEPARTMENTS):
        name = F.regexp_extract(text, pattern, 1)
        whole = F.when(name.rlike("부|팀|실|과|센터|본부"), name).otherwise(F.concat(name, F.lit("부"))) if bare else name
        out = F.when(text.rlike(pattern), whole).otherwise(out)
    return out


def type_by_words(text: Column, types: Sequence[tuple[str, Sequence[str]]] = TYPES, default: str | None = None) -> Column:
    """The first type with a word in the lower-cased text."""
    low, out = F.lower(text), F.lit(default)
    for name, words in reversed(types):
        held = F.lit(False)
        for w in words:
            held = held | low.contains(w)
        out = F.when(held, F.lit(name)).otherwise(out)
    return out


def drafter(text: Column) -> Column:
    return F.coalesce(*[first_group(text, p) for p in DRAFTERS])


def is_author(name: Column, stoplist: Sequence[str] = ()) -> Column:
    """Two to four syllables, or a Latin name, without words of rank or department."""
    a = F.trim(name)
    ranked = a.rlike("|".join(NO_AUTHOR))
    return F.coalesce(~a.isin(*stoplist, "") & ~ranked & (a.rlike("^[가-힣]{2,4}$") | a.rlike(r"^[A-Za-z][A-Za-z.\- ,]{1,30}$")), F.lit(False))


def tagged_date(text: Column, filename: Column, today: Column) -> Column:
    """struct value, method, confidence: a labelled day, any day, the file name's, at last today."""
    tagged = lambda v, m, c: F.struct(v.alias("value"), F.lit(m).alias("method"), F.lit(c).alias("confidence"))
    out = tagged(F.date_format(today, "yyyy-MM-dd"), "current_date_fallback", 0.1)
    name = r"(20\d{2})[-_](0?[1-9]|1[0-2])[-_](0?[1-9]|[12]\d|3[01])"
    own = [(p, text, f"text_{m}", c) for p, m, c in DATES] + [(name, filename, "filename_fallback", 0.8)]
    for pattern, column, method, sure in reversed(own):
        out = F.when(column.rlike(pattern), tagged(day(*[F.regexp_extract(column, pattern, g) for g in (1, 2, 3)]), method, sure)).otherwise(out)
    return out


def tagged_amount(text: Column) -> Column:
    """struct value, method, confidence of the first amount from 1,000 to 1,000,000,000."""
    out = F.struct(F.lit(None).cast("bigint").alias("value"), F.lit("").alias("method"), F.lit(0.0).alias("confidence"))
    for pattern, method, sure in reversed(AMOUNTS):
        value = F.replace(first_group(text, pattern), F.lit(","), F.lit("")).try_cast("bigint")
        out = F.when(value.between(1000, 1_000_000_000), F.struct(value.alias("value"), F.lit(method).alias("method"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def title(text: Column) -> Column:
    """A labelled title or that of a review, of word characters, 5 to 100."""
    clean = lambda p: F.trim(F.regexp_replace(F.regexp_replace(first_group(text, p), r"[^\p{L}\p{N}_\s\-&().]", " "), r"\s+", " "))
    return F.coalesce(*[F.when(F.length(clean(p)).between(5, 100), clean(p)) for p, _ in TITLES])


def vendor(text: Column) -> Column:
    """A labelled company, squeezed, without brackets around it, not of digits alone."""
    clean = lambda p: F.trim(F.regexp_replace(F.regexp_replace(first_group(text, p), r"\s+", " "), r"^[()]+|[()]+$", ""))
    return F.coalesce(*[F.when((F.length(clean(p)) >= 2) & ~clean(p).rlike(r"^[\d\s\-]+$"), clean(p)) for p, _ in VENDORS])


def gear(text: Column) -> Column:
    """Model codes, kinds and brands of equipment, each once."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in GEAR])))


def money(text: Column) -> Column:
    """The first amount: in 억, in 만, else in digits."""
    eok, man = (first_group(text, UNITS, g).cast("decimal(20,4)") * n for g, n in ((1, 10**8), (2, 10**4)))
    digits = F.replace(first_group(text, WON), F.lit(","), F.lit("")).try_cast("bigint")
    return F.coalesce(F.round(F.coalesce(eok, man), 0).cast("bigint"), digits)


def largest_money(text: Column, window: int = 80) -> Column:
    """The largest amount: of the first ones behind each label of totals (within two windows), and of all plain numbers."""
    near = F.transform(F.regexp_extract_all(text, F.lit(rf"(?is)(?=((?:합계|총액|견적|금액).{{0,{2 * window}}}))"), F.lit(1)), money)
    plain = F.transform(F.regexp_extract_all(text, F.lit(WON), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint"))
    return F.array_max(F.concat(near, plain))


def as_won(value: Column) -> Column:
    """An integer of won from digits or prose; null for blanks and 없음."""
    v = F.trim(value)
    plain = F.regexp_replace(v, "[,₩]", "").try_cast("bigint")
    return F.when((v != "") & (v != "없음"), F.coalesce(plain, money(v)))


def labelled(text: Column, patterns: Sequence[str]) -> Column:
    """The first labelled number, in won."""
    return F.coalesce(*[scaled(F.regexp_extract(text, p, 1), F.coalesce(first_group(text, p, 2), F.lit("원"))) for p in patterns])


def document_kind(filename: Column, text: Column) -> Column:
    """minutes, proc_eval, consumables, repair, disposal or generic, from the name and the first 2,000 characters, as summaries need it."""
    s = F.lower(nfkc(F.concat(filename, F.lit("\n"), F.left(text, F.lit(2000)))))
    met = sum((s.contains(w).cast("int") for w in MINUTES), F.lit(0))
    out = F.lit("generic")
    for name, pattern in reversed(KINDS):
        out = F.when(s.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(s.rlike(MINUTES_SIGN) & (met >= 2), "minutes").otherwise(out)


def first_object(text: Column) -> Column:
    """The first ``{...}`` of a fenced block, else the first that closes (two levels of braces within it)."""
    level = r"[^{}]*"
    for _ in range(3):
        level = rf"(?:[^{{}}]|\{{{level}\}})*"
    fenced = first_group(text, r"(?is)```json\s*(\{.*?\})\s*```")
    return F.coalesce(fenced, first_group(text, rf"(?s)(\{{{level}\}})"))


def found_headers(text: Column) -> Column:
    """The headers of cost tables that the text has."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(p)) for p in HEADERS]))


def cost_display(items: Column, total: Column, vat: Column, claimed: Column) -> Column:
    """Markdown of a cost table: a line for each item (name, quantity, unit_price, amount), totals, and a warning where the claimed total differs."""
    won = lambda x: F.concat(F.lit("₩"), F.regexp_replace(x.cast("string"), r"(?<=\d)(?=(\d{3})+$)", ","))
    line = lambda i: F.concat(F.lit("- "), i["name"], F.lit(": "), F.when(i["quantity"].isNotNull() & i["unit_price"].isNotNull(), F.concat(won(i["unit_price"]), F.lit(" × "), i["quantity"].cast("string"), F.lit(" = "), won(i["amount"]))).otherwise(won(i["amount"])))
    sums = F.concat_ws("\n", F.concat(F.lit("\n**소계:** "), won(total)), F.when(vat.isNotNull(), F.concat_ws("\n", F.concat(F.lit("**VAT (10%):** "), won(vat)), F.concat(F.lit("**총액:** "), won(total + vat)))))
    warning = F.when(claimed.isNotNull() & (claimed != total), F.concat(F.lit("\n⚠️ **검증:** 문서 합계 "), won(claimed), F.lit("와 차이 있음")))
    return F.when(F.size(items) > 0, F.concat_ws("\n", F.lit("**💰 비용**"), F.array_join(F.transform(items, line), "\n"), sums, warning)).otherwise(F.lit("**💰 비용**\n- 비용 정보를 찾을 수 없습니다"))


def dates_of(draft: Column, action: Column, filename: Column) -> Column:
    """struct display, detail: the draft's day, else the action's, else the file name's; both days where there are two."""
    a, b = (F.when(c.isNotNull() & (c != ""), normalize_date(c)) for c in (draft, action))
    p = r"(?<![A-Za-z0-9_])(20\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?([0-3]\d)(?![A-Za-z0-9_])"
    name = F.when(filename.rlike(p), day(*[F.regexp_extract(filename, p, g) for g in (1, 2, 3)]))
    display = F.coalesce(a, b, name, F.lit(NONE))
    return F.struct(display.alias("display"), F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" / "), b)).otherwise(display).alias("detail"))


def meta_display(drafter_: Column, department_: Column, detail: Column, category: Column, number: Column, retention: Column) -> Column:
    """Markdown lines of a document's metadata; number and retention where they are known."""
    line = lambda name, *c: F.concat(F.lit(f"**{name}:** "), F.concat_ws(" / ", *[F.coalesce(x, F.lit(NONE)) for x in c]))
    some = lambda name, c: F.when(F.coalesce(c, F.lit(NONE)) != NONE, line(name, c))
    return F.concat_ws("\n", line("기안자/부서", drafter_, department_), line("기안일자 / 시행일자", detail), line("유형/카테고리", category), some("문서번호", number), some("보존기간", retention))


def reason(text: Column) -> Column:
    """The sentence of 8 to 240 characters with the most words of reasons, then the likest to 160 characters, then the first."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda x: F.trim(x)), lambda s: F.length(s).between(8, 240))
    hits = lambda s: sum((s.contains(w).cast("int") for w in REASONS), F.lit(0))
    scored = F.transform(parts, lambda s, i: F.struct((hits(s) * 2.0 + F.least(F.length(s), F.lit(160)) / 160.0).alias("score"), (-i).alias("i"), s.alias("s"), hits(s).alias("n")))
    best = F.array_max(F.filter(scored, lambda x: x["n"] > 0))
    return best["s"]


def picked_ip(rule: Column, model: Column) -> Column:
    """struct value, source: a private address before a public one, the rule's before the model's."""
    given = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    private = lambda c: given(c) & c.rlike(PRIVATE)
    source = F.when(private(rule), "rule").when(private(model), "model").when(given(rule), "rule").when(given(model), "model").otherwise("none")
    return F.struct(F.when(source == "rule", rule).when(source == "model", model).alias("value"), source.alias("source"))


def maker_warnings(model: Column, maker: Column) -> Column:
    """One warning for each rule of models' heads that the maker breaks."""
    return F.array_compact(F.array(*[F.when(model.rlike(p) & (maker != name), F.concat(model, F.lit(f" is made by {name}, not by "), maker)) for p, name in MAKERS]))


def doctype_text(text: Column) -> Column:
    """NFKC, ``_`` and ``-`` as spaces, squeezed, lower-cased."""
    return F.trim(F.lower(F.regexp_replace(F.translate(nfkc(text), "_-", "  "), r"\s+", " ")))


def word_pattern(word: str) -> str:
    """A regular expression for a word on its own, with any white space where it has spaces."""
    import re

    return rf"(?i)(?<![\p{{L}}\p{{N}}_]){re.escape(' '.join(word.lower().replace('_', ' ').replace('-', ' ').split())).replace(chr(92) + ' ', chr(92) + 's*')}(?![\p{{L}}\p{{N}}_])"


def dry_run_text(text: Column) -> Column:
    """Line ends made alike, spaces squeezed, without control characters and lines of page numbers, trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), " +", " ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?i)\n\s*페이지\s+\d+\s*/\s*\d+\s*\n", "\n"), r"^\s+|\s+$", "")


def year_number(year: Column) -> Column:
    """A year as an integer; null for blanks, stand-ins and what is no number."""
    return F.when(~year.isin("", "연도없음", "N/A", "없음", "-"), year.try_cast("int"))


def same_year(a: Column, b: Column) -> Column:
    """Equal as numbers, else as strings."""
    x, y = year_number(a), year_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.eqNullSafe(b))


def drafter_in_name(filename: Column, excluded: Sequence[str] = ()) -> Column:
    """The second or third part of a file name, if it has two to four characters, no digit and no excluded word."""
    parts = F.split(filename, "_")
    good = lambda p: F.length(p).between(2, 4) & ~p.rlike(r"\d") & ~(p.rlike("|".join(excluded)) if excluded else F.lit(False))
    return F.coalesce(*[F.when(good(F.get(parts, F.lit(k))), F.get(parts, F.lit(k))) for k in (1, 2)])


def resolved_drafter(known: Column, filename: Column, department_: Column, excluded: Sequence[str] = ()) -> Column:
    """The known drafter, else the file name's, else the department, else 미확인."""
    dept = F.when(~department_.isin(*excluded, ""), department_)
    return F.coalesce(F.nullif(F.trim(known), F.lit("")), drafter_in_name(filename, excluded), dept, F.lit("미확인"))


def category_in_path(path: Column) -> Column:
    """What stands behind ``category_`` in a folder's name, else general."""
    return F.coalesce(first_group(path, r"(?:^|/)category_([^/]*)"), F.lit("general"))


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; others stay as they are."""
    return F.when(path.startswith(root.rstrip("/") + "/"), path.substr(F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(path)


def spaceless_name(filename: Column) -> Column:
    return F.replace(filename, F.lit(" "), F.lit("_"))
