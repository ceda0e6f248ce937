"""Understanding of queries as column expressions: intents, routes, years, keys, expansion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: patterns of intents
COST = r"(합계|총액|총계|금액|비용).*(얼마|알려줘|확인|인지)|얼마였지|얼마였나요|얼마야|(총액|금액|비용|합계|총계)(은|는)?\s*\?|(기안|작성|문서|구매|소모품|발주|납품|년|월).*(총액|금액|비용|합계|총계)|\d{4}년?\s*(총액|금액|비용|합계|총계)|(비용|구매)\s*(합계|총액)|(합계|총액)\s*(금액|비용)"
LIST = r"(\d{4}년?|[가-힣]{2,4}(가|이)?|모든|전체|all).*(찾아|검색|리스트|목록|보여|알려|문서)|관련\s*(문서|파일|기안서)|문서\s*(찾|검색)|파일\s*(찾|검색|있)|기안서\s*(찾|검색|있)|있어\??|있나요|있는지|몇\s*개|개수|총|count|number"
CONTENT = r"내용|미리보기|자세히|상세히|자세하게|구체적으로|요약|정리|개요"
REFERENCE = r"이\s?문서|해당\s?문서|이\s?파일|그\s?문서"
DOCUMENT_KIND = r"검토서|기안서|견적서|제안서|보고서|계획서|공문|발주서|납품서|영수증"
FILE = r"\S+\.(pdf|txt|PDF|TXT)"
QUESTION = r"왜|어떻게|이유|차이|비교|설명"
#: fixed values: words of question types, first match wins
TYPES = {"amount": "얼마|금액|비용|가격|원", "date": "언제|날짜|기간|년|월", "person": "누구|기안자|작성자|담당자", "equipment": "모델|장비|제품|기기"}
#: fixed values: patterns of comparisons and of hard questions
COMPARISON, HARD, EASY = r"vs|대비|보다|와|과.*비교|중에서.*좋은|어느.*나은", r"왜|어떻게|이유|분석|평가|설명", r"누구|언제|어디|얼마"
#: fixed values: sections of a document by the words that ask for them, first match wins
SECTIONS = {
    "검토 내용": r"검토\s?내용|세부\s?검토|검토사항|기술\s?검토|review|assessment", "비교 대안": r"비교\s?대안|대안\s?비교|대안|옵션|alternatives?|options?",
    "선정 사유": r"선정\s?사유|채택\s?사유|선정\s?기준|rationale|reason", "예산/비용": r"예산|비용|금액|단가|총액|견적|원가|budget|cost|price|amount|total",
    "배경/목적": r"배경|목적|background|objective|purpose", "현황": r"현황|현\s*상태|상태|운영\s*현황|장비\s*현황|status|current\s*state",
    "리스크": r"리스크|위험|한계|제약|이슈|risk|limitation|constraint|issue", "일정/계획": r"일정|타임라인|계획|로드맵|schedule|timeline|plan|roadmap",
}


def first_match(text: Column, patterns: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(patterns.items()):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def intents(query: Column) -> dict[str, Column]:
    return {"cost": query.rlike(f"(?i){COST}"), "list": query.rlike(f"(?i){LIST}"), "content": query.rlike(f"(?i){CONTENT}")}


def route(query: Column) -> Column:
    """struct mode, confidence, cost_intent, list_intent, content_intent; the first rule that fits decides."""
    i = intents(query)
    reference, file = query.rlike(REFERENCE), query.rlike(FILE)
    rules = [
        (i["cost"], "COST", 0.95), ((file | reference | query.rlike(DOCUMENT_KIND)) & i["content"], "DOCUMENT", 0.9),
        (i["list"], "SEARCH", 0.9), (query.rlike(QUESTION), "QA", 0.8), (file | reference, "SEARCH", 0.7),
    ]
    mode, sure = F.lit("QA"), F.lit(0.5)
    for when, m, c in reversed(rules):
        mode, sure = F.when(when, F.lit(m)).otherwise(mode), F.when(when, F.lit(c)).otherwise(sure)
    return F.struct(mode.alias("mode"), sure.alias("confidence"), *[v.alias(f"{k}_intent") for k, v in i.items()])


def routing_reason(query: Column) -> Column:
    """Names of the signals, parted by ``|``."""
    i = intents(query)
    signals = [("cost_intent", i["cost"]), ("list_intent", i["list"]), ("content_intent", i["content"]), ("doc_reference", query.rlike(REFERENCE)), ("filename_detected", query.rlike(FILE))]
    return F.coalesce(F.nullif(F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in signals]), F.lit("")), F.lit("default_qa"))


def downgraded(mode: Column, confidence: Column, hits: Column, delta12: Column) -> Column:
    """With hits that hardly differ, a document or question becomes a search of 0.65 at most."""
    weak = (hits >= 1) & (delta12 < 0.05) & mode.isin("DOCUMENT", "QA")
    return F.struct(F.when(weak, F.lit("SEARCH")).otherwise(mode).alias("mode"), F.when(weak, F.least(confidence, F.lit(0.65))).otherwise(confidence).alias("confidence"))


def question_type(query: Column) -> Column:
    return first_match(query, TYPES, "general")


def complexity(query: Column) -> Column:
    """comparison, complex or simple; more than five words are complex where no pattern decides."""
    q = F.lower(query)
    return F.when(q.rlike(COMPARISON), "comparison").when(q.rlike(HARD), "complex").when(q.rlike(EASY), "simple").when(F.size(F.split(F.trim(q), r"\s+")) > 5, "complex").otherwise("simple")


def adaptive_k(query: Column) -> Column:
    c = complexity(query)
    return F.when(c == "comparison", 10).when(c == "complex", 7).otherwise(3)


def section(query: Column) -> Column:
    return first_match(F.lower(query), SECTIONS)


def four_digits(year: Column, today: Column) -> Column:
    """A year of two digits in the century that ends 20 years from today."""
    y = F.year(today)
    base = F.floor(y / 100) * 100 + year
    return F.when(base > y + 20, base - 100).otherwise(base).cast("int")


def years(query: Column, today: Column) -> Column:
    """struct lo, hi: relative words, a range, a year of four digits, or of two."""
    number = lambda x: F.when(F.length(x) == 4, x.cast("int")).when(F.length(x) == 2, four_digits(F.nullif(x, F.lit("")).cast("int"), today))
    at = lambda p, g: F.regexp_extract(query, p, g)
    pair = r"'?(\d{4}|\d{2})년?\s*[~\-–]\s*'?(\d{4}|\d{2})(?!\d)"
    a, b = number(at(pair, 1)), number(at(pair, 2))
    four = F.nullif(at(r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit("")).cast("int")
    two = F.nullif(at(r"(?:'(\d{2})(?!\d)|(?<!\d)(\d{2})년)", 1), F.lit(""))
    two = F.coalesce(two, F.nullif(at(r"(?<!\d)(\d{2})년", 1), F.lit("")))
    one = F.when(query.contains("재작년"), F.year(today) - 2).when(query.contains("작년"), F.year(today) - 1).when(query.contains("올해"), F.year(today))
    single = F.coalesce(one, four, four_digits(two.cast("int"), today))
    ranged = one.isNull() & a.isNotNull() & b.isNotNull()
    return F.struct(F.when(ranged, F.least(a, b)).otherwise(single).alias("lo"), F.when(ranged, F.greatest(a, b)).otherwise(single).alias("hi"))


def _in_place_of(word: str, standard: str):
    return lambda x: F.when(x == word, F.lit(standard)).otherwise(x)


def canonical(query: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Lower-cased, without punctuation, Latin pieces joined, words by their synonyms."""
    q = F.regexp_replace(F.regexp_replace(F.lower(F.trim(query)), r"[?!.,;:]", ""), r"[-/_]", " ")
    q = F.trim(F.regexp_replace(F.regexp_replace(q, r"(?<=[a-z0-9])\s+(?=[a-z0-9])", ""), r"\s+", " "))
    for word, standard in (synonyms or {}).items():
        q = F.array_join(F.transform(F.split(q, " "), _in_place_of(word, standard)), " ")
    return q


def smart_key(query: Column, mode: Column | None = None, synonyms: dict[str, str] | None = None) -> Column:
    text = canonical(query, synonyms)
    return F.left(F.sha2((F.concat(mode, F.lit(":"), text) if mode is not None else text).cast("binary"), 256), F.lit(16))


def normalized(query: Column) -> Column:
    """Lower-cased and squeezed, adverbs of detail, spellings of a full version and quotes made alike."""
    q = F.lower(F.trim(F.regexp_replace(query, r"\s+", " ")))
    q = F.regexp_replace(q, "(자|상)세(히|하게)(요|좀)?", "$1세히")
    q = F.regexp_replace(F.regexp_replace(q, r"(?<![a-z0-9])full[-\s]?ver(sion)?(?![a-z0-9])", "full version"), r"풀[\s\-]?버(전|젼)", "풀버전")
    return F.translate(q, "'`´‘’“”", '"' * 7)


def is_chat(query: Column) -> Column:
    """Arithmetic, greetings, and queries of a word of two characters or less."""
    return query.rlike(r"^[\d\s+\-*/().=?]+$") | F.lower(query).rlike("^(안녕|하이|hello|hi|thanks|고마워)") | (F.length(F.trim(query)) <= 2)


def expansions(query: Column, synonyms: dict[str, list[str]], most: int = 3) -> Column:
    """The query and, for words with synonyms, one query for each of the first ``most``; distinct."""
    out = F.array(query)
    for word, others in synonyms.items():
        out = F.concat(out, F.when(query.contains(word), F.array(*[F.replace(query, F.lit(word), F.lit(o)) for o in others[:most]])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(out)


def dated(query: Column, today: Column) -> Column:
    """A query in which today, yesterday and this month are written as dates."""
    day = lambda d: F.date_format(d, "yyyy년 MM월 dd일")
    out = F.replace(query, F.lit("오늘"), day(today))
    out = F.replace(out, F.lit("어제"), day(F.date_sub(today, 1)))
    return F.replace(F.replace(out, F.lit("이번달"), F.date_format(today, "yyyy년 MM월")), F.lit("이번 달"), F.date_format(today, "yyyy년 MM월"))


#: fixed values: words of a quick search, and of questions that need an analysis
QUICK_WORDS = ("찾아", "보여", "검색", "있어", "목록", "리스트", "몇 개", "개수", "언제", "누가", "어디", "어느")
ANALYSIS_WORDS = (
    "요약", "분석", "비교", "설명", "왜", "어떻게", "특징", "차이", "공통점", "패턴", "추천", "이유", "원인", "결과", "영향", "관계",
    "내용", "알려", "말해", "정리", "상세", "자세", "구체적", "전체", "모든", "다", "전부",
)
#: fixed values: words of plain and of hard questions
PLAIN_WORDS = ("금액", "가격", "비용", "얼마", "언제", "날짜", "일자", "누가", "기안자", "담당자", "어디", "장소", "위치", "무엇", "장비", "제품")
HARD_WORDS = ("왜", "이유", "원인", "어떻게", "방법", "적절", "타당", "평가", "비교", "차이", "분석", "검토", "문제", "해결", "상세", "자세")


def _any(query: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(query).contains(w))


def needs_analysis(query: Column) -> Column:
    """Whether a question needs an analysis: never with a word of a quick search, always with one of analyses, else if it is longer than 25 characters."""
    return F.when(_any(query, QUICK_WORDS), False).when(_any(query, ANALYSIS_WORDS), True).otherwise(F.length(query) > 25)


def plain_or_hard(query: Column) -> Column:
    """``simple`` for a question with plain words and no hard ones, else ``complex``."""
    return F.when(_any(query, HARD_WORDS), "complex").when(_any(query, PLAIN_WORDS), "simple").otherwise("complex")
