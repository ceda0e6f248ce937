"""Checks of answers against their sources, and choices of search modes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .queries import COST, FILE, LIST, QUESTION, REFERENCE, question_type

#: fixed values: words of refusals, of doubt, and of answers that hold something
REFUSALS = "답변을 드릴 수 없습니다|전혀 찾을 수 없습니다|완전히 알 수 없습니다"
DOUBTS = "찾을 수 없|확인할 수 없|명시되지 않|불분명"
SUBSTANCE = r"\d{4}년|\d+만|\d+원|카메라|모니터|소모품|케이블|기안자|검토|승인|구매|교체"
#: fixed values: words that ask for whole documents, for summaries, and that join conditions
FULL_DOCUMENT = (
    "자세히", "상세히", "세부사항", "모든", "전체", "모두", "요약", "정리", "내용", "빠짐없이", "완전히", "상세하게", "디테일", "구체적으로",
    "포괄적으로", "총정리", "전반적으로", "전문", "완전한", "상세한", "자세한", "종합적으로",
)
SUMMARY = ("요약", "정리", "개요", "총정리", "종합", "정리해서", "요약해서", "요약해줘", "정리해줘", "종합해서")
CONDITIONS = ("그리고", "또한", "각각", "모두", "전부", "모든")
#: fixed values: words that ask for plain and for wider search
BASIC = ("파일", "문서", "날짜", "기안자", "찾아", "구매", "수리", "검토서", "DVR", "카메라")
HYBRID = ("관련", "유사", "비슷", "같은", "종류", "어떤", "무엇", "왜", "어떻게", "설명", "모든", "전체", "전부", "다", "여러")
WHOLE = "|".join(FULL_DOCUMENT + SUMMARY + CONDITIONS)
PLAIN, WIDE = "|".join(w.lower() for w in BASIC), "|".join(HYBRID)


def cited_files(answer: Column) -> Column:
    """File names with ``.pdf`` in brackets or by themselves, distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"([^\s\[\](),:]+\.pdf)"), F.lit(1)), lambda x: F.trim(x)))


def citations(answer: Column, available: Column) -> Column:
    """struct valid, invalid: cited files that are among the available ones (either name within the other), and others."""
    cited = cited_files(answer)
    known = lambda c: F.exists(available, lambda a: a.contains(c) | c.contains(a))
    return F.struct(F.filter(cited, known).alias("valid"), F.filter(cited, lambda c: ~known(c)).alias("invalid"))


def with_citations(answer: Column, sources: Column) -> Column:
    """The answer, with a line for each source that it does not name."""
    missing = F.filter(sources, lambda s: ~answer.contains(s))
    return F.when(F.size(missing) > 0, F.concat(answer, F.lit("\n"), F.array_join(F.transform(missing, lambda s: F.concat(F.lit("- "), s)), "\n"))).otherwise(answer)


def confidence(answer: Column, best: Column, available: Column) -> Column:
    """The best score, plus 0.1 for each valid citation (0.2 at most), less for odd lengths and doubt; 0 to 1."""
    bonus = F.least(F.lit(0.2), F.size(citations(answer, available)["valid"]) * 0.1)
    length = F.length(answer)
    less = F.when(length < 50, 0.1).when(length > 1000, 0.05).otherwise(0.0) + F.when(answer.rlike(DOUBTS), 0.2).otherwise(0.0)
    return F.when(F.size(available) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), best + bonus - less)))


def is_meaningful(answer: Column) -> Column:
    """15 characters or more, no refusal, something of substance."""
    return (F.length(F.trim(answer)) >= 15) & ~answer.rlike(REFUSALS) & answer.rlike(SUBSTANCE)


def wants_whole_document(query: Column) -> Column:
    return query.rlike(WHOLE) | (F.length(query) > 50)


def search_mode(query: Column) -> Column:
    """basic or hybrid: plain words first, then wider ones, then more than 20 characters."""
    q = F.lower(query)
    return F.when(q.rlike(PLAIN), "basic").when(q.rlike(WIDE), "hybrid").when(F.length(query) > 20, "hybrid").otherwise("basic")


def weights(query: Column) -> Column:
    """struct vector, bm25: the later rule that fits decides."""
    words, kind = F.size(F.split(F.trim(query), r"\s+")), question_type(query)
    rules = [(F.lit(True), 0.1), (words <= 2, 0.05), (query.rlike("[A-Z]+-?[0-9]+"), 0.05), (kind == "amount", 0.05), ((kind == "general") & (words > 5), 0.3)]
    vector = F.lit(0.1)
    for when, value in rules:
        vector = F.when(when, F.lit(value)).otherwise(vector)
    return F.struct(vector.alias("vector"), F.round(1 - vector, 6).alias("bm25"))


def alternatives(query: Column) -> Column:
    """array of struct confidence, mode, reason: all modes that the query could mean, the surest first."""
    document = query.rlike(FILE) | query.rlike(REFERENCE)
    content = query.rlike("요약|정리|개요|내용|미리보기")
    one = lambda when, c, m, r: F.when(when, F.struct(F.lit(c).alias("confidence"), F.lit(m).alias("mode"), F.lit(r).alias("reason")))
    found = F.array_compact(F.array(
        one(query.rlike(f"(?i){COST}"), 0.95, "COST", "cost_intent"), one(document & content, 0.9, "DOCUMENT", "doc_reference+content"), one(query.rlike(f"(?i){LIST}"), 0.9, "SEARCH", "list_intent"),
        one(query.rlike(QUESTION), 0.8, "QA", "qa_keywords"), one(document & ~content, 0.6, "DOCUMENT", "doc_reference_only"),
    ))
    default = F.array(F.struct(F.lit(0.5).alias("confidence"), F.lit("QA").alias("mode"), F.lit("default").alias("reason")))
    return F.when(F.size(found) > 0, found).otherwise(default)


def author_queries(query: Column) -> Column:
    """The query, or five wordings of a search for the author that it names."""
    name = F.trim(F.coalesce(*[F.nullif(F.regexp_extract(query, p, 1), F.lit("")) for p in (r"([가-힣]{2,4}?)(?:이|가)?\s*(?:작성|기안|제안)\s*(?:한|하신)", r"(?:작성자|기안자|제안자)[\s:]*([가-힣]{2,4})", r"([가-힣]{2,4})\s+(?:기안서|작성문서)")]))
    return F.when(name.isNull(), F.array(query)).otherwise(F.array(name, F.concat(F.lit("기안자 "), name), F.concat(F.lit("작성자 "), name), F.concat(name, F.lit(" 기안서")), F.concat(name, F.lit(" 문서"))))


def hash_vector(text: Column, size: int = 768) -> Column:
    """Stands in for an embedding: bytes of the text's SHA-256, over and over, from -0.5 to 0.5."""
    digest = F.sha2(text.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5).cast("float"))


def file_reference(filename: Column) -> Column:
    return F.concat(F.lit("doc:"), F.left(F.sha1(filename.cast("binary")), F.lit(10)))


def hit_problems(doc_id: Column, page: Column, text: Column, score: Column, meta: Column) -> Column:
    """What a hit lacks: its key, a page from 1, a text, a finite score, meta data."""
    return F.array_compact(F.array(
        F.when(doc_id.isNull() | (F.trim(doc_id) == ""), F.lit("doc_id")), F.when(page.isNull() | (page < 1), F.lit("page")), F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("text")),
        F.when(score.isNull() | F.isnan(score), F.lit("score")), F.when(meta.isNull(), F.lit("meta")),
    ))
