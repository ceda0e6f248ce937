"""Building contexts: chunks, sentences, compression and hydration."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from ..functions import text as T


def sentences(df: DataFrame, *keep: str, text: str = "text", least: int = 10) -> DataFrame:
    """keep, pos (from 0), sentence: parts between ends of sentences or lines, of ``least`` characters or more."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"[.!?]\s+|\n+"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    return df.select(*keep, F.posexplode(parts).alias("pos", "sentence"))


#: fixed values: patterns of importance (each match counts), and words with their points
IMPORTANT = (
    r"(\d{1,3}(?:,\d{3})*)\s*원",
    r"(\d+)\s*개",
    r"(\d+)\s*대",
    r"(\d+)\s*식",
    r"총\s*(\d{1,3}(?:,\d{3})*)\s*원",
    r"20\d{2}[.-]\d{1,2}[.-]\d{1,2}",
    r"20\d{2}년\s*\d{1,2}월",
    r"[A-Z]+-[A-Z0-9]+",
    r"[A-Z]{2,}\s*\d+[A-Z]*",
    r"워크스테이션|모니터|카메라|마이크|케이블|삼각대|드론|조명",
    r"교체|구매|수리|설치|업그레이드|갱신",
    r"검토|기안|계획|보고|요청",
)
VALUED = {
    "금액": 3.0, "가격": 3.0, "비용": 3.0, "총액": 3.0, "예산": 3.0, "원": 2.5,
    "HP": 2.8, "LG": 2.8, "Sony": 2.8, "Canon": 2.8, "TVLogic": 2.8, "Z8": 2.5, "워크스테이션": 2.5, "모니터": 2.5, "카메라": 2.5,
    "교체": 2.0, "구매": 2.0, "수리": 2.0, "설치": 2.0, "검토": 1.8, "기안": 1.8, "계획": 1.8, "요청": 1.8,
    "장비": 1.5, "기기": 1.5, "도구": 1.5, "시설": 1.5, "문서": 1.2, "보고서": 1.2, "기안서": 1.2,
}


def query_words(query: Column) -> Column:
    """The distinct runs of Hangul, Latin letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("([가-힣a-zA-Z0-9]+)"), F.lit(1)))


def importance(asked: Column, sentence: Column, pos: Column, last: Column) -> Column:
    """5 x share of query words, 2 for each important match, the points of valued words, 1 for the first or 0.5 for the last; less if short or long."""
    words = query_words(sentence)
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words)) / F.size(asked)).otherwise(0.0)
    matches = sum((F.regexp_count(sentence, F.lit(f"(?i){p}")) for p in IMPORTANT), F.lit(0))
    low = F.lower(sentence)
    valued = sum((F.when(low.contains(w.lower()), n).otherwise(0.0) for w, n in VALUED.items()), F.lit(0.0))
    place = F.when(pos == 0, 1.0).when(pos == last, 0.5).otherwise(0.0)
    length = F.length(sentence)
    return (5 * share + 2 * matches + valued + place) * F.when(length < 20, 0.5).when(length > 200, 0.8).otherwise(1.0)


def scored_sentences(df: DataFrame, query: Column, *keep: str) -> DataFrame:
    """keep, pos, sentence, score."""
    parts = sentences(df.withColumn("_q", query_words(query)), *keep, "_q")
    last = F.max("pos").over(Window.partitionBy(*keep))
    return parts.withColumn("_last", last).select(*keep, "pos", "sentence", F.round(importance(F.col("_q"), F.col("sentence"), F.col("pos"), F.col("_last")), 6).alias("score"))


def compress_stop(scored: DataFrame, key: str, ratio: float = 0.7, budget: float = 0.7) -> DataFrame:
    """The best sentences until one does not fit (then none after it), in the text's order; one at least.

    At most ``ratio`` of the sentences and ``budget`` of the characters.
    """
    w = Window.partitionBy(key)
    best = w.orderBy(F.desc("score"), "pos")
    run = scored.withColumns({
        "_rank": F.row_number().over(best), "_sum": F.sum(F.length("sentence")).over(best.rowsBetween(Window.unboundedPreceding, 0)),
        "_n": F.count("*").over(w), "_all": F.sum(F.length("sentence")).over(w),
    })
    fits = (F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))) & ((F.col("_sum") <= F.col("_all") * budget) | (F.col("_rank") == 1))
    return run.filter(fits).select(key, "pos", "sentence", "score")


def compress_skip(scored: DataFrame, key: str, budget: int) -> DataFrame:
    """key, kept (positions): the best sentences of which each fits into what the better ones have left."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("pos").alias("pos"), F.length("sentence").alias("n"))))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["n"] <= budget, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["kept"], F.array(x["pos"])).alias("kept"))).otherwise(a)
    return scored.groupBy(key).agg(order.alias("o")).select(key, F.array_sort(F.aggregate("o", start, step)["kept"]).alias("kept"))


def hydrated(chunks: DataFrame, most: int = 3600) -> DataFrame:
    """query_id, context, chunks_used: the chunks (query_id, rank, text) in order of rank, parted by empty lines, up to ``most`` characters."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    text = F.trim(F.coalesce("text", F.lit("")))
    run = chunks.withColumn("_t", text).filter("_t <> ''").withColumn("_sum", F.sum(F.length("_t") + 2).over(w))
    own = run.filter(F.col("_sum") - F.length("_t") - 2 < most).withColumn("_t", F.when(F.col("_sum") - 2 > most, F.expr(f"left(_t, int({most} - (_sum - length(_t) - 2)))")).otherwise(F.col("_t")))
    lists = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "_t"))).alias("o"))
    return lists.select("query_id", F.array_join(F.transform("o", lambda x: x["_t"]), "\n\n").alias("context"), F.size("o").alias("chunks_used"))


def chunks_of(text: str, size: int = 900, overlap: int = 150, least: int = 200) -> list[str]:
    """Sentences put together up to ``size`` tokens, each chunk with the last ``overlap`` of the one before; small ones join theirs."""
    weight = lambda s: max(len(re.findall("[가-힣]", s)), len(s.split()))
    out: list[str] = []
    own: list[tuple[str, int]] = []
    for s in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+|\n+", text))):
        n = weight(s)
        if own and sum(k for _, k in own) + n > size:
            out.append(" ".join(x for x, _ in own))
            keep: list[tuple[str, int]] = []
            for item in reversed(own):
                if sum(k for _, k in keep) + item[1] > overlap:
                    break
                keep.insert(0, item)
            own = keep
        own.append((s, n))
    if own:
        out.append(" ".join(x for x, _ in own))
    joined: list[str] = []
    for c in out:
        if joined and weight(c) < least:
            joined[-1] += " " + c
        else:
            joined.append(c)
    return joined


@pandas_udf(ArrayType(StringType()))
def chunked(text: pd.Series) -> pd.Series:
    """``chunks_of`` of a column: the next chunk depends on how the last one ended."""
    return text.map(lambda t: chunks_of(t if isinstance(t, str) else ""))


def keyword_coverage(query: Column, texts: Column, words: list[str]) -> Column:
    """How many of the domain's words in the query stand in any of the texts."""
    asked = F.filter(F.array(*map(F.lit, words)), lambda w: query.contains(w))
    return F.size(F.filter(asked, lambda w: F.exists(texts, lambda t: t.contains(w))))


#: fixed values: what makes a sentence a core one, and the points for it
CORE_UNITS = ("원", "년", "월", "일", "개", "대", "만", "억", "식", "통", "건", "명", "권")
CORE_WORDS = (
    "기안", "구매", "수리", "교체", "렌즈", "마이크", "카메라", "케이블", "품목", "모델", "금액", "날짜", "작성", "신청", "배터리", "건전지", "소모품", "장비", "방송", "촬영", "사옥", "검토",
)
CORE_MARKS = ("따라서", "요약", "결론", "목적", "종합", "권고", "확정", "내용")


def _count_of(text: Column, words: tuple[str, ...]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def core_score(sentence: Column, pos: Column, last: Column, numeric: float = 3.0, keyword: float = 1.0, conclusion: float = 2.0, edge: float = 1.0) -> Column:
    """Points for numbers or units, for each word of the domain, for a mark of conclusions, and for the first and last sentence."""
    number = sentence.rlike(r"\d") | (_count_of(sentence, CORE_UNITS) > 0)
    return F.when(number, numeric).otherwise(0.0) + _count_of(sentence, CORE_WORDS) * keyword + F.when(_count_of(sentence, CORE_MARKS) > 0, conclusion).otherwise(0.0) + F.when((pos == 0) | (pos == last), edge).otherwise(0.0)


def core_sentences(df: DataFrame, key: str, budget: int, text: str = "text") -> DataFrame:
    """key, kept (positions): the core sentences of each text that fit into ``budget`` characters, better ones first."""
    parts = sentences(df, key, text=text, least=11)
    last = F.max("pos").over(Window.partitionBy(key))
    scored = parts.withColumn("_last", last).withColumn("score", core_score(F.col("sentence"), F.col("pos"), F.col("_last")))
    return compress_skip(scored, key, budget)


def cut_at_paragraph(text: Column, most: int) -> Column:
    """Whole paragraphs up to ``most`` characters (two for what parts them); the head of the text if the first is too long."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))
    fits = lambda a, p: a["open"] & (a["n"] + F.length(p) + 2 <= most)
    step = lambda a, p: F.struct(F.when(fits(a, p), a["n"] + F.length(p) + 2).otherwise(a["n"]).alias("n"), fits(a, p).alias("open"), F.when(fits(a, p), F.concat(a["kept"], F.array(p))).otherwise(a["kept"]).alias("kept"))
    kept = F.aggregate(parts, start, step)["kept"]
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")).otherwise(F.left(text, F.lit(most)))


def same_document_first(hits: DataFrame, document: str, most: int = 10) -> DataFrame:
    """query_id, doc_id, rank: the hits of the first one's document come first, then the others; ``most`` of each query."""
    first = hits.groupBy("query_id").agg(F.min_by(document, "rank").alias("_first"))
    order = Window.partitionBy("query_id").orderBy((F.col(document) != F.col("_first")).cast("int"), "rank")
    out = hits.join(first, "query_id").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)
    return out.select("query_id", "doc_id", F.col("_rank").alias("rank"))


def priority_first(hits: DataFrame, pattern: str, most: int = 10, text: str = "text") -> DataFrame:
    """query_id, doc_id, rank: hits whose text matches come first, in their order; ``most`` of each query."""
    order = Window.partitionBy("query_id").orderBy((~F.coalesce(F.col(text).rlike(pattern), F.lit(False))).cast("int"), "rank")
    return hits.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).select("query_id", "doc_id", F.col("_rank").alias("rank"))


def full_text_if_short(snippet: Column, whole: Column, least: int = 1200, most: int = 5000) -> Column:
    """The snippet; if it is shorter than ``least``, the head of the whole text where there is one."""
    return F.when(F.length(snippet) >= least, snippet).otherwise(F.coalesce(F.left(whole, F.lit(most)), snippet))


def compression_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row from sentences (doc_id, sentence) before and after: documents, characters, ratio, mean per document, sentences, share kept."""
    size = lambda df, p: df.agg(F.countDistinct("doc_id").alias(f"{p}_docs"), F.coalesce(F.sum(F.length("sentence")), F.lit(0)).alias(f"{p}_chars"), F.count("*").alias(f"{p}_sentences"))
    both = size(before, "all").join(size(after, "kept"))  # one row each
    part = lambda a, b, default: F.round(F.coalesce(F.try_divide(a, b), F.lit(default)), 6)
    return both.select("all_docs", "all_chars", "kept_chars", "all_sentences", "kept_sentences", part(F.col("kept_chars"), F.col("all_chars"), 1.0).alias("ratio"), part(F.col("kept_chars"), F.col("kept_docs"), 0.0).alias("mean_chars"), part(F.col("kept_sentences"), F.col("all_sentences"), 0.0).alias("kept_share"))


def chunk_stats(chunks: DataFrame, key: str, tokens: Column, least: int = 200) -> DataFrame:
    """key, chunks, mean, median (the upper one), largest, small (below ``least``) and their share in percent, of the tokens of chunks."""
    found = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.round(F.avg(tokens), 1).alias("mean"), F.sort_array(F.collect_list(tokens)).alias("_t"), F.max(tokens).alias("largest"), F.count_if(tokens < least).alias("small"))
    return found.select(key, "chunks", "mean", F.get("_t", F.floor(F.size("_t") / 2).cast("int")).alias("median"), "largest", "small", F.round(F.col("small") / F.col("chunks") * 100, 2).alias("small_rate"))
