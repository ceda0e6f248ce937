"""What a query asks for beyond its route: filters, people, depth, the choice between search and talk, wider spellings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .queries import four_digits, normalized, section
from .text import HANGUL, nfkc, squeeze

#: fixed values: suffixes of rank behind names, brackets, directives
ROLES = ("과장", "차장", "부장", "팀장", "실장", "국장", "본부장", "매니저", "대리", "사원", "담당", "선임", "책임")
BRACKETS = r"[\(\)\[\]{}]"
YEAR_DIRECTIVE, DRAFTER_DIRECTIVE = r"(?i)year\s*[:=]\s*(\d{2,4})", r"(?i)drafter\s*[:=]\s*([A-Za-z가-힣 ]{2,30})"
#: fixed values: words that are no names unless configuration says others
NOT_NAMES = ("문서", "자료", "파일", "보고서", "전체", "모든")
#: fixed values: words that ask for detail, and those that do so before certain verbs
DETAIL = ("자세히", "상세히", "구체적으로", "디테일", "세부사항", "풀버전", "풀 버전", "detail", "full ver", "full version")
DETAIL_IN_CONTEXT = (r"(전부|모두|전체)\s*(보여|알려|출력|정리|표시)", r"풀로\s*(보여|알려|출력|정리|표시)")
#: fixed values: words that ask for a summary; settings of each depth
SUMMARY_WORDS = ("요약", "summary", "한줄", "한 문장")
DEPTHS = {"DETAILED": ("detailed", 1500), "SECTION": ("section", 900), "SUMMARY": ("summary", 600), "QA": ("qa", 800)}
#: fixed values: greetings and plain sums
SMALLTALK = ("hi", "hello", "hey", "안녕", "안녕하세요", "안녕하십니까", "감사", "고마워", "감사합니다", "고마워요", "thanks", "thank you", "bye", "goodbye", "잘가", "안녕히")
GREETING = r"^(안녕|안녕하세요|안녕하십니까|감사합니다?|고마워요?|thanks|thank you|hi|hello|hey|bye|goodbye|잘가|안녕히)[.!?\s]*$"
SIMPLE_MATH = r"^\s*\d+\s*[\+\-\*/]\s*\d+\s*(=\s*\d+)?\s*[은?]*\s*$"
#: fixed values: words of the domain (without the names of people, which are a table's)
DOMAIN = (
    "nvr", "sync", "eco8000", "lvm-180a", "odin", "vmix", "faiss", "tri-level", "sdi", "lut", "intercom", "di box", "dibox", "무선마이크", "마이크",
    "카메라", "렌즈", "삼각대", "케이블", "건전지", "배터리", "소모품", "장비", "중계차", "뉴스", "스튜디오", "중계", "방송", "기안서", "구매", "수리", "교체",
    "검토", "기술검토", "오버홀", "도입", "노후화", "단종", "작성", "작성된", "문서", "리스트", "목록",
)
#: fixed values: particles and other words that an expansion leaves out
PARTICLES = ("은", "는", "이", "가", "을", "를", "와", "과", "의", "에", "에서", "으로", "로", "께", "만", "도", "까지", "부터")
STOPWORDS = ("및", "그리고", "관련", "해줘", "좀", "문서", "내용", "요약", "건")
#: fixed values: particles that stand for each other behind a word
SWAPS = (("을", "를"), ("를", "을"), ("이", "가"), ("가", "이"), ("은", "는"), ("는", "은"), ("에서", "의"), ("의", "에서"))
#: fixed values: words of recency, and what is added for them
RECENT = ("최근", "latest", "가장 최근", "언제", "최신", "recent")
#: fixed values: model codes and amounts in a query
MODEL_CODE, AMOUNT = r"[A-Z]+-[0-9A-Z]+", r"[\d,]+원|금액|비용|가격"
#: fixed values: endings of questions and what stands for them, in this order
ENDINGS = (
    (r"을?\s*교체하는데\s*드는\s*비용이?\s*얼마나?\s*될까요\?*", " 교체 비용"),
    (r"를?\s*교체하는데\s*드는\s*비용이?\s*얼마나?\s*될까요\?*", " 교체 비용"),
    (r"이?\s*언제\s*교체되었나요\?*", " 교체 날짜"),
    (r"가?\s*언제\s*교체되었나요\?*", " 교체 날짜"),
    (r"께서\s*작성하신\s*문서들?\s*중에서", " 기안자"),
    (r"에\s*대해서는?\s*어떤\s*내용이\s*있습니까\?*", ""),
    (r"에\s*대해\s*어떤\s*내용이\s*있나요\?*", ""),
    (r"는?\s*몇\s*개나?\s*구매했습니까\?*", " 구매 수량"),
    (r"을?\s*구매한?\s*이유가?\s*뭔?가요\?*", " 구매 이유"),
    (r"를?\s*구매한?\s*이유가?\s*뭔?가요\?*", " 구매 이유"),
    (r"가장\s*최근에?\s*작성된?\s*문서는?\s*언제\s*것인?가요\?*", " 최근 문서 날짜"),
    (r"라는?\s*기안자가?\s*작성한?\s*문서에?서?는?\s*어떤\s*장비들?이?\s*나오나요\?*", " 기안자 문서 장비"),
    (r"은\s*얼마", ""),
    (r"는\s*얼마", ""),
    (r"가\s*얼마", ""),
    (r"을\s*얼마", ""),
    (r"를\s*얼마", ""),
    (r"의?\s*가격은?\s*대략\s*어느?정도\s*인?가요\?*", " 가격"),
    (r"얼마나?\s*될까요\?*", ""),
    (r"얼마인가요\?*", ""),
    (r"입니까\?*", ""),
    (r"인가요\?*", ""),
    (r"무엇인가요\?*", ""),
    (r"어떻게\s*되나요\?*", ""),
    (r"을\s*알려주시겠어요\?*", ""),
    (r"를\s*알려주시겠어요\?*", ""),
    (r"이라는", ""),
    (r"에서는?", " "),
    (r"로서는?", " "),
    (r"께서", " "),
    (r"들은?\s*어떻게", ""),
    (r"들이?\s*어떻게", ""),
    (r"었습니까", ""),
    (r"습니까", ""),
    (r"하나요", ""),
    (r"나오나요", " 포함"),
)
#: fixed values: a date at the head of a file name, with the suffix or without
DATED_FILE = (r"(?i)(\d{4}[-_]\d{2}[-_]\d{2}[^.]*\.pdf)", r"(\d{4}[-_]\d{2}[-_]\d{2}[^.\s]*)")


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words stands in the text."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def strip_ui_tags(query: Column) -> Column:
    """Without the tag, date and author that a copied result line carries."""
    q = F.regexp_replace(F.regexp_replace(query, r"🏷[^·]+·\s*", ""), r"📅[^·]+·\s*", "")
    return squeeze(F.regexp_replace(F.regexp_replace(q, r"✍[^·]+", ""), r"\s+pdf\s+", " "))


def normalized_name(name: Column) -> Column:
    """A name without brackets, spaces and rank, lower-cased."""
    bare = F.replace(F.trim(nfkc(F.regexp_replace(name, BRACKETS, ""))), F.lit(" "), F.lit(""))
    return F.lower(F.regexp_replace(bare, rf"({'|'.join(ROLES)})\s*", ""))


def directed_year(query: Column, today: Column) -> Column:
    """The year of a ``year:`` directive; two digits by the century, four from 1900 to 2100."""
    digits = F.nullif(F.regexp_extract(query, YEAR_DIRECTIVE, 1), F.lit(""))
    return F.when(F.length(digits) == 2, four_digits(digits.cast("int"), today)).when((F.length(digits) == 4) & digits.cast("int").between(1900, 2100), digits.cast("int"))


def directed_drafter(query: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(query, DRAFTER_DIRECTIVE, 1)), F.lit(""))


def name_candidates(query: Column, stopwords: Sequence[str] = NOT_NAMES) -> Column:
    """Strings of Hangul that may be names: runs of two to four, and such runs with spaces between their syllables."""
    runs = F.regexp_extract_all(query, F.lit(f"([{HANGUL}]{{2,4}})"), F.lit(1))
    spaced = F.regexp_extract_all(query, F.lit(f"([{HANGUL}]{{1,2}}(?: +[{HANGUL}]{{1,2}}){{1,3}})"), F.lit(1))
    joined = F.transform(spaced, lambda s: F.array_join(F.filter(F.split(s, " +"), lambda w: ~w.isin(*stopwords)), ""))
    return F.array_distinct(F.filter(F.concat(runs, joined), lambda c: ~c.isin(*stopwords) & F.length(c).between(2, 4)))


def plain_filters(query: Column) -> Column:
    """struct year, drafter by the plain rules: four digits, and a name before a word of documents."""
    year = F.nullif(F.regexp_extract(query, r"(\d{4})\s*년?", 1), F.lit("")).cast("int")
    return F.struct(year.alias("year"), F.nullif(F.regexp_extract(query, f"([{HANGUL}]{{2,4}})\\s*(문서|기안서|작성|기안|의)", 1), F.lit("")).alias("drafter"))


def is_detailed(query: Column) -> Column:
    q = normalized(query)
    return any_of(q, DETAIL) | q.rlike("|".join(DETAIL_IN_CONTEXT))


def depth(query: Column) -> Column:
    """struct mode, prompt, max_tokens, top_k, merge, max_context: detail first, then a section, then a summary."""
    q = normalized(query)
    detailed = is_detailed(query)
    mode = F.when(detailed, "DETAILED").when(section(q).isNotNull(), "SECTION").when(any_of(q, SUMMARY_WORDS), "SUMMARY").otherwise("QA")
    pick = lambda k: F.coalesce(*[F.when(mode == name, F.lit(values[k])) for name, values in DEPTHS.items()])
    return F.struct(mode.alias("mode"), pick(0).alias("prompt"), pick(1).alias("max_tokens"), F.when(detailed, 8).otherwise(5).alias("top_k"), detailed.alias("merge"), F.when(detailed, 3200).otherwise(2000).alias("max_context"))


def token_count(query: Column) -> Column:
    """Runs of Latin letters, digits, ``-``, ``_`` and ``/``, and runs of Hangul."""
    return F.size(quick_tokens(query))


def domain_words(query: Column, domain: Sequence[str] = DOMAIN) -> Column:
    """The words of the domain that stand in the query."""
    q = F.lower(query)
    return F.array_compact(F.array(*[F.when(q.contains(w), F.lit(w)) for w in domain]))


def forced_chat(query: Column) -> Column:
    """smalltalk, simple_math or short_query; null if the query may be searched for."""
    s = F.lower(F.trim(query))
    short = (token_count(query) < 3) & (F.size(domain_words(query)) == 0)
    return F.when(s.isin(*SMALLTALK) | s.rlike(GREETING), "smalltalk").when(F.trim(query).rlike(SIMPLE_MATH), "simple_math").when(short, "short_query")


def gate(query: Column, top_score: Column, coverage: Column, policy: str = "normalized", least: float = 0.35, least_absolute: float = 0.25, least_tokens: int = 4, least_coverage: int = 2) -> Column:
    """rag or chat. ``normalized``: by the top score; ``absolute``: by score, domain, length and the domain words found in the hits."""
    absolute = (top_score >= least_absolute) & (F.size(domain_words(query)) > 0) & (token_count(query) >= least_tokens) & (coverage >= least_coverage)
    search = absolute if policy == "absolute" else top_score >= least
    return F.when(forced_chat(query).isNull() & search, "rag").otherwise("chat")


def bare_name(text: Column) -> Column:
    """Lower-cased, ``&`` as ``and``, without spaces and separators."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit("and")), r"[\s_·,:()\\\[\]\-]+", "")


def name_likeness(a: Column, b: Column) -> Column:
    """0.8 if one bare name lies in the other, and up to 0.4 for like lengths; 1 at most."""
    x, y = bare_name(a), bare_name(b)
    base = F.when(x.contains(y) | y.contains(x), 0.8).otherwise(0.0)
    return F.least(F.lit(1.0), base + F.greatest(F.lit(0.0), F.lit(0.4) - F.abs(F.length(x) - F.length(y)) * 0.01))


def quick_tokens(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(f"([A-Za-z0-9\\-_/]+|[{HANGUL}]+)"), F.lit(1))


def search_tokens(query: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-cased tokens of two characters or more, without particles and stop words."""
    lower = F.transform(quick_tokens(query), F.lower)
    return F.filter(lower, lambda t: (F.length(t) > 1) & ~t.isin(*PARTICLES, *STOPWORDS, *stopwords))


def token_variants(token: Column) -> Column:
    """The token, and for ``-``, ``_`` and ``/`` its spellings without and with a space; two characters or more; sorted."""
    spellings = [token]
    for mark in ("-", "_", "/"):
        spellings += [F.replace(token, F.lit(mark), F.lit("")), F.replace(token, F.lit(mark), F.lit(" "))]
    return F.array_sort(F.filter(F.array_distinct(F.array(*spellings)), lambda v: F.length(v) > 1))


def swapped_abbreviations(query: Column, abbreviations: dict[str, str]) -> Column:
    """One query for each abbreviation that stands in it (in full) or whose full form does (in short)."""
    out = [F.when(query.contains(a), F.replace(query, F.lit(a), F.lit(b))).when(query.contains(b), F.replace(query, F.lit(b), F.lit(a))) for a, b in abbreviations.items()]
    return F.array_compact(F.array(*out))


def recent_queries(query: Column, today: Column, most: int = 2) -> Column:
    """For words of recency the query with one of these behind it: newest, new, the year."""
    added = F.array(*[F.when(~query.contains(w), F.concat(query, F.lit(" "), w)) for w in (F.lit("최신"), F.lit("신규"), F.year(today).cast("string"))])
    return F.when(any_of(query, RECENT), F.slice(F.array_compact(added), 1, most)).otherwise(F.array().cast("array<string>"))


def swapped_particles(query: Column, most: int = 2) -> Column:
    """The query with particles in place of their likes; the first ``most`` that differ from it."""
    out = F.array(*[F.regexp_replace(query, rf"([\p{{L}}\p{{N}}_]+){a}", f"$1{b}") for a, b in SWAPS])
    return F.slice(F.filter(F.array_distinct(out), lambda q: q != query), 1, most)


def cleaned(query: Column) -> Column:
    """Without the endings of questions, squeezed."""
    for pattern, standing in ENDINGS:
        query = F.regexp_replace(query, pattern, standing)
    return squeeze(query)


def analysis(query: Column) -> Column:
    """struct tokens, has_numbers, has_codes, has_amounts, length."""
    return F.struct(
        F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda x: x != "")).alias("tokens"), query.rlike(r"\d").alias("has_numbers"), query.rlike(MODEL_CODE).alias("has_codes"),
        query.rlike(AMOUNT).alias("has_amounts"), F.length(query).alias("length"),
    )


def named_file(query: Column) -> Column:
    """The dated file name in a query, with ``.pdf``."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(query, p, 1), F.lit("")) for p in DATED_FILE])
    return F.when(F.lower(found).endswith(".pdf"), found).otherwise(F.concat(found, F.lit(".pdf")))


def keyword_weight(text: Column, query: Column, weights: dict[str, float], each: float = 0.3) -> Column:
    """0 to 1: for each weighed word of the query its weight times ``each`` for each time it stands in the text, at most the weight."""
    q, t = F.lower(query), F.lower(text)
    got, most = F.lit(0.0), F.lit(0.0)
    for word, weight in weights.items():
        asked = q.contains(word)
        times = (F.length(t) - F.length(F.replace(t, F.lit(word), F.lit("")))) / len(word)
        got = got + F.when(asked, F.least(F.lit(weight), times * (weight * each))).otherwise(0.0)
        most = most + F.when(asked, F.lit(weight)).otherwise(0.0)
    return F.when(most > 0, F.least(F.lit(1.0), got / most)).otherwise(0.0)


