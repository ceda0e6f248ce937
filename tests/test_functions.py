"""Functions against small tables of expected values and against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import documents as D
from quern.functions import money as M
from quern.functions import queries as Q
from quern.functions import text as T
from quern.operators import context as X
from quern.operators import evaluate as E
from quern.operators import retrieval as R


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(column(F.col("t"))).collect()]


def test_numbers(spark):
    assert values(spark, M.normalize_number, "1,234,567", "1 234 567", "₩ 1,234,567 원", "abc", "5천만", "1,200만원", None) == [1234567, 1234567, 1234567, None, 50_000_000, 12_000_000, None]
    assert values(spark, M.claimed_total, "합계: 1,000,000원", "합계 2000개", "총계 9,999", "비용 합계 50,000") == [1_000_000, None, None, 50_000]


def test_codes(spark):
    assert values(spark, T.code_variants, "XRN-1620B2") == [["XRN 1620B2", "XRN-1620B2", "XRN1620B2"]]
    assert values(spark, T.extract_codes, "코드LVM180A는, GS724Tv6")[0] == ["GS724Tv6", "LVM180A"]
    assert values(spark, T.filename_key, "a b (1).PDF", "a-b_1.pdf", "a_b.pdf") == ["a_b.pdf"] * 3


def test_unicode(spark):
    assert values(spark, T.nfkc, "ＡＢＣ①", None) == ["ABC1", None]
    assert values(spark, T.strip_accents, "éàü") == ["eau"]
    df = spark.createDataFrame([("홍길동", "홍길동"), ("홍길동", "홍길둥"), (None, "x")], "a string, b string")
    ratios = [r[0] for r in df.select(T.jamo_ratio("a", "b")).collect()]
    assert ratios[0] == 1.0 and 0.7 < ratios[1] < 1 and ratios[2] is None


def test_dates(spark):
    assert values(spark, D.normalize_date, "2024/1/5", "24. 1. 5", "20240105", "2024년 1월 5일", "x") == ["2024-01-05"] * 4 + ["x"]
    assert values(spark, D.preferred_ip, "8.8.8.8 and 192.168.0.1", "8.8.8.8", "none") == ["192.168.0.1", "8.8.8.8", None]


def test_routes(spark):
    got = [r.asDict() for r in values(spark, Q.route, "2024년 총액은?", "이 문서 요약해줘", "2024년 문서 목록 보여줘", "이 파일", "hello")]
    assert [g["mode"] for g in got] == ["COST", "DOCUMENT", "SEARCH", "SEARCH", "QA"]
    assert [g["confidence"] for g in got] == [0.95, 0.9, 0.9, 0.7, 0.5]


def test_keys(spark):
    a, b, c = values(spark, Q.smart_key, "LVM-180A  사양?", "lvm 180a 사양", "lvm 180b 사양")
    assert a == b != c and len(a) == 16


def test_json():
    assert D.last_json('x {"s": "a } b"} {"t": [1,],}') == '{"t":[1]}'
    assert D.last_json("{") is None and D.last_json("") is None


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab .\n가나", max_size=200))
def test_chunks_keep_words(text):
    chunks = X.chunks_of(text, 5, 1, 2)
    assert set(" ".join(chunks).split()) == set(text.split())


def test_quantiles(spark):
    df = spark.createDataFrame([([float(x) for x in range(1, 21)],)], "v array<double>")
    p, q = df.select(E.index_percentile(F.col("v"), 0.95), E.exclusive_quantile(F.col("v"), 0.95)).first()
    assert p == 20.0 and q == pytest.approx(19.95)


def test_bm25_by_hand(spark):
    import math

    texts = {1: "alpha beta beta", 2: "alpha gamma", 3: "delta", 4: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: r.score for r in R.bm25(R.Index(docs), spark.createDataFrame([(1, "beta alpha beta")], "query_id int, text string"), idf="lucene").collect()}
    lists = {d: t.split() for d, t in texts.items()}
    mean = sum(map(len, lists.values())) / 4
    expected = {}
    for d, words in lists.items():
        s = 0.0
        for t in ["beta", "alpha", "beta"]:
            df, tf = sum(t in w for w in lists.values()), words.count(t)
            s += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean)) if tf else 0
        if s > 0:
            expected[d] = round(s, 6)
    assert got == pytest.approx(expected)


def test_tokens_need_no_python(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(T.tokens(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow", plan)
