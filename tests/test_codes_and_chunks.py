"""Codes in texts against Python's expressions, chunks by what they must hold, and the cascade on a few documents."""

import random
import re

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import context as X
from quern.operators import retrieval as R
from quern.plans.cascade import cascade


def codes_of(text):
    clean = (text or "").translate({ord(c): "-" for c in T.DASHES})
    shapes = [*T.CODE_SHAPES, rf"(?i)((?<![A-Z0-9])(?:{'|'.join(T.CODE_PREFIXES)})[A-Z0-9]{{1,12}}(?![A-Z0-9]))"]
    found = dict.fromkeys(m[1] for p in shapes for m in re.finditer(p, clean, re.ASCII))
    kept = [c for c in found if re.search(r"\d", c, re.ASCII) and re.sub("[^A-Z0-9]", "", c.upper()) not in T.NOT_CODES]
    return sorted(kept, key=lambda c: (-len(c), c))


def test_codes(spark):
    rng = random.Random(1)
    parts = ["XRN-1620B2", "lvm", "180a", "DeckLink", "4K", "Extreme", "12G", "코드", "LVM180A", "THIS-1", "a", "–", "/", "FX3", "COM/GW", "AP", "9", "HD", "x2", "는", ",", "GS724Tv6"]
    texts = [None, "", *("".join(rng.choice(parts) + rng.choice(["", " ", "  ", "-", "/"]) for _ in range(rng.randint(1, 9))) for _ in range(300))]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.extract_codes(F.col("t")).alias("c")).collect()
    assert {r["k"]: r["c"] or [] for r in found} == {k: codes_of(t) for k, t in enumerate(texts)}


def weight(s):
    return max(len(re.findall("[가-힣]", s)), len(s.split()))


def test_chunks():
    rng = random.Random(2)
    for _ in range(100):
        sentences = [" ".join(f"w{k}x{rng.randint(0, 9)}" for _ in range(rng.randint(1, 30))) + "." for k in range(rng.randint(0, 40))]
        chunks = X.chunks_of(" ".join(sentences), size=60, overlap=20, least=10)
        at = 0
        for n, c in enumerate(chunks):
            own = re.split(r"(?<=\.)\s+", c)
            first = sentences.index(own[0])
            assert own == sentences[first : first + len(own)]  # whole sentences, in order
            assert first <= at and (n == 0 or sum(map(weight, sentences[first:at])) <= 20)  # the overlap
            assert weight(c) <= 60 + 10 or len(own) == 1 or n == len(chunks) - 1
            at = first + len(own)
        assert at == len(sentences)


def test_cascade(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "LVM-180A, lens repair", "kim"), (2, "LVM180A_manual.pdf", "nothing", "lee"), (3, "b.pdf", "lens cost of the lens", "kim"), (4, "c.pdf", "other words", None)], "doc_id bigint, filename string, text string, drafter string")
    codes = docs.select("doc_id", F.explode(F.transform(T.extract_codes(F.col("text")), T.normalize_code)).alias("norm_code"))
    asked = spark.createDataFrame([(1, "LVM-180A"), (2, "lens"), (3, "absent")], "query_id bigint, query string")
    found = {}
    for r in cascade(docs, codes, asked, k=4, index=R.Index(docs)).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["stage"]))
    assert sorted(found[1]) == [(1, 0), (2, 0)]  # codes alone
    assert sorted(found[2]) == [(1, 1), (3, 1)] and 3 not in found  # words
    scores = cascade(docs, codes, asked, k=4, index=R.Index(docs)).filter("query_id = 2").orderBy("rank").collect()
    assert [r["rank"] for r in scores] == [1, 2] and scores[0]["score"] >= scores[1]["score"]
