"""Amounts and keywords by places: against plain Python over whole texts."""

import re
from decimal import ROUND_HALF_EVEN, Decimal

import pytest

from quern.functions import money as M
from quern.operators import amounts as A

PARTS = ["1억 2,300만 원", "5천만원", "합계", "총액:", "단가", "333,000원 × 2EA", "2000개", "₩1 234 567", "3.5억", "120만", "45.000.000", "999", "0,000", "1,2억", "12,345 12,345", "a" * 50, "İ", "\n", "TOTAL", "total", "１２３４", "1234567890123456789012"]


def number(text, unit):
    return int((Decimal(text.replace(",", "") or "0") * unit).to_integral_value(ROUND_HALF_EVEN))


def amounts_in(text):
    found = []
    for m in re.finditer(M.EOK_MAN, text):
        man = number(m[2], 10**4) if m[2] else 0
        found.append((number(m[1], 10**8) + man, m.start(), m.end(), "eok+man" if man else "eok"))
    within = lambda at: any(s <= at < e for _, s, e, _ in found)
    found += [(number(m[1], 10**4), m.start(), m.end(), "man") for m in re.finditer(M.MAN, text) if not within(m.start())]
    found = [c for c in found if 1000 <= c[0] < 2**63]
    for m in re.finditer(M.WON, text):
        value = int(re.sub(r"\D", "", m[0]))
        if 1000 <= value < 2**63 and re.fullmatch(r"[0-9]*", re.sub(r"\D", "", m[0])) and not within(m.start()):
            found.append((value, m.start(), m.end(), "krw"))
    return found


def nearest(text, keywords):
    places = [(m.start(), n, w) for n, w in enumerate(keywords) for m in re.finditer(re.escape(w), text, re.IGNORECASE)]
    best = None
    for value, start, end, kind in amounts_in(text):
        near = min(((abs(start - at), n, w) for at, n, w in places), default=None)
        if near is None or near[0] > 80:
            continue
        weight = 1.5 if "총액" in near[2] or "합계" in near[2] else 0.8 if "단가" in near[2] else 1.0
        sure = round(min(1.0, weight / (1 + near[0]) * (1 + start / len(text) * 0.1)), 9)
        if best is None or sure > best[-1]:
            best = (value, start, end, kind, text[max(0, start - 40) : end + 40], near[0], sure)
    return best


@pytest.mark.parametrize(("text", "expected"), [("1억 2,300만 원", [(123000000, "eok+man")]), ("12만대 5000", [(5000, "krw")]), ("3.5억", [(350000000, "eok")]), ("500", []), ("1,234,567원", [(1234567, "krw")])])
def test_brute_force_is_right(text, expected):
    assert [(v, k) for v, _, _, k in amounts_in(text)] == expected


@pytest.fixture(scope="module")
def rows():
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) + rng.choice([" ", "", "  ", "\n"]) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    return [*enumerate(texts), (200, None), (201, ""), (202, "합계 5000 " * 2000), (3, texts[3]), (3, texts[4]), (None, texts[5])]


def test_amounts(spark, rows):
    found = A.amounts(A.with_key(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    wanted = {(d, *c) for d, t in rows for c in amounts_in(t or "")}
    assert {(r["doc_id"], r["value"], r["start"], r["end"], r["kind"]) for r in found} == wanted


def test_nearest(spark, rows):
    keywords = ["총액", "합계", "단가", "total", "tot"]
    found = A.nearest_amounts(spark.createDataFrame(rows, "doc_id bigint, text string"), keywords).collect()
    wanted = {(d, t): nearest(t or "", keywords) for d, t in rows}
    plain = sorted(str((d, *w)) for (d, _), w in wanted.items() if w)
    assert sorted(str((r["doc_id"], r["value"], r["start"], r["end"], r["kind"], r["context"], r["distance"], r["confidence"])) for r in found) == plain


def test_document_amount(spark):
    texts = [("333,000원 x 2", 666000), ("5,000 20,000 30,000 40,000", 30000), ("1,000", None), ("200,000,000", None), (None, None)]
    found = A.document_amounts(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id bigint, text string"))
    assert {r["doc_id"]: r["amount"] for r in found.collect()} == {k: v for k, (_, v) in enumerate(texts)}
