"""Amounts of money in text: integers of won, through decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: patterns of amounts, with 억 (10^8) and 만 (10^4)
EOK_MAN = r"([\d,]+(?:\.\d+)?)\s*억(?:\s*([\d,]+(?:\.\d+)?)\s*만)?"
MAN = r"([\d,]+(?:\.\d+)?)\s*만(?![가-힣\w])"
WON = r"(?<!\d)(?:₩\s*)?(?:\d{1,3}(?:[,.\s]\d{3})+|\d{4,})\s*(?:원)?"
ITEM = r"((?:₩\s*)?(?:\d{1,3}(?:[,.\s]\d{3})+|\d{4,}))\s*(?:원)?\s*[xX×＊]\s*(\d+)"


def line_items(text: Column) -> Column:
    """array of (price, quantity): 10,000 to 5,000,000 each, 1 to 50 of them."""
    prices = F.transform(F.regexp_extract_all(text, F.lit(ITEM), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", "").try_cast("bigint"))
    counts = F.transform(F.regexp_extract_all(text, F.lit(ITEM), F.lit(2)), lambda x: x.try_cast("bigint"))
    pairs = F.zip_with(prices, counts, lambda p, q: F.struct(p.alias("price"), q.alias("quantity")))
    return F.filter(pairs, lambda x: x["price"].between(10_000, 5_000_000) & x["quantity"].between(1, 50))


def items_total(items: Column) -> Column:
    """The sum, null unless 100,000 to 50,000,000."""
    total = F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + x["price"] * x["quantity"])
    return F.when(total.between(100_000, 50_000_000), total)


def guarded(amount: Column) -> Column:
    """null from 100 million on and below 1,000."""
    return F.when((amount >= 1000) & (amount < 100_000_000), amount)


def format_won(amount: Column) -> Column:
    return F.concat(F.format_number(amount, 0), F.lit("원"))


def normalize_number(cell: Column) -> Column:
    """The integer of a cell: 억, 만, 천만 and 백만 units with 원 or without, plain numbers, digits with spaces between."""
    s = F.regexp_replace(F.trim(cell), r"(\d)\s+(?=\d)", "$1")
    number = r"([\d,]+(?:\.\d+)?)\s*"
    of = lambda p: F.try_to_number(F.nullif(F.regexp_replace(F.regexp_extract(s, p, 1), ",", ""), F.lit("")), F.lit("999999999999D9999"))
    part = lambda p, unit: F.coalesce(of(p).cast("decimal(24,4)") * F.lit(unit).cast("decimal(14,0)"), F.lit(0).cast("decimal(24,4)"))
    unit = part(number + "억", 10**8) + part(number + "천만", 10**7) + part(number + "백만", 10**6) + part(number + "만", 10**4)
    plain = F.regexp_replace(s, r"[^\d.]", "")
    digits = F.try_to_number(F.nullif(F.regexp_replace(F.regexp_replace(plain, r"\..*$", ""), r"\D", ""), F.lit("")), F.lit("999999999999999"))
    return F.when(s.rlike(r"\d\s*(억|천만|백만|만)"), F.round(unit, 0).cast("bigint")).otherwise(digits.cast("bigint"))


def claimed_total(text: Column) -> Column:
    """The amount behind a label of a total, 10,000 at least; null where the total is of pieces."""
    pattern = r"(?:비용\s*합계|합계\s*\(VAT\s*별도\)|합계(?!\s*검증)|총계)\s*[:\s]*(?:₩|KRW)?\s*([\d\.,]+)"
    found = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")
    value = F.when(found.rlike(r"^\d{1,18}$"), found.cast("bigint"))
    return F.when(~text.rlike(r"합계\s*[\d,]+\s*개(?![가-힣\w])") & (value >= 10_000), value)


def sum_match(total: Column, claimed: Column, vat: Column, strict: bool = False) -> Column:
    """Whether the items' total is what is claimed, to 1 won or 1 %, with or without VAT (``strict``: both)."""
    near = lambda a: F.abs(a - claimed) <= F.greatest(F.lit(1.0), 0.01 * claimed)
    with_vat = near(total + vat)
    return F.when(claimed.isNull() | total.isNull(), None).when(vat.isNull(), near(total)).otherwise(near(total) & with_vat if strict else near(total) | with_vat)


def financial_consistency(unit: Column, quantity: Column, amount: Column, vat: Column, total: Column, mode: Column) -> Column:
    """Names of the checks that fail: unit x quantity (5 %), VAT of a tenth (2 %), total by VAT mode (1.5 %)."""
    far = lambda a, b, share: F.abs(a - b) > F.abs(b) * share
    expected = F.when(mode == "excluded", amount + F.coalesce(vat, F.lit(0))).otherwise(amount)
    return F.array_compact(F.array(F.when(far(unit * quantity, amount, 0.05), F.lit("unit_x_quantity")), F.when(far(vat * 10, amount, 0.02), F.lit("vat")), F.when(far(total, expected, 0.015), F.lit("total"))))
