"""Cost tables in documents: lines, cells and columns as arrays of a row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money as M

#: fixed values: what tells a line of headers, and the words of each column
HEADERS = ("(품목|모델|품명)", "(수량)", "(단가)", "(금액|합계)", "(비고|규격|사양)")
KEYS = ("수량", "단가", "금액", "합계", "품목", "모델", "품명")
COLUMNS = (("name", "품목|모델|품명"), ("quantity", "수량"), ("unit_price", "단가"), ("amount", "금액|합계"))
ENDS = "합계|총액"
VAT = r"(?i)(?:부가세|VAT|세액)\s*[:\s]+([\d,\.]+)\s*(원|만원|억|억원|KRW|₩)?"
#: Lines that a header can be in; a header of a table stands near the beginning.
SCANNED = 300


def cells(line: Column) -> Column:
    """The cells of a line, parted by two spaces or more; bars and tabs count as a space."""
    spaced = F.regexp_replace(F.regexp_replace(line, r"[|\t]", " "), r"\s{2,}", "  ")
    return F.filter(F.transform(F.split(spaced, "  "), lambda c: F.trim(c)), lambda c: c != "")


def misspelt(key: str) -> str:
    """Cells that are like a key of two letters: both in order, with one character more.

    The matching ratio, twice the letters in common over all letters, is 0.8 then, and below 0.7 for any longer cell or with one letter alone.
    """
    a, b = key
    return f"(?s)(?:.{a}{b}|{a}.{b}|{a}{b}.)"


def header_score(line: Column) -> Column:
    """How many kinds of headers a line has, else 0.8 for one that is misspelt; 0 unless it has two to ten cells."""
    own = cells(line)
    kinds = sum((line.rlike(p).cast("double") for p in HEADERS), F.lit(0.0))
    near = F.exists(own, lambda c: c.rlike("^(?:" + "|".join(misspelt(k) for k in KEYS) + ")$"))
    return F.when(F.size(own).between(2, 10), F.when(kinds > 0, kinds).when(near, 0.8).otherwise(0.0)).otherwise(0.0)


def _columns(header: Column) -> Column:
    """struct of the place (from 1) of each column in a header's cells: a cell has the first kind whose words it holds, a kind its last cell."""
    kind = lambda c: F.coalesce(*[F.when(c.rlike(p), F.lit(n)) for n, p in COLUMNS])
    kinds = F.transform(header, kind)
    last = lambda n: F.array_max(F.transform(kinds, lambda k, i: F.when(k == n, i + 1)))
    return F.struct(*[last(n).alias(n) for n, _ in COLUMNS])


def cost_tables(docs: DataFrame) -> DataFrame:
    """doc_id, header, items, total, claimed_total, vat, sum_match, parse_status, reason of documents (doc_id, text).

    The header is the line with the best score among the first ``SCANNED``, the first of equals. Items are the lines of two cells or more
    after it, up to a line of fewer cells once there are some, or one with a total, which is the last. An item without an amount gets quantity x unit price. Sums match
    within 1 won or 1 %, with VAT as well where it is named. Status: ``failed`` without a header, ``partial`` without items or with sums that differ, else ``success``. A null text is an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n").alias("lines"))
    scored = F.transform(F.slice("lines", 1, SCANNED), lambda x, i: F.struct((-header_score(x)).alias("minus"), (i + 1).alias("at")))
    rows = rows.withColumn("best", F.array_min(scored)).withColumn("h", F.when(F.col("best.minus") <= -0.7, F.col("best.at")))
    rows = rows.withColumn("header", F.when(F.col("h").isNotNull(), cells(F.element_at("lines", F.coalesce("h", F.lit(1))))))
    after = F.transform(F.slice("lines", F.coalesce("h", F.lit(0)) + 1, F.size("lines")), lambda x: F.struct(x.alias("line"), cells(x).alias("cells")))
    rows = rows.withColumn("after", F.when(F.col("h").isNotNull(), after).otherwise(F.array().cast("array<struct<line: string, cells: array<string>>>")))
    good = lambda c: F.transform(c, lambda x: F.size(x["cells"]) >= 2)
    start = F.array_position(good(F.col("after")), True)
    rows = rows.withColumn("after", F.when(start > 0, F.slice("after", F.greatest(start, F.lit(1)).cast("int"), F.size("after"))).otherwise(F.slice("after", 1, 0)))
    stop = lambda p: F.when(p > 0, p)
    fewer = stop(F.array_position(good(F.col("after")), False)) - 1
    last = stop(F.array_position(F.transform("after", lambda x: x["line"].rlike(ENDS)), True))
    rows = rows.withColumn("after", F.slice("after", 1, F.least(F.size("after"), fewer, last).cast("int"))).withColumn("c", _columns(F.col("header")))

    def item(x: Column) -> Column:
        cell = lambda n: F.when(F.col(f"c.{n}") <= F.size(x["cells"]), F.try_element_at(x["cells"], F.col(f"c.{n}")))
        quantity, price, amount = (M.normalize_number(cell(n)) for n in ("quantity", "unit_price", "amount"))
        return F.struct(F.coalesce(cell("name"), x["cells"][0]).alias("name"), quantity.alias("quantity"), price.alias("unit_price"), F.coalesce(amount, F.try_multiply(quantity, price)).alias("amount"))

    rows = rows.withColumn("items", F.transform("after", item)).drop("after", "lines", "best")
    total = F.aggregate("items", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["amount"], F.lit(0)))
    vat = M.normalize_number(F.nullif(F.concat(F.regexp_extract("text", VAT, 1), F.regexp_extract("text", VAT, 2)), F.lit("")))
    rows = rows.withColumns({"total": total, "claimed_total": M.claimed_total(F.col("text")), "vat": vat})
    near = lambda a: F.abs(a - F.col("claimed_total")) <= F.greatest(F.lit(1), F.floor(F.col("claimed_total") * 0.01))
    match = F.when(F.col("claimed_total").isNull(), True).otherwise(near(F.col("total")) & F.when(F.col("vat").isNull(), True).otherwise(near(F.col("total") + F.col("vat"))))
    some = F.size("items") > 0
    reason = F.when(F.col("h").isNull(), "header_not_found").when(~some, "items_empty").when(~match, "sum_mismatch")
    status = F.when(F.col("h").isNull(), "failed").when(~some | ~match, "partial").otherwise("success")
    only = lambda c: F.when(some, c)
    return rows.select("doc_id", "header", "items", F.when(some, F.col("total")).otherwise(0).alias("total"), only(F.col("claimed_total")).alias("claimed_total"), only(F.col("vat")).alias("vat"), only(match).alias("sum_match"), status.alias("parse_status"), reason.alias("reason"))
