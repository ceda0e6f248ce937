"""Amounts of money in documents, and the one nearest to a keyword: joins over places in a text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import money as M

KEY = ["doc_id", "text_key"]
#: Characters around an amount that tell its context, and how far a keyword can be from it.
CONTEXT, NEAR = 40, 80


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: rows of one doc_id with unlike texts stay apart; a null text is an empty one."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.md5("text"))


def places(docs: DataFrame, pattern: str, groups: int = 0) -> DataFrame:
    """KEY, start, end, g (the groups, the whole match first) of every match of a pattern in ``text``, in code points from 0.

    What stands between the matches tells where they are, so positions are sums over the pieces before.
    """
    found = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in range(groups + 1)]
    cut = docs.filter(F.col("text").rlike(pattern)).select(*KEY, F.split("text", pattern, -1).alias("gaps"), *[x.alias(f"g{g}") for g, x in enumerate(found)])
    names = ["gaps", *(f"g{g}" for g in range(groups + 1))]
    rows = cut.select(*KEY, F.posexplode(F.arrays_zip(*names)).alias("k", "m")).filter("m.g0 IS NOT NULL")
    rows = rows.repartition(*KEY).dropDuplicates([*KEY, "k"])  # of repeated rows; the windows find the rows together
    rows = rows.select(*KEY, "k", F.length("m.gaps").alias("gap"), F.length("m.g0").alias("n"), F.array(*[F.col(f"m.g{g}") for g in range(groups + 1)]).alias("g"))
    before = Window.partitionBy(*KEY).orderBy("k")
    end = F.sum(F.col("gap") + F.col("n")).over(before)
    return rows.select(*KEY, (end - F.col("n")).cast("int").alias("start"), end.cast("int").alias("end"), "g")


def _number(g: Column, unit: int) -> Column:
    digits = F.regexp_replace(F.coalesce(g, F.lit("")), ",", "")
    return F.bround(F.when(digits == "", F.lit(0).cast("decimal(28,6)")).otherwise(digits.try_cast("decimal(28,6)")) * F.lit(unit), 0).try_cast("bigint")


def amounts(docs: DataFrame) -> DataFrame:
    """KEY, value, start, end, kind of every amount of 1,000 or more in documents (``with_key``).

    Kinds: ``eok``, ``eok+man`` and ``man`` by their units, ``krw`` for plain numbers. A number in units that begins within one of 억, and
    a plain number that begins within one in units, is no other amount. Numbers of more than 18 digits are left out.
    """
    man = _number(F.col("g")[2], 10**4)
    eok = places(docs, "(?U)" + M.EOK_MAN, 2).select(*KEY, "start", "end", (_number(F.col("g")[1], 10**8) + man).alias("value"), F.when(man > 0, "eok+man").otherwise("eok").alias("kind"))
    some = places(docs, "(?U)" + M.MAN, 1).select(*KEY, "start", "end", _number(F.col("g")[1], 10**4).alias("value"), F.lit("man").alias("kind"))
    plain = places(docs, "(?U)" + M.WON).select(*KEY, "start", "end", F.regexp_replace(F.col("g")[0], r"(?U)\D", "").try_cast("bigint").alias("value"), F.lit("krw").alias("kind"))
    rows = eok.unionByName(some).unionByName(plain)
    # The furthest end of what began before; at one place units come first.
    turn = F.when(F.col("kind") == "man", 1).when(F.col("kind") == "krw", 2).otherwise(0)
    sofar = Window.partitionBy(*KEY).orderBy("start", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = lambda of: F.coalesce(F.max(F.when(of, F.col("end"))).over(sofar), F.lit(-1))
    rows = rows.withColumn("turn", turn).withColumn("within_eok", ended(F.col("turn") == 0) > F.col("start"))
    rows = rows.filter("(turn <> 1 OR NOT within_eok) AND value >= 1000").withColumn("within", ended(F.col("turn") < 2) > F.col("start"))
    return rows.filter("turn < 2 OR NOT within").select(*KEY, "value", "start", "end", "kind")


def nearest_amounts(docs: DataFrame, keywords: list[str], later: bool = True) -> DataFrame:
    """doc_id, value, start, end, kind, context, distance, confidence: of each document the amount nearest to a keyword, within ``NEAR`` characters.

    Keywords (of any case) and amounts are events in order of their places. The last keyword before and the first one behind an amount are its
    neighbours; the nearer one counts, of two at one distance that which stands first in ``keywords``. A keyword weighs 1.5 for a total, 0.8 for a unit price,
    else 1; the weight over 1 + distance, raised by up to a tenth towards the end of the text (else the beginning), is the confidence (1 at most).
    Rows of one doc_id with unlike texts have a row each, repeated rows one.
    Of equals an amount in units of 억 comes before one of 만 and a plain one, then the earlier. Documents without such an amount have no row.
    """
    keyed = with_key(docs)
    words = [places(keyed, f"(?iu){re.escape(w)}").select(*KEY, F.col("start").alias("place"), F.lit(n).alias("n")) for n, w in enumerate(keywords)]
    there = words[0]
    for w in words[1:]:
        there = there.unionByName(w)
    there = there.groupBy(*KEY, "place").agg(F.min("n").alias("n"))
    none = F.lit(None)
    events = there.select(*KEY, "place", F.struct("place", "n").alias("word"), none.cast("struct<value: bigint, start: int, end: int, kind: string>").alias("amount"))
    own = amounts(keyed).select(*KEY, F.col("start").alias("place"), none.cast("struct<place: int, n: int>").alias("word"), F.struct("value", "start", "end", "kind").alias("amount"))
    at = Window.partitionBy(*KEY).orderBy("place")
    near = events.unionByName(own).select(
        *KEY, "amount", F.last("word", ignorenulls=True).over(at.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("left"),
        F.first("word", ignorenulls=True).over(at.rangeBetween(Window.currentRow, Window.unboundedFollowing)).alias("right"),
    ).filter("amount IS NOT NULL")
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("amount.start") - F.col(f"{c}.place")).alias("distance"), F.col(f"{c}.n").alias("n")))
    near = near.select(*KEY, "amount", F.least(side("left"), side("right")).alias("word")).filter(F.col("word.distance") <= NEAR)
    weights = F.array(*[F.lit(1.5 if "총액" in w or "합계" in w else 0.8 if "단가" in w else 1.0) for w in keywords])
    texts = keyed.dropDuplicates(KEY).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "text")
    sized = near.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")))  # texts of the documents that have one
    share = F.col("amount.start") / F.length("text")
    sure = F.least(F.lit(1.0), weights[F.col("word.n")] / (F.lit(1) + F.col("word.distance")) * (1 + (share if later else 1 - share) * 0.1))
    context = F.substring("text", F.greatest(F.col("amount.start") - CONTEXT, F.lit(0)) + 1, F.col("amount.end") + CONTEXT - F.greatest(F.col("amount.start") - CONTEXT, F.lit(0)))
    turn = F.when(F.col("amount.kind") == "man", 1).when(F.col("amount.kind") == "krw", 2).otherwise(0)
    rows = sized.select(*KEY, "amount.*", context.alias("context"), F.col("word.distance").alias("distance"), F.round(sure, 9).alias("confidence"), turn.alias("turn"))
    best = Window.partitionBy(*KEY).orderBy(F.desc("confidence"), "turn", "start")
    return rows.withColumn("best", F.row_number().over(best)).filter("best = 1").drop("best", "turn", "text_key")


def document_amounts(docs: DataFrame) -> DataFrame:
    """doc_id, amount of every document: the line items' total, else the upper median of the amounts from 10,000 up to 10 million; null if there is none that the guard lets pass."""
    keyed = with_key(docs)
    usual = amounts(keyed).filter("value >= 10000 AND value < 10000000")
    order = Window.partitionBy(*KEY).orderBy("value")
    middle = usual.select(*KEY, "value", F.row_number().over(order).alias("turn"), F.count("*").over(Window.partitionBy(*KEY)).alias("n")).filter("turn = floor(n / 2) + 1")
    items = keyed.select(*KEY, M.items_total(M.line_items(F.col("text"))).alias("items"))
    found = middle.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "value")
    return items.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left").select("doc_id", M.guarded(F.coalesce("items", "value")).alias("amount"))


def prose_amounts(docs: DataFrame) -> DataFrame:
    """doc_id, total, kind, amount, formatted, position: the document's amount (``validated_total``, position 0) if the guard lets it pass, else all its candidates, largest first as ``turn`` says."""
    keyed = with_key(docs).dropDuplicates(KEY)
    total = document_amounts(keyed).filter("amount IS NOT NULL").select("doc_id", F.col("amount").alias("total"))
    won = lambda c: F.concat(F.lit("₩"), F.format_number(c, 0))
    sure = total.select("doc_id", "total", F.lit("validated_total").alias("kind"), F.col("total").alias("amount"), won(F.col("total")).alias("formatted"), F.lit(0).alias("position"))
    rest = amounts(keyed).join(total.select(F.col("doc_id").alias("_doc")), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti")
    rest = rest.select("doc_id", F.lit(None).cast("bigint").alias("total"), F.lit("candidate").alias("kind"), F.col("value").alias("amount"), won(F.col("value")).alias("formatted"), F.col("start").alias("position"))
    return sure.unionByName(rest).withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("amount"), "position")))


def reindex_targets(lines: DataFrame) -> DataFrame:
    """doc_id, path from lines (value) ``id<tab>path``; blank lines, comments (``#``) and lines without a path are left out."""
    own = lines.select(F.trim("value").alias("v")).filter("v <> '' AND NOT startswith(v, '#')").select(F.split("v", "\t").alias("p")).filter("size(p) >= 2")
    return own.select(F.trim(F.col("p")[0]).cast("bigint").alias("doc_id"), F.trim(F.col("p")[1]).alias("path"))


def reindexed(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``documents`` (doc_id, text, amount, ...) with the amounts of the targets (doc_id) found anew, null where there is none, and a report: doc_id, amount, ok.

    Targets that are in no document are reported as not ok; other documents stay as they are.
    """
    wanted = targets.select("doc_id").distinct()
    anew = document_amounts(documents.join(wanted, "doc_id", "left_semi")).groupBy("doc_id").agg(F.max("amount").alias("_amount"))
    marked = anew.withColumn("_anew", F.lit(True))
    out = documents.join(marked, "doc_id", "left").withColumn("amount", F.when(F.col("_anew"), F.col("_amount")).otherwise(F.col("amount"))).select(*documents.columns)
    report = wanted.join(anew, "doc_id", "left").select("doc_id", F.col("_amount").alias("amount"), F.col("_amount").isNotNull().alias("ok"))
    return out, report


def padded_codes(codes: DataFrame) -> DataFrame:
    """Codes with ``padded_norm``, the normalised code between spaces, for whole-word look-ups; codes that have it stay as they are."""
    padded = F.concat(F.lit(" "), F.col("norm_code"), F.lit(" "))
    return codes.withColumn("padded_norm", F.coalesce("padded_norm", padded) if "padded_norm" in codes.columns else padded)
