"""The document table: filters, lookups, counts, deduplication, sets and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def filtered(docs: DataFrame, drafter: str | None = None, year: str | None = None, category: str | None = None, dates: tuple[str, str] | None = None) -> DataFrame:
    """Any of: drafter contains, year (or a range ``a-b``) of either date, category contains, date between."""
    out = docs
    if drafter:
        out = out.filter(F.col("drafter").contains(drafter))
    if year:
        lo, _, hi = year.partition("-")
        of = lambda c: F.try_to_number(F.left(c, F.lit(4)), F.lit("9999")).between(int(lo), int(hi or lo))
        out = out.filter(F.coalesce(of(F.col("date")), F.lit(False)) | F.coalesce(of(F.col("display_date")), F.lit(False)) if "display_date" in docs.columns else of(F.col("date")))
    if category:
        out = out.filter(F.col("category").contains(category))
    if dates:
        out = out.filter(F.col("date").between(*dates))
    return out


def newest(docs: DataFrame, n: int, key: str = "doc_id", *dates: str) -> DataFrame:
    """The n newest by the first date that there is; ties by key."""
    return docs.orderBy(F.coalesce(*(dates or ("date",))).desc_nulls_last(), key).limit(n)


def nocase(docs: DataFrame, column: str, value: str) -> DataFrame:
    return docs.filter(F.lower(column) == value.lower())


def fuzzy_slug(docs: DataFrame, value: str, column: str = "filename") -> DataFrame:
    """The row whose name, without signs, contains the value or is in it; the least difference in length wins."""
    slug = F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]", "")
    wanted = F.regexp_replace(F.lower(F.lit(value)), r"[^\p{L}\p{N}]", "")
    near = docs.withColumn("_s", slug).filter(F.col("_s").contains(wanted) | wanted.contains(F.col("_s")))
    return near.orderBy(F.abs(F.length("_s") - F.length(wanted)), "doc_id").limit(1).drop("_s")


def title_lookup(docs: DataFrame, title: str, column: str = "title") -> DataFrame:
    """Exact title, else one that begins with it, else one that holds it."""
    rank = F.when(F.col(column) == title, 1).when(F.col(column).startswith(title), 2).when(F.col(column).contains(title), 3)
    return docs.withColumn("_r", rank).filter("_r is not null").orderBy("_r", "doc_id").limit(1).drop("_r")


def missing_fields(docs: DataFrame, *fields: str) -> DataFrame:
    """doc_id, missing: the names of blank fields, of rows that have any."""
    names = F.concat_ws(", ", *[F.when(blank(c), F.lit(c)) for c in fields])
    return docs.select("doc_id", names.alias("missing")).filter("missing <> ''")


def amount_band(amount: Column) -> Column:
    """missing, high (100 million or more), low (1 to 999) or ok."""
    return F.when(amount.isNull() | (amount == 0), "missing").when(amount >= 100_000_000, "high").when(amount.between(1, 999), "low").otherwise("ok")


def thin_texts(docs: DataFrame, least: float, chars: Column, pages: Column) -> DataFrame:
    """Documents with fewer characters a page than ``least``, the thinnest first."""
    return docs.withColumn("ratio", F.try_divide(chars.cast("double"), F.nullif(pages, F.lit(0)).cast("double"))).filter(F.col("ratio") < least).orderBy("ratio", "doc_id")


def category_of(filename: Column, words: dict[str, str], known: Column | None = None, default: str = "general") -> Column:
    """The first word's category that the file name holds, else the known one, else the default."""
    out = F.coalesce(known, F.lit(default)) if known is not None else F.lit(default)
    for word, category in reversed(words.items()):
        out = F.when(filename.contains(word), F.lit(category)).otherwise(out)
    return out


def first_of_key(df: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in the order."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def priority_union(key: str, *sources: DataFrame) -> DataFrame:
    """All sources' rows, of each key those of the first source that has it (one of them)."""
    both = None
    for n, df in enumerate(sources):
        one = df.withColumn("source_rank", F.lit(n))
        both = one if both is None else both.unionByName(one)
    return first_of_key(both, key, "source_rank")


def result_list(hits: DataFrame) -> DataFrame:
    """Copies of a file once, with the best score; a snippet for each; the newest first.

    ``hits``: filename, date, drafter, category, content, score. Of copies of one name and score the newest stays, then
    the least by snippet and the other columns (texts by their hash, so that rows need not carry them): the list does
    not hang on how the input is split.
    """
    text = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))
    about = F.concat_ws(" | ", F.nullif(F.trim(F.col("category")), F.lit("")), F.nullif(F.trim(F.col("drafter")), F.lit("")), F.nullif(F.trim(F.col("date")), F.lit("")))
    named = hits.withColumn("key", T.filename_key(F.col("filename"))).withColumn("snippet", F.when(text == "", about).otherwise(F.left(text, F.lit(200))))
    order = F.desc("score"), "filename", F.desc_nulls_last("date"), "snippet", "drafter", "category", F.xxhash64("content")
    return first_of_key(named, "key", *order).drop("key").orderBy(F.desc_nulls_last("date"), "filename")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", hash_: str = "hash") -> DataFrame:
    """path, change: new, modified, deleted or same."""
    both = old.select(key, F.col(hash_).alias("_o")).join(new.select(key, F.col(hash_).alias("_n")), key, "full")
    return both.select(key, F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("_o") != F.col("_n"), "modified").otherwise("same").alias("change"))


def two_way_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: ``missing`` (only in a) or ``stale`` (only in b)."""
    one = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    two = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("stale"))
    return one.unionByName(two)


def consistency(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: in_a, in_b, in_both, in_any, percent (100 x both / any)."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    out = both.agg(F.count("_a").alias("in_a"), F.count("_b").alias("in_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"), F.count("*").alias("in_any"))
    return out.withColumn("percent", F.round(F.coalesce(F.try_divide(100.0 * F.col("in_both"), F.col("in_any")), F.lit(0.0)), 6))


def allowed_or_first(hits: DataFrame, pattern: str, k: int, column: str = "text") -> DataFrame:
    """Each query's hits that match; where none does, its first 3 k."""
    w = Window.partitionBy("query_id")
    flagged = hits.withColumn("_m", F.col(column).rlike(pattern)).withColumn("_any", F.max(F.col("_m").cast("int")).over(w))
    return flagged.filter(F.when(F.col("_any") == 1, F.col("_m")).otherwise(F.col("rank") <= 3 * k)).drop("_m", "_any")


def statistics(docs: DataFrame, *keys: str) -> DataFrame:
    """name, value, count: how many documents there are, and by each key (blank keys left out)."""
    out = docs.agg(F.count("*").alias("count")).select(F.lit("all").alias("name"), F.lit("").alias("value"), "count")
    for k in keys:
        out = out.unionByName(docs.filter(~blank(k)).groupBy(F.col(k).cast("string").alias("value")).agg(F.count("*").alias("count")).select(F.lit(k).alias("name"), "value", "count"))
    return out


def extension_counts(docs: DataFrame, column: str = "filename") -> DataFrame:
    """One row: pdf, txt, other (any letter case)."""
    suffix = F.lower(F.regexp_extract(column, r"\.([A-Za-z0-9]+)$", 1))
    return docs.agg(F.count_if(suffix == "pdf").alias("pdf"), F.count_if(suffix == "txt").alias("txt"), F.count_if(~suffix.isin("pdf", "txt")).alias("other"))


def repeated_lines(pages: DataFrame, edge: int = 2, least: int = 3) -> DataFrame:
    """doc_id, line, pages: lines (lower-cased, squeezed) that stand among the first or last ``edge`` of ``least`` pages or more.

    ``pages``: doc_id, page, page_text.
    """
    lines = pages.select("doc_id", "page", F.filter(F.transform(F.split("page_text", "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))), lambda x: x != "").alias("l"))
    heads = F.array_distinct(F.concat(F.slice("l", 1, edge), F.reverse(F.slice(F.reverse("l"), 1, edge))))
    return lines.select("doc_id", "page", F.explode(heads).alias("line")).groupBy("doc_id", "line").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least)


def consecutive_lines(docs: DataFrame, most: int = 1) -> DataFrame:
    """doc_id, pos, line: every line but those beyond ``most`` of a run of equal ones (gaps and islands)."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.withColumn("_new", F.coalesce((F.col("line") != F.lag("line").over(w)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    return marked.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("pos"))).filter(F.col("_n") <= most).select("doc_id", "pos", "line")


def extraction_quality(chars: Column, pages: Column) -> Column:
    """zero, low (fewer than 100 characters, or 50 a page) or ok."""
    return F.when(chars == 0, "zero").when((chars < 100) | (F.coalesce(F.try_divide(chars.cast("double"), pages.cast("double")), F.lit(0.0)) < 50), "low").otherwise("ok")


def passing_all(df: DataFrame, key: str, *conditions: Column) -> DataFrame:
    """The rows whose key has, for each condition, a row that meets it."""
    met = df.groupBy(key).agg(F.bool_and(F.lit(True)).alias("_m"), *[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"_c{n}") for n, c in enumerate(conditions)])
    good = met
    for n in range(len(conditions)):
        good = good.filter(F.col(f"_c{n}") == 1)
    return df.join(good.select(key), key, "left_semi")


def in_all(key: str, *results: DataFrame) -> DataFrame:
    """The keys that every result has."""
    out = results[0].select(key).distinct()
    for r in results[1:]:
        out = out.join(r.select(key).distinct(), key, "left_semi")
    return out


def looked_up(hits: DataFrame, docs: DataFrame, key: str, defaults: dict[str, object], drafter: str | None = None, year: str | None = None) -> DataFrame:
    """Each hit with its document's fields, or their defaults; with a filter on people hits without a document that passes go."""
    own = docs
    if drafter is not None:
        own = own.filter(F.col("drafter") == drafter)
    if year is not None:
        own = own.filter(F.col("date").startswith(year))
    one = own.dropDuplicates([key]).select(key, *defaults)
    joined = hits.join(one, key, "left" if drafter is None else "inner")
    return joined.select(*hits.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) if v is not None else F.col(c) for c, v in defaults.items()])


def top_codes(codes: DataFrame, n: int) -> DataFrame:
    """norm_code, code (a sample), documents of the codes in most documents."""
    found = codes.groupBy("norm_code").agg(F.min("code").alias("code"), F.count_distinct("doc_id").alias("documents"))
    return found.orderBy(F.desc("documents"), "norm_code").limit(n)


def expired(rows: DataFrame, now: Column, seconds: float, created: str, accessed: str | None = None) -> DataFrame:
    """Rows older than a time to live: since they were made, or (sliding) since they were last used if that is later."""
    last = F.greatest(created, accessed) if accessed else F.col(created)
    return rows.filter(F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(last.cast("timestamp")) / 1e6 > seconds)


def cache_stats(rows: DataFrame, count: str) -> DataFrame:
    """One row: entries, uses, mean uses."""
    return rows.agg(F.count("*").alias("entries"), F.coalesce(F.sum(count), F.lit(0)).alias("uses"), F.round(F.coalesce(F.avg(count), F.lit(0.0)), 6).alias("mean_uses"))


def with_columns_of(df: DataFrame, schema: str) -> DataFrame:
    """Schema evolution: columns that are new in the schema come as nulls, others stay; types follow the schema."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name not in df.columns]
    known = {f.name: f.dataType for f in wanted}
    return df.select(*[F.col(c).cast(known[c]).alias(c) if c in known else F.col(c) for c in df.columns], *added)


def dated_between(files: DataFrame, first: str, last: str, column: str = "filename") -> DataFrame:
    """Files whose name's day lies between two days, in order of days."""
    from ..functions.documents import filename_date

    return files.withColumn("date", filename_date(F.col(column))).filter(F.col("date").between(first, last)).orderBy("date", column)


def by_drafter(docs: DataFrame, name: str, n: int, key: str = "doc_id", *dates: str) -> DataFrame:
    """The n newest documents whose drafter holds a name."""
    return newest(docs.filter(F.col("drafter").contains(name)), n, key, *dates)


def drafter_counts(docs: DataFrame, unknown: str = "미확인", column: str = "drafter") -> DataFrame:
    """One row: documents, known, percent (whole), names, names of Hangul alone."""
    known = F.coalesce(~F.col(column).isin(unknown, ""), F.lit(False))
    out = docs.agg(F.count("*").alias("documents"), F.count_if(known).alias("known"), F.count_distinct(F.when(known, F.col(column))).alias("names"), F.count_distinct(F.when(known & F.col(column).rlike("^[가-힣]{2,4}$"), F.col(column))).alias("hangul"))
    return out.withColumn("percent", F.floor(F.col("known") * 100 / F.greatest("documents", F.lit(1))))


def error_stats(failures: DataFrame, key: str, at: str, recent: int = 5) -> DataFrame:
    """One row: failed (distinct), errors, the ``recent`` last ones' keys, the latest first."""
    last = failures.orderBy(F.desc(at), F.desc(key)).limit(recent).agg(F.transform(F.sort_array(F.collect_list(F.struct(at, key)), asc=False), lambda s: s[key]).alias("recent"))
    return failures.agg(F.count_distinct(key).alias("failed"), F.count("*").alias("errors")).join(last)  # one row each


def index_metrics(docs: DataFrame, **indexes: DataFrame) -> DataFrame:
    """One row: documents, the size of each index, documents beyond the largest."""
    out = docs.agg(F.count("*").alias("documents"))
    for name, index in indexes.items():
        out = out.join(index.agg(F.count("*").alias(name)))  # one row each
    return out.withColumn("unindexed", F.greatest(F.lit(0), F.col("documents") - F.greatest(*[F.col(n) for n in indexes], F.lit(0))))


def unique_files(docs: DataFrame, suffixes: tuple[str, ...] = ("pdf", "txt"), name: str = "filename") -> DataFrame:
    """files: the number of distinct file names with one of the suffixes, in any case; all names if there are none."""
    met = F.lower(name).rlike(r"\.(?:" + "|".join(suffixes) + r")$") if suffixes else F.col(name).isNotNull()
    return docs.filter(met).agg(F.countDistinct(name).alias("files"))


def listed(docs: DataFrame, offset: int = 0, limit: int = 1000, least: int = 100) -> DataFrame:
    """id (doc_ and the number), filename, path, text_length of one page of the documents by doc_id, those with a preview of ``least`` characters or more."""
    rows = docs.filter(F.length("text_preview") >= least).orderBy("doc_id").offset(offset).limit(limit)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), blank("filename"), blank("path"), F.length("text_preview").alias("text_length"))


def summaries(docs: DataFrame, most: int = 100) -> DataFrame:
    """The ``most`` latest documents (by date, then doc_id) with a file name; ``keywords`` (a JSON list) as an array, an empty one if it is none."""
    words = F.coalesce(F.from_json("keywords", "array<string>"), F.array().cast("array<string>"))
    return docs.filter("filename IS NOT NULL").withColumn("keywords", words).orderBy(F.desc_nulls_last("date"), "doc_id").limit(most)


def with_previews(docs: DataFrame, changes: DataFrame, now: Column, most: int = 1000) -> DataFrame:
    """``docs`` (path, text_preview, updated_at, ...) with the previews of changes (path, text_preview, turn): of several for a path the last, cut at ``most`` characters."""
    last = changes.groupBy("path").agg(F.max_by("text_preview", "turn").alias("_preview")).withColumn("_met", F.lit(True))
    new = docs.join(last, "path", "left")
    return new.withColumns({"text_preview": F.when(F.col("_met"), F.left("_preview", F.lit(most))).otherwise(F.col("text_preview")), "updated_at": F.when(F.col("_met"), now).otherwise(F.col("updated_at"))}).select(*docs.columns)
