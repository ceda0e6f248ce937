"""Reading and publishing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stored import stored

#: Tables of texts: work on a row is worth a move.
TEXTS = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; a table of texts in as many partitions as there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out if the files make fewer than half as many partitions as there are cores.

    That is the case for a few small files only; large tables come in many splits and stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def document_table(spark: SparkSession, path: str, drafter: str = "source", doctype: str = "lang") -> DataFrame:
    """A document table with one mandatory key, whatever its columns are called in the files.

    Adds content_hash, text_preview (500 characters) and page_count (form feeds part pages).
    """
    df = spark.read.parquet(path)
    text = F.coalesce("text", F.lit(""))
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col(drafter).alias("drafter"), F.col(doctype).alias("doctype"),
        F.sha2(text.cast("binary"), 256).alias("content_hash"), F.left(text, F.lit(500)).alias("text_preview"), F.size(F.split(text, "\f")).alias("page_count"),
    )


def pages_of(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each page (from 1); a form feed or a line ``[page n]`` begins a page."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?m)^\[page \d+\]\n?", "\f"), "\f")
    return df.select("*", F.posexplode(parts).alias("page", "page_text")).withColumn("page", F.col("page") + 1)


def page_text(text: Column, page: Column) -> Column:
    """Text of one page, from 1; null out of range."""
    return F.when(page >= 1, F.try_element_at(F.split(text, "\f"), page))


def file_inventory(spark: SparkSession, path: str | list[str], sampled_above: int = 10 << 20) -> DataFrame:
    """path, size, modified, hash of files.

    Large files are hashed by their first, middle and last megabyte with size and time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mb = 1 << 20
    middle = (F.col("length") / 2).cast("int") - mb // 2
    sample = F.concat(F.substring("content", 1, mb), F.col("content").substr(middle, F.lit(mb)), F.substring("content", -mb, mb), F.encode(F.concat_ws("|", "length", F.col("modificationTime").cast("string")), "UTF-8"))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5(F.when(F.col("length") > sampled_above, sample).otherwise(F.col("content"))).alias("hash"))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified of files; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: Names of files that are on the driver at once.
NAMES = 10_000


def updated_inventory(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """``file_inventory`` that takes the hash from ``known`` (path, size, modified, hash) where size and time are as they were.

    Only the other files are read, ``NAMES`` at a time; what has been read is kept in the shared folder.
    """
    now = file_listing(spark, path)
    out = now.join(known, ["path", "size", "modified"]).select("path", "size", "modified", "hash")
    names: list[str] = []
    changed = stored(now.join(out.select("path"), "path", "left_anti").select("path"), "changed")
    for row in [*changed.toLocalIterator(), None]:
        if row is not None:
            names.append(row[0])
        if names and (row is None or len(names) == NAMES):
            out, names = out.unionByName(stored(file_inventory(spark, names), "inventory")), []
    return out


def fast_fingerprint(content: Column, size: Column, modified: Column) -> Column:
    """MD5 of the first and last two megabytes, size and time."""
    two = 2 << 20
    return F.md5(F.concat(F.substring(content, 1, two), F.substring(content, -two, two), F.encode(F.concat_ws("|", size.cast("string"), modified.cast("string")), "UTF-8")))


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, page_count, error of PDF files; needs a PDF library on the executors."""

    def extract(batches):
        import io

        import pandas as pd

        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None  # noqa: N806
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                if PdfReader is None:
                    rows.append((p, None, None, "no PDF library"))
                    continue
                try:
                    pages = [x.extract_text() or "" for x in PdfReader(io.BytesIO(content)).pages]
                    rows.append((p, "\f".join(pages), len(pages), None))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((p, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "text", "page_count", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(extract, "path string, text string, page_count int, error string")


def routing_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of routing decisions, one file for each day."""
    return spark.read.schema("timestamp string, query string, mode string, reason string, confidence double").json(path)


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``target`` with ``changes`` put in place of those of the same key; the last change wins."""
    last = changes.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_rn = 1").drop("_rn")
    return target.join(last.select(key), key, "left_anti").unionByName(last.select(*target.columns))


def update_columns(target: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Sets allowed columns where a change has a value; keys that are new are added."""
    given = [c for c in allowed if c in changes.columns and c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in given])
    joined = target.join(renamed, key, "full")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in target.columns])


def merge_counts(target: DataFrame, more: DataFrame, key: str, count: str, latest: str) -> DataFrame:
    """Conflict merge: counts add up, the latest time stays."""
    both = target.select(key, count, latest).unionByName(more.select(key, count, latest))
    return both.groupBy(key).agg(F.sum(count).alias(count), F.max(latest).alias(latest))


def publish(df: DataFrame, root: str, format: str = "parquet") -> str:
    """Writes a new version beside the old ones and then moves the pointer; readers see one or the other."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.format(format).save(f"{root}/versions/{version}")
    jvm = spark.sparkContext._jvm
    pointer, tmp = (jvm.org.apache.hadoop.fs.Path(f"{root}/{x}") for x in ("CURRENT", f".CURRENT-{version}"))
    fs = pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(tmp, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(tmp, pointer, options)
    return version


def published(spark: SparkSession, root: str, format: str = "parquet") -> DataFrame:
    """The version that the pointer names."""
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.format(format).load(f"{root}/versions/{version}")


def export(df: DataFrame, path: str, format: str = "csv") -> None:
    """CSV (with a header), JSON or Markdown files."""
    if format == "markdown":
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
        df.select(cells.alias("value")).write.text(path)
    else:
        df.write.format(format).option("header", "true").save(path)
