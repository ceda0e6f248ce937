"""Incremental ingest of document files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def quarantine_split(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that can be used (path, text, content_hash), and those that cannot with the reason."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = files.select("path", "length", F.sha2("content", 256).alias("content_hash"), text.alias("text"))
    reason = F.when(F.col("length") == 0, "empty").when(F.col("text").isNull(), "not UTF-8").when(F.trim("text") == "", "no text")
    judged = read.withColumn("reason", reason)
    return judged.filter("reason is null").select("path", "text", "content_hash"), judged.filter("reason is not null").select("path", "content_hash", "reason")


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.txt", also: Callable[[DataFrame, int], None] | None = None):
    """Starts a query over new files of a folder: good ones to ``out/documents``, others to ``out/quarantine``.

    A batch that is run again after a failure overwrites its own part (one folder for each batch), so
    nothing is there twice.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).load(folder)

    def land(batch: DataFrame, n: int) -> None:
        good, bad = quarantine_split(batch)
        good.write.mode("overwrite").parquet(f"{out}/documents/batch={n}")
        bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={n}")
        if also:
            also(good, n)

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
