"""Token-ID output: Parquet list columns, in ascending doc_id order.

A file has small dictionary-encoded pages with a page index and bounded row groups, so that a
reader can take single documents, or doc_id and n_tokens without the ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, fresh_path, task, text_of, utf8
from .tokens import encoder

SCHEMA = "doc_id bigint, n_tokens bigint, start_in_file bigint, ids array<int>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("start_in_file", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Writer settings: version 2 pages (delta encoding where a dictionary does not pay), row groups of
#: 32 MB, pages of 64 KB, which also are the grain of the page index.
FORMAT = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": str(32 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "1000"}


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = 1) -> None:
    """Writes every whole text's ids and ``end`` to ``path``, one file for each range of doc_id.

    A null or empty text is written as ``end`` alone. Rows with one doc_id stay beside each other in
    one file, as many as there are. An empty table gives a folder without ids. Other columns go.
    """

    @task("tokens")
    def encode(batches):
        start = 0
        for b in batches:
            docs_, (data, at) = b.column(0), utf8(b.column(1))
            for i, j in blocks(np.diff(at), 1 << 19):
                ids, ends = encoder(vocabulary).encode(data, at[i : j + 1], end)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([docs_[i:j], pa.array(np.diff(ends)), pa.array(start + ends[:-1]), lists], schema=_SCHEMA)
                start += int(ends[-1])

    ordered = text_of(docs, "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, SCHEMA).write.options(**FORMAT).parquet(path)


def _bases(found: DataFrame) -> DataFrame:
    """_file and _base: the ids in all files before it. One row for each file; reads no ids."""
    files = found.groupBy("_file").agg(F.min("doc_id").alias("lo"), F.sum("n_tokens").alias("n"))
    return files.select("_file", F.coalesce(F.sum("n").over(Window.orderBy("lo", "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).withColumn("_file", F.col("_metadata.file_path"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; in no order."""
    found = _files(spark, path)
    return found.join(_bases(found), "_file").select("doc_id", (F.col("_base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("_file", pa.string())])

    def crc(batches):
        for b in batches:
            lists = b.column(2)
            data, at = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B"), lists.offsets.to_numpy()
            sums = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64()), b.column(3)], schema=schema)

    found = _files(spark, path)
    # Only digests meet the files' bases; the ids do not move.
    sums = found.select("doc_id", "start_in_file", "ids", "_file").mapInArrow(crc, "doc_id bigint, start_in_file bigint, n_tokens bigint, ids_crc32 bigint, _file string")
    return sums.join(_bases(found), "_file").select("doc_id", (F.col("_base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, vocabulary: str, end: int = 1) -> DataFrame:
    """Writes the ids of ``docs`` to the shared folder and gives each document's digest as read back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end)
    return checksums(docs.sparkSession, path)
