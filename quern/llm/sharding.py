"""Sharding by size-tiered compaction; DataFrame operations only.

A table is a folder. Arrivals are appended as small immutable shards. Shards of similar size (one
tier) are merged, a few at a time, into larger ones until they have the target size. Every change
is one new version of the manifest, a list of shards, made visible by one atomic rename; readers
see the shards of one version, whatever is being written or has been left over by lost jobs. A writer that
loses a race takes its change to the version that won. Shards stay as long as a listed version has them: ``vacuum``
takes old versions from the list first, then the shards that no listed version has.
"""

from __future__ import annotations

import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, remove

MANIFEST = "path string, bytes bigint, rows bigint, tier int"


@dataclass(frozen=True)
class Layout:
    """``target``: bytes of a finished shard. ``smallest``: bytes of tier 0. ``fan_in``: shards of a
    tier that are merged at once, and the step in size from tier to tier. ``jobs``: merges at one time, each a Spark job of one task."""

    target: int = 128 << 20
    smallest: int = 1 << 20
    fan_in: int = 4
    jobs: int = 16

    def tier(self, size: int) -> int:
        """The tier of a shard; -1: finished."""
        if 2 * size >= self.target:
            return -1
        return max(0, int(math.log(max(size, 1) / self.smallest, self.fan_in)))


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = filesystem(spark, f"{root}/manifest")
    return sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(p) if f.getPath().getName().startswith("v")) if fs.exists(p) else []


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The shards of a version (the last one unless told); none before the first commit."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{root}/manifest/v{known[-1] if version is None else version:09d}")


def commit(spark: SparkSession, root: str, shards: list[tuple], version: int) -> None:
    """Publishes version ``version``; FileExistsError if another writer has published it before."""
    tmp = f"{root}/manifest/.tmp-{uuid.uuid4().hex}"
    spark.createDataFrame(shards, MANIFEST).coalesce(1).write.json(tmp)
    jvm, to = spark.sparkContext._jvm, f"{root}/manifest/v{version:09d}"
    fs, src = filesystem(spark, tmp)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(src, jvm.org.apache.hadoop.fs.Path(to), options)
    except Py4JJavaError as e:
        remove(spark, tmp)
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        raise FileExistsError(f"version {version} of {root} exists") from e


def _listed(spark: SparkSession, root: str) -> tuple[int, list[tuple]]:
    """The last version (0: none yet) and its shards."""
    known = versions(spark, root)
    return (known[-1], [tuple(r) for r in manifest(spark, root, known[-1]).collect()]) if known else (0, [])


def _write(df: DataFrame, root: str, layout: Layout, rows_per_file: int = 0) -> list[tuple]:
    """Writes shards and lists them; files of a failed attempt are in no manifest."""
    path = f"{root}/data/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path).groupBy("_metadata.file_path", "_metadata.file_size").count()
    return [(p, size, n, layout.tier(size)) for p, size, n in found.collect()]  # one row for each file


def append(df: DataFrame, root: str, layout: Layout | None = None) -> int:
    """Adds ``df`` as small shards, one for each of its partitions; returns the new version.

    Rows stay as they are: nulls, repeated rows and very long texts too; an empty ``df`` gives a new version
    without new rows. All appended frames need the same columns.
    """
    spark = df.sparkSession
    new = _write(df, root, layout or Layout())
    while True:
        version, before = _listed(spark, root)
        try:
            commit(spark, root, before + new, version + 1)
        except FileExistsError:  # another writer was first: its version is what to add to
            continue
        return version + 1


def plan(shards: list[tuple], layout: Layout) -> list[list[tuple]]:
    """Groups to merge: ``fan_in`` or more shards of one tier each, up to about the target size.

    Shards are taken from the smallest up, so a group's shards are alike; what is left of a tier (fewer
    than ``fan_in``) waits for more arrivals.
    """
    groups = []
    for tier in sorted({s[3] for s in shards if s[3] >= 0}):
        own: list[tuple] = []
        for shard in sorted((s for s in shards if s[3] == tier), key=lambda s: (s[1], s[0])):
            own.append(shard)
            size = sum(s[1] for s in own)
            if size >= layout.target or len(own) >= layout.fan_in:
                groups.append(own)
                own = []
    return groups


def compact(spark: SparkSession, root: str, schema, layout: Layout | None = None) -> int:
    """Merges until no tier has ``fan_in`` shards; each round is one commit. Returns the last version (0 for a table without any).

    A merge reads its shards one after another in one task and writes one file, without a shuffle.
    The merged shards stay for readers of older versions until ``vacuum``. If another compaction has taken one of
    them meanwhile, the round's files go and it plans anew.
    """
    layout = layout or Layout()
    while True:
        version, shards = _listed(spark, root)
        groups = plan(shards, layout)
        if not groups:
            return version
        with ThreadPoolExecutor(layout.jobs) as pool:
            made = [s for own in pool.map(lambda g: _write(spark.read.schema(schema).parquet(*[s[0] for s in g]).coalesce(1), root, layout), groups) for s in own]
        gone = {s[0] for group in groups for s in group}
        while gone <= {s[0] for s in shards}:
            try:
                commit(spark, root, [s for s in shards if s[0] not in gone] + made, version + 1)
                break
            except FileExistsError:
                version, shards = _listed(spark, root)
        else:
            for p in made:
                remove(spark, p[0])


def vacuum(spark: SparkSession, root: str, keep_versions: int = 10, older_than: float = 86400.0) -> int:
    """Forgets versions but for the last ``keep_versions`` and those published in the last ``older_than`` seconds.

    Then shards go that only forgotten versions have. Returns the number of shards that went. Files of lost jobs, which
    no version ever had, are not touched.
    """
    known = versions(spark, root)
    fs, _ = filesystem(spark, root)
    at = lambda v: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/v{v:09d}")
    old = [v for v in known[: max(0, len(known) - max(1, keep_versions))] if fs.getFileStatus(at(v)).getModificationTime() < 1000 * (time.time() - older_than)]
    if not old:
        return 0
    # Metadata only: a row for each shard of a version.
    shards = {v: {r["path"] for r in manifest(spark, root, v).select("path").collect()} for v in known}
    gone = set().union(*(shards[v] for v in old)) - set().union(*(shards[v] for v in known if v not in old))
    for v in old:
        remove(spark, f"{root}/manifest/v{v:09d}")
    for p in gone:
        remove(spark, p)
    return len(gone)


def read(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version (the last one unless told), with the shard's file name as ``_shard``; none before the first commit.

    ValueError for a version that is not listed.
    """
    if version is not None and version not in versions(spark, root):
        raise ValueError(f"version {version} of {root} is not listed")
    paths = [r["path"] for r in manifest(spark, root, version).select("path").collect()]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("_shard", F.lit(""))
    return spark.read.schema(schema).parquet(*paths).withColumn("_shard", F.col("_metadata.file_name"))


def sharded(docs: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Appends ``docs`` to a new table, compacts it, and gives each row as read back.

    doc_id, n_bytes (of the text; null for a null text), text_sha256 (likewise), shard (file name),
    shard_rows and shard_bytes as the manifest has them, version. Every row is kept, repeated ones too.
    """
    spark, root = docs.sparkSession, fresh_path(docs.sparkSession, "shards")
    append(docs, root, layout)
    version = compact(spark, root, docs.schema, layout)
    vacuum(spark, root, 1, 0.0)  # the table is new: nobody reads its older versions
    listed = manifest(spark, root).select(F.element_at(F.split("path", "/"), -1).alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    rows = read(spark, root, docs.schema).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), F.col("_shard").alias("shard"))
    return rows.join(listed, "shard").select("doc_id", "n_bytes", "text_sha256", "shard", "shard_rows", "shard_bytes", F.lit(version).alias("version"))
