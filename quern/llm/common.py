"""What the operators share: the shared folder, written intermediates, Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent in a local session (tests) a temporary folder is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quern-checkpoint-')}")
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that goes when the application ends, if it has not gone before."""
    path = f"{shared_dir(spark)}/quern-{what}-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)
    return path


@contextmanager
def small_batches(spark: SparkSession):
    """Rows go to Python in batches of ``BATCH`` rows and some ``BATCH_BYTES`` at most in here: 10,000 long texts are too much for a worker."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name) for name in most}
    for name, n in most.items():
        spark.conf.set(name, str(n))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Rows that a task writes at least, where their number is known before.
TASK_ROWS = 20_000
_rows: WeakKeyDictionary = WeakKeyDictionary()


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows at most, in no more tasks than these need."""
    tasks = rows // TASK_ROWS + 1
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _stored(df: DataFrame, what: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """The written table and its path. ``rows`` bounds the rows: few of them are written by few tasks."""
    spark, path, seen = df.sparkSession, fresh_path(df.sparkSession, what), Observation()
    if rows is not None:
        df = fewer(df, rows)
    with small_batches(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _rows[table] = seen.get["rows"]
    return table, path


def rows_of(table: DataFrame) -> int:
    """The number of rows, known if the table was written by ``Work``."""
    return _rows[table] if table in _rows else table.count()


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe against lost executors; it stays until the application ends."""
    return _stored(df, what)[0]


class Work:
    """Tables in the shared folder that go when the work ends, but for its results."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Work:
        return self

    def written(self, df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
        """A table for use within the work; ``rows``: it cannot have more."""
        table, path = _stored(df, what, rows)
        self.paths.append(path)
        return table

    def result(self, df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
        """A table that outlives the work."""
        return _stored(df, what, rows)[0]

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's FileSystem and Path for ``path`` (driver side, metadata operations only)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


BATCH, BATCH_BYTES = 1000, 8 << 20
#: Rows of ids (some 40 bytes each in a hash table) that are broadcast at most.
FEW = 500_000
_tables: dict[str, object] = {}


def keeps(name: str, forget) -> None:
    """Says how to drop what an operator keeps in a Python worker from task to task."""
    _tables[name] = forget


def _trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def task(name: str):
    """For functions over batches in Python workers.

    A worker keeps the tables of one operator only, and gives back what a task has used when it ends:
    idle workers stay beside those of the next stages.
    """

    def wrap(f):
        def run(batches):
            for other, forget in _tables.items():
                if other != name:
                    forget()
            try:
                yield from f(batches)
            finally:
                _trim()

        return run

    return wrap


def _c_library():
    """glibc, told to keep freed arrays for the next ones until a task ends; else None.

    Fresh pages for each array cost more than most of what is done with it.
    """
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        return None
    return libc


_libc = _c_library()


def text_of(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and the text, a null text as an empty one; other columns go."""
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(text))


def few(ids: DataFrame, at_most: int = FEW, rows: int | None = None) -> DataFrame:
    """A written table of ids for the small side of a join: broadcast if it has ``at_most`` rows, else as it is."""
    return F.broadcast(ids) if (rows_of(ids) if rows is None else rows) <= at_most else ids


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column (without nulls) and its n + 1 offsets, not copied."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(sizes: np.ndarray, most: int):
    """Ranges of consecutive rows whose sizes add up to ``most`` at most, or single larger rows."""
    first, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and total + n > most:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
