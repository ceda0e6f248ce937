"""Ingest that tries failed files again, later and later, and gives up in the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ingest import FILE

_OUT = "path string, text string, attempts int, status string, error string"
_STATE = "attempts int, content binary"


def utf8_text(path: str, content: bytes) -> str:
    """The text of a file; raises if there is none."""
    text = content.decode()
    if not text.strip():
        raise ValueError("no text")
    return text


def with_retries(files: DataFrame, process: Callable[[str, bytes], str] = utf8_text, most: int = 5, first: float = 60.0, grow: float = 2.0) -> DataFrame:
    """path, text, attempts, status, error for a stream of files (path, modificationTime, content): a row for each attempt.

    ``process`` gives the text or raises. A file that fails is kept, with its number of attempts, in the state of its path, and a timer of processing time wakes it: after
    ``first`` seconds, then after ``grow`` times as long each time. Status is ``done``, ``waiting``, or ``given up`` after ``most`` attempts.
    A file that comes again with another time of change starts anew. Only files that wait are in the state, which is part of the checkpoint, so a
    restart neither forgets nor repeats an attempt whose batch has ended.
    """

    def attempt(key: Any, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            tried, content = state.get
        else:
            rows = pd.concat(list(batches))
            tried, content = 0, rows.sort_values("modificationTime")["content"].iloc[-1]
        text = error = None
        try:
            text, status = process(key[0], bytes(content)), "done"
        except Exception as e:  # any failure of a file is a row, not a failed stream
            error, status = f"{type(e).__name__}: {e}"[:300], "given up" if tried + 1 >= most else "waiting"
        if status == "waiting":
            state.update((tried + 1, content))
            state.setTimeoutDuration(max(1, int(1000 * first * grow**tried)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], text, tried + 1, status, error)], columns=["path", "text", "attempts", "status", "error"])

    own = files.select("path", "modificationTime", "content")
    return own.groupBy("path").applyInPandasWithState(attempt, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def retried_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.txt", every: str = "10 seconds", **options):
    """Starts ingest of new files of a folder: ``out/documents``, ``out/quarantine`` (given up) and ``out/attempts`` (those that failed and wait).

    A batch that is run again overwrites its own part, so nothing is there twice. Timers are looked at every ``every``, whether there are new files or not.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).load(folder)

    def land(batch: DataFrame, n: int) -> None:
        batch.persist()
        for status, name in (("done", "documents"), ("given up", "quarantine"), ("waiting", "attempts")):
            rows = batch.filter(F.col("status") == status).drop("status")
            (rows.drop("error") if name == "documents" else rows.drop("text")).write.mode("overwrite").parquet(f"{out}/{name}/batch={n}")
        batch.unpersist()

    return with_retries(files, **options).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
