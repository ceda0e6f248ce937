"""Event-time windows with watermarks, and a stateful rate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def timed(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp (a watermark takes no other type) with a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _counted(events: DataFrame, window: Column, *by: str) -> DataFrame:
    found = events.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def tumbling(events: DataFrame, size: str, *by: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return _counted(timed(events, ts, late), F.window(ts, size), *by)


def sliding(events: DataFrame, size: str, step: str, *by: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return _counted(timed(events, ts, late), F.window(ts, size, step), *by)


def sessions(events: DataFrame, gap: str, *by: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return _counted(timed(events, ts, late), F.session_window(ts, gap), *by)


class _Rate(StatefulProcessor):
    """Keeps the last time and the rate of a key; goes when a key has been silent for a time to live."""

    def __init__(self, horizon: float, ttl_ms: int):
        self.horizon, self.ttl = horizon, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rate", "last double, rate double, n bigint", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        last, rate, n = self.state.get() if self.state.exists() else (None, 0.0, 0)
        for t in sorted(x for pdf in rows for x in pdf["t"]):
            if last is not None:
                dt = max(t - last, 1e-6)
                rate += (1 - math.exp(-dt / self.horizon)) * (1 / dt - rate)
            last, n = t if last is None else max(last, t), n + 1
        self.state.update((last, rate, n))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "rate": [rate]})

    def close(self) -> None:
        pass


def ewma_stream(events: DataFrame, by: str, ts: str = "ts", horizon: float = 60.0, ttl_ms: int = 3_600_000) -> DataFrame:
    """key, n, rate after each micro-batch."""
    timed_ = events.select(F.col(by).cast("string").alias("key"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    return timed_.groupBy("key").transformWithStateInPandas(_Rate(horizon, ttl_ms), "key string, n bigint, rate double", "Update", "ProcessingTime")
