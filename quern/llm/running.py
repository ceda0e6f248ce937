"""Places and running sums within groups of any size: range partitions, counted each, with what came before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work

HEAD, TAIL = 1, 2


def _before(edges: list, add: tuple[str, ...]) -> list[tuple]:
    """part, rows and sums of its first group in earlier partitions, where there are any; from the partitions' first and last rows."""
    out, carried, ends = [], None, {}
    for row in edges:
        ends.setdefault(row["part"], {}).update({flag: row for flag in (HEAD, TAIL) if row["edge"] & flag})
    for part in sorted(ends):
        head, tail = ends[part][HEAD], ends[part][TAIL]
        if carried and carried[0] == head["group"]:
            out.append((part, *carried[1]))
        else:
            carried = None
        own = [tail["at"] + 1, *(tail[c] for c in add)]
        before = carried[1] if carried and head["group"] == tail["group"] else [0] * len(own)
        carried = (tail["group"], [x + y for x, y in zip(before, own, strict=True)])
    return out


def running(df: DataFrame, group: str, order: list[Column], work: Work, add: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``at``, the place (from 0) of each row in its group by ``order``; ``add`` become running sums, own row included.

    ``group`` has no nulls; ``at`` and ``add`` are bigint. Rows are range-partitioned by group and order, so a group of any
    size is spread over tasks; each task counts on its own, and the one group that a partition may have in common with those before
    it gets what they hold. Only the first and the last row of each partition come to the driver.
    """
    ordered = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    schema = T.StructType([*df.schema.fields, T.StructField("at", T.LongType()), T.StructField("lead", T.BooleanType()), T.StructField("edge", T.ByteType())])
    k = df.columns.index(group)
    sums = [df.columns.index(c) for c in add]

    def count(batches):
        held, last, lead, totals = None, None, True, np.zeros(1 + len(sums), np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column(k)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = last is not None and keys[0].as_py() != last
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the group of the rows before
            counted, columns = [], list(b.columns)
            for j, values in enumerate([np.ones(n, np.int64), *(np.asarray(b.column(c)) for c in sums)]):
                whole = np.append(0, np.cumsum(values))
                own = whole[1:] - np.where(start < 0, -totals[j], whole[np.maximum(start, 0)])
                totals[j] = own[-1]
                counted.append(own)
            for c, own in zip(sums, counted[1:], strict=True):
                columns[c] = pa.array(own)
            leads = (start < 0) & lead
            lead = bool(leads[-1])
            edge = np.zeros(n, np.int8)
            edge[0] = HEAD if last is None else 0
            last = keys[n - 1].as_py()
            if held is not None:
                yield made(*held)
            held = (columns, counted[0] - 1, leads, edge)
        if held is not None:
            held[3][-1] |= TAIL
            yield made(*held)

    def made(columns, at, leads, edge):
        return pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(leads), pa.array(edge)], names=[f.name for f in schema])

    laid = work.written(ordered.mapInArrow(count, schema).withColumn("part", F.spark_partition_id()), "running")
    edges = laid.filter("edge > 0").select("part", "edge", F.col(group).alias("group"), "at", *add).collect()  # two rows a partition at most
    before = _before(edges, add)
    if before:
        names = ["_at", *(f"_{c}" for c in add)]
        earlier = df.sparkSession.createDataFrame(before, f"part int, {', '.join(f'{c} bigint' for c in names)}")
        laid = laid.join(F.broadcast(earlier), "part", "left")  # a row a partition at most
        for c, own in zip(names, ["at", *add], strict=True):
            laid = laid.withColumn(own, F.col(own) + F.when(F.col("lead"), F.coalesce(c, F.lit(0))).otherwise(0))
    return laid.select(*df.columns, "at")
