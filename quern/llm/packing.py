"""Best-fit packing: minimum bin slack over the histogram of lengths.

Only the histogram (one count for each length up to the sequence's size) reaches the driver. There
each step finds, for the largest length left, the fullest feasible combination of the other
lengths by a subset-sum over a bitset, and takes that combination as often as the counts allow.
Rows then find their place by their rank among the rows of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, task, text_of, utf8, written
from .tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Rows of one length that one task ranks.
RANKED = 1000


def fullest(room: int, counts: np.ndarray) -> dict[int, int]:
    """Lengths and how many of each that fill ``room`` best, no more of each than ``counts`` has.

    Bit s of ``reach`` says that some combination adds up to s. Counts are split into powers of two;
    longer lengths come first, and the search ends once the room is full, so that short lengths stay
    for later.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, k = min(int(counts[length]), room // length), 1
        while left:
            k = min(k, left)
            new = (reach | (reach << (length * k))) & mask
            if new != reach:
                steps.append((length, k, reach))
                reach = new
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def combinations(counts: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """Combinations (length: how many) and how often each is taken, until all counts are used."""
    left, out = counts.astype(np.int64).copy(), []
    for longest in range(min(size, len(left) - 1), 0, -1):
        while left[longest]:
            left[longest] -= 1
            used = fullest(size - longest, left)
            left[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            times = min(int(left[n]) // k for n, k in used.items())
            for n, k in used.items():
                left[n] -= k * times
            out.append((used, times))
    return out


def places(found: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and combination that uses it: from which rank on, where, in which sequences."""
    rows, ranks, sequence = [], {}, 0
    for used, times in found:
        offset = 0
        for n in sorted(used, reverse=True):
            rows.append((n, ranks.get(n, 0), used[n], sequence, offset))
            ranks[n] = ranks.get(n, 0) + used[n] * times
            offset += n * used[n]
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


def pack(items: DataFrame, size: int = 1024, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset (long): every row's place in sequences of ``size`` at most.

    Lengths must lie in 1..size (else ValueError). Rows with equal lengths are interchangeable;
    equal rows each get a place of their own. An empty table gives an empty one. A column that is
    called sequence_id or offset is replaced.
    """
    items = written(items.drop("sequence_id", "offset"), "pack")
    counts = np.zeros(size + 1, np.int64)
    for n, k in items.groupBy(F.col(length).cast("long")).count().limit(size + 2).collect():  # one row for each length
        if n is None or not 1 <= n <= size:
            raise ValueError(f"a length of {n} does not fit sequences of {size}")
        counts[n] = k
    at = places(combinations(counts, size))
    salts = max(1, -(-int(counts.max()) // RANKED))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = salted.groupBy(length, "_salt").count().withColumn("_before", F.sum("count").over(Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*order)) - 1).join(before.drop("count"), [length, "_salt"])
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_salt", "_before")
    cols = [c for c in items.columns]
    ranked = ranked.select(*cols, "_rank")
    schema = items.schema.add("sequence_id", "long").add("offset", "long")
    key = at["length"] << 44 | at["rank"]

    def place(batches):
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, "_rank"))
            k = np.searchsorted(key, n << 44 | rank, "right") - 1
            own = rank - at["rank"][k]
            sequence, offset = at["sequence"][k] + own // at["each"][k], at["offset"][k] + own % at["each"][k] * n
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in cols] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*cols, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def token_pieces(docs: DataFrame, vocabulary: str, size: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every whole text's ids with ``end`` behind them.

    A document of more than ``size`` ids is cut; all its pieces but the first hold ``size`` ids. A
    null or empty text has one piece, ``end`` alone. Other columns go; repeated rows stay.
    """

    @task("tokens")
    def cut(batches):
        for b in batches:
            docs_, (data, at) = b.column(0), utf8(b.column(1))
            for i, j in blocks(np.diff(at), 1 << 19):
                ids, ends = encoder(vocabulary).encode(data, at[i : j + 1], end)
                total = np.diff(ends)
                pieces = -(-total // size)
                doc = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (total - (pieces - 1) * size)[doc]
                start = np.where(piece == 0, 0, first + (piece - 1) * size)
                length = np.where(piece == 0, first, size)
                raw, at_ = memoryview(ids.astype("<u4", copy=False)).cast("B"), (ends[doc] + start) * 4
                sums = [zlib.crc32(raw[x : x + 4 * n]) for x, n in zip(at_.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs_[i:j].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], schema=_PIECES)

    return text_of(docs, "doc_id").mapInArrow(cut, PIECES)
