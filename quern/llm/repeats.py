"""Suffix-array dedup of byte strings that occur more than once, across all documents.

A window is a string of ``LENGTH`` bytes. Its anchor is the least hash of the grams of ``GRAM`` bytes in
it, so equal windows have equal anchors. Neighbouring windows of one anchor are a context. Contexts
meet by their anchors; equal ones are repeated as they are, and of each anchor under which different
contexts stand (or one that may hold a window twice) the contexts' texts form shards, which are
sorted by external induced sorting: there a window is repeated if it shares ``LENGTH`` bytes with a neighbour.
The contexts of an anchor that has more than a shard are split by the bytes beside the anchor (``parted``), again and
again as long as a key has more; in the end by whole windows, so that no task sorts much more than two shards.
Windows belong to one context each, so no window meets itself, and no repetition is split between shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, few, mix, task, utf8, written
from .induced import repeated_starts

LENGTH, GRAM = 200, 64
#: Grams of a window; text bytes that are looked at once; bytes of a shard, and the most of one key.
GRAMS, BLOCK, SHARD = LENGTH - GRAM + 1, 1 << 20, 1 << 20
#: What is known of a context: it was met several times, it is decided, it may repeat itself.
SEVERAL, DECIDED, ITSELF = 1, 2, 4
#: Stands between contexts; no byte of UTF-8 text, plus one, is that.
BETWEEN = 255
_P = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (a power of two) bytes from each position."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        for p in _P:
            h = h[:-size] * p + h[size:]
            size *= 2
            if size == 16:
                h = mix(h)
        return mix(h)


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: -(width - size)], h[width - size :]) if size < width else h


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, anchor, hash, start, number of windows, ITSELF or 0 of every context of some texts."""
    at = at - (base := at[0])
    text = data[base : base + at[-1]]
    if len(text) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = gram_hashes(text)
    least = sliding_minimum(h, GRAMS)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= at[doc + 1]
    first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])))
    n = np.diff(np.append(first, len(least)))
    first, n = first[inside[first]], n[inside[first]]
    anchor = least[first]
    # The anchor's gram more than once in a context: windows of it may be equal.
    found = []
    for begin in (first, first + n - 1):
        count, where = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for k in range(GRAMS):
            hit = h[begin + k] == anchor
            count += hit
            where[hit] = (begin + k)[hit]
        found += [count, where]
    itself = (found[0] > 1) | (found[2] > 1) | (found[1] != found[3])
    raw = text.tobytes()
    hashes = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + LENGTH - 1).tolist(), strict=True)], np.uint64)
    return doc[first], anchor, hashes, first - at[doc[first]], n, itself * ITSELF


def zone_lengths() -> list[int]:
    """The bytes around the anchor by which windows meet, for each level of parting: half of what is left is added each time."""
    out = [GRAM]
    while out[-1] < LENGTH:
        out.append(out[-1] + (LENGTH - out[-1] + 1) // 2)
    return out


def parted(data: np.ndarray, at: np.ndarray, anchor: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """body, key, hash, start and number of windows of the parts of some contexts' bodies.

    In each window a zone around its first anchor grows to ``zone_lengths()[level]`` bytes: by half of what is left of
    the window before it if there is so much, else by as much behind it. That depends on the window alone, so equal
    windows have equal zones, whose bytes are the key. Neighbouring windows with one zone are a part; it holds no window twice.
    """
    at = at - (base := at[0])
    text = data[base : base + at[-1]]
    body = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(text))
    w = place[place + LENGTH <= at[body + 1]]
    if not len(w):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = gram_hashes(text)
    met = np.flatnonzero(h == anchor[body[: len(h)]])
    met = met[met + GRAM <= at[body[met] + 1]]
    left, sizes = met[np.searchsorted(met, w)] - w, zone_lengths()
    for before, now in zip(sizes[:level], sizes[1 : level + 1], strict=True):
        left = np.where(left >= now - before, left - (now - before), left)
    zone, own = w + left, body[w]
    first = np.flatnonzero(np.append(True, (zone[1:] != zone[:-1]) | (own[1:] != own[:-1])))
    n = np.diff(np.append(first, len(w)))
    raw, begin, zone = text.tobytes(), w[first], zone[first]
    keys = np.array([xxhash.xxh3_64_intdigest(raw[a : a + sizes[level]]) for a in zone.tolist()], np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), (begin + n + LENGTH - 1).tolist(), strict=True)], np.uint64)
    return own[first], keys, hashes, begin - at[own[first]], n


def settled(doc: np.ndarray, anchor: np.ndarray, hashes: np.ndarray, start: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and what is known: of equal contexts in one block one goes on to meet others; the others are decided and dealt out anyhow."""
    _, first, inverse, count = np.unique(anchor ^ mix(hashes), return_index=True, return_inverse=True, return_counts=True)
    known = known | np.where(count[inverse] > 1, SEVERAL, 0)
    later = np.ones(len(doc), bool)
    later[first] = False
    with np.errstate(over="ignore"):
        anchor = np.where(later, mix(anchor + start.astype(np.uint64) * _P[0] + doc.astype(np.uint64) * _P[1]), anchor)
    return anchor, np.where(later, DECIDED, known)


_CONTEXTS = pa.schema([("anchor", pa.int64()), ("hash", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("known", pa.int32())])
CONTEXTS = "anchor bigint, hash bigint, doc_id bigint, key bigint, start int, n int, known int"


def _all_contexts(docs: DataFrame) -> DataFrame:
    """The contexts of all documents."""

    @task("repeats")
    def find(batches):
        for b in batches:
            data, at = utf8(b.column(2))
            ids, keys = b.column(0), b.column(1)
            for i, j in blocks(np.diff(at), BLOCK):
                doc, anchor, hashes, start, n, known = contexts(data, at[i : j + 1])
                if not len(doc):
                    continue
                anchor, known = settled(doc, anchor, hashes, start, known)
                rows = pa.array(doc + i)
                columns = [pa.array(anchor.view(np.int64)), pa.array(hashes.view(np.int64)), ids.take(rows), keys.take(rows), *[pa.array(x.astype(np.int32)) for x in (start, n, known)]]
                yield pa.RecordBatch.from_arrays(columns, schema=_CONTEXTS)

    return docs.select("doc_id", "key", "text").mapInArrow(find, CONTEXTS)


def _sorted_shards(asked: DataFrame) -> DataFrame:
    """doc_id, key, start, n of repeated windows, from contexts (anchor, doc_id, key, start, body)."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def solve(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        data, at = utf8(table.column("body").combine_chunks())
        sizes = np.diff(at)
        to = np.arange(at[-1] - at[0]) + np.repeat(np.arange(len(sizes)), sizes)
        text = np.full(int(sizes.sum()) + len(sizes), BETWEEN, np.int16)
        text[to] = data[at[0] : at[-1]].astype(np.int16) + 1
        begins = at[:-1] - at[0] + np.arange(len(sizes))
        repeated = repeated_starts(text, LENGTH)
        left = np.repeat(begins + sizes, sizes + 1) - np.arange(len(text))
        repeated &= left >= LENGTH
        edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = np.searchsorted(begins, lo, "right") - 1
        start = table.column("start").to_numpy()[row] + lo - begins[row]
        rows = pa.array(row)
        return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(rows), table.column("key").combine_chunks().take(rows), pa.array(start.astype(np.int32)), pa.array((hi - lo).astype(np.int32))], schema=schema)

    @task("repeats")
    def shards(batches):
        held, size = [], 0
        for b in batches:
            anchors = b.column(0).to_numpy()
            # Whole anchors only: cut where one ends.
            cuts = np.flatnonzero(np.diff(anchors)) + 1
            if held and held[-1].column(0)[-1].as_py() != anchors[0]:
                cuts = np.append(0, cuts)
            at = utf8(b.column(4))[1]
            done = 0
            for c in cuts.tolist():
                if size + at[c] - at[done] >= SHARD:
                    held += [b.slice(done, c - done)] if c > done else []
                    yield solve(held)
                    held, size, done = [], 0, c
            if done < b.num_rows:
                held.append(b.slice(done))
                size += int(at[-1] - at[done])
        if held:
            yield solve(held)

    return asked.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(shards, "doc_id bigint, key bigint, start int, n int")


def _bodies(docs: DataFrame, need: DataFrame) -> DataFrame:
    """The texts of contexts: anchor, doc_id, key, start, body."""
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("body", pa.binary())])

    @task("repeats")
    def cut(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                (data, at), lists = utf8(part.column(2)), part.column(3)
                counts = np.diff(lists.offsets.to_numpy())
                anchor, start, n = (x.to_numpy() for x in lists.flatten().flatten())
                doc = np.repeat(np.arange(part.num_rows), counts)
                lo = at[doc] + start
                raw = memoryview(data)
                bodies = [raw[x:y] for x, y in zip(lo.tolist(), (lo + n + LENGTH - 1).tolist(), strict=True)]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), part.column(0).take(rows), part.column(1).take(rows), pa.array(start), pa.array(bodies, pa.binary())], schema=schema)

    own = need.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("contexts"))
    joined = docs.join(own, ["doc_id", "key"]).select("doc_id", "key", "text", "contexts")
    return joined.mapInArrow(cut, "anchor bigint, doc_id bigint, key bigint, start int, body binary")


def _parts(bodies: DataFrame, level: int) -> DataFrame:
    """The parts of contexts, from their bodies: as contexts, with the gram of their anchor."""
    schema = _CONTEXTS.append(pa.field("gram", pa.int64()))

    @task("repeats")
    def part(batches):
        for b in batches:
            data, at = utf8(b.column(4))
            grams, starts = b.column(0).to_numpy().view(np.uint64), b.column(3).to_numpy()
            for i, j in blocks(np.diff(at), BLOCK):
                # A body may be cut between windows: those of one key meet again.
                for k in range(0, max(1, int(at[j] - at[i]) - LENGTH + 1), BLOCK) if j == i + 1 else (0,):
                    ends = np.array([at[i] + k, min(at[j], at[i] + k + BLOCK + LENGTH - 1)]) if j == i + 1 else at[i : j + 1]
                    body, anchor, hashes, start, n = parted(data, ends, grams[i:j], level)
                    if not len(body):
                        continue
                    start = start + starts[i:j][body] + k
                    anchor, known = settled(body + i, anchor, hashes, start, np.zeros(len(body), np.int64))
                    rows = pa.array(body + i)
                    columns = [pa.array(anchor.view(np.int64)), pa.array(hashes.view(np.int64)), b.column(1).take(rows), b.column(2).take(rows), *[pa.array(x.astype(np.int32)) for x in (start, n, known)], b.column(0).take(rows)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return bodies.mapInArrow(part, f"{CONTEXTS}, gram bigint")


def _met(contexts: DataFrame) -> DataFrame:
    """Contexts (and their grams) that are repeated, and those that are asked for: whose texts have to be compared."""
    own = Window.partitionBy("anchor")
    ordered = own.orderBy("hash", "doc_id", "key", "start")
    met = contexts.withColumns({"before": F.lag("hash").over(ordered), "after": F.lead("hash").over(ordered)})
    met = met.withColumn("different", F.max((F.col("before") != F.col("hash")).cast("int")).over(own))
    again, next_same = F.coalesce(F.col("before") == F.col("hash"), F.lit(False)), F.coalesce(F.col("after") == F.col("hash"), F.lit(False))
    repeated = again | next_same | (F.col("known").bitwiseAND(F.lit(SEVERAL | DECIDED)) > 0)
    # One of each kind of context under an anchor with several kinds, and those that may repeat themselves.
    asked = ~again & (F.col("known").bitwiseAND(F.lit(DECIDED)) == 0) & ((F.coalesce("different", F.lit(0)) == 1) | ((F.col("known").bitwiseAND(F.lit(ITSELF)) > 0) & ~repeated))
    found = met.withColumns({"repeated": repeated, "asked": asked}).filter("repeated or asked")
    # The anchor of a context that is asked for is its gram, but for parts.
    return found.select("anchor", "doc_id", "key", "start", "n", "repeated", "asked", *[c for c in contexts.columns if c == "gram"])


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of windows that are repeated, and contexts (anchor, doc_id, key, start, n) to be sorted, of no key more than a shard."""
    runs, context = ["doc_id", "key", "start", "n"], ["anchor", "doc_id", "key", "start", "n"]
    found = written(_met(_all_contexts(docs)), "contexts")
    repeated, asked, small = found.filter("repeated").select(*runs), found.filter("asked").withColumn("gram", F.col("anchor")), []
    for level in range(1, len(zone_lengths())):
        large = written(asked.groupBy("anchor").agg(F.sum(F.col("n") + F.lit(LENGTH - 1)).alias("size")).filter(F.col("size") > SHARD).select("anchor"), "large")
        if large.isEmpty():
            break
        large = few(large)
        small.append(asked.join(large, "anchor", "left_anti").select(*context))
        need = asked.join(large, "anchor", "left_semi").select(F.col("gram").alias("anchor"), *runs)
        found = written(_met(_parts(_bodies(docs, need), level)), "parts")
        repeated, asked = repeated.unionByName(found.filter("repeated").select(*runs)), found.filter("asked")
    asked = asked.select(*context)
    for other in small:
        asked = asked.unionByName(other)
    return repeated, asked


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, key, start, n: runs of windows (n of them from byte start on) that occur elsewhere too.

    ``docs`` has doc_id, key (of doc_id and text) and text.
    """
    repeated, asked = groups(docs)
    return repeated.unionByName(_sorted_shards(_bodies(docs, asked)))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text (null: empty), key and more of every row; a null doc_id has a number from the text in its place, so that joins find it."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(F.lit("no id"), text)).alias("doc_id"), text.alias("text"), *more)
    return own.withColumn("key", F.xxhash64("doc_id", "text"))


def removal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans (start and stop of bytes, unordered, may overlap) of documents with repeated strings."""
    found = repeated_windows(docs)
    span = F.struct("start", (F.col("start") + F.col("n") + F.lit(LENGTH - 1)).alias("stop"))
    return found.groupBy("doc_id", "key").agg(F.collect_list(span).alias("spans"))


def merged_spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs: disjoint, ascending, not touching."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order]) if len(order) else stops
    new = np.append(True, starts[1:] > stops[:-1])[: len(starts)]
    lo = np.flatnonzero(new)
    return starts[lo], stops[np.append(lo[1:], len(starts)) - 1] if len(lo) else stops[:0]


def _with_spans(docs: DataFrame):
    """Documents (doc_id, key, text and more) with their spans, or null."""
    return docs.join(removal_spans(docs.select("doc_id", "key", "text")), ["doc_id", "key"], "left")


def _kept(batch: pa.RecordBatch, text: int, spans: int):
    """For each row the merged spans and the bytes that stay."""
    lists = batch.column(spans)
    for t, own in zip(batch.column(text).to_pylist(), lists, strict=True):
        data = t.encode("utf-8", "surrogatepass")
        if not own.is_valid:
            yield data, np.zeros(0, np.int64), np.zeros(0, np.int64), data
            continue
        starts, stops = (x.to_numpy().astype(np.int64) for x in own.values.flatten())
        starts, stops = merged_spans(starts, stops)
        edges = np.concatenate([[0], np.column_stack([starts, stops]).ravel(), [len(data)]]).tolist()
        yield data, starts, stops, b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Repeated rows are judged each (each other's copies); null and empty texts have nothing to remove; an empty table gives
    an empty one; other columns go.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    @task("repeats")
    def digest(batches):
        for b in batches:
            rows = [(len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()) for data, starts, _, kept in _kept(b, 1, 2)]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]], schema=schema)

    return _with_spans(_keyed(docs, F.col("doc_id").alias("_own"))).select("_own", "text", "spans").mapInArrow(digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """The columns of documents, repeated strings removed from their texts; n_chars follows the text.

    Pieces of characters that a cut leaves go as well. Documents of which nothing is left go; so do
    null and empty ones, and repeated rows that are copies of each other from end to end. Other documents stay as they are.
    An empty table gives an empty one.
    """
    columns, fields = docs.columns, docs.schema
    joined = _with_spans(_keyed(docs, F.struct(*columns).alias("_row")))

    @F.pandas_udf("string")
    def without(text, spans):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array([None if s is None else list(s) for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["text", "spans"])
        return pd.Series([kept.decode("utf-8", "ignore") for *_, kept in _kept(batch, 0, 1)])

    changed = joined.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(without("text", "spans"))).filter(F.col("text") != "")
    return changed.select(*[F.col("text") if c == "text" else F.char_length("text").cast(fields[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in columns])
