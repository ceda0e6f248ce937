"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of documents as word numbers. Words that no benchmark phrase holds cannot
lie in a match, so they only part the rest into segments, and segments shorter than the shortest
phrase go. Over what is left stands an FM-index: a suffix array's last column (the Burrows-Wheeler
transform) in a wavelet matrix with rank directories, and sampled suffix positions. All phrases are
searched backwards at once; their occurrences are located by walking to the next sampled position.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, task, text_of, utf8, written

#: Words of a window, text bytes of a shard, benchmark bytes that are broadcast at once, distance of sampled positions.
WINDOW, SHARD, BLOCK, SAMPLED = 10, 8 << 20, 1 << 20, 8
#: Bytes as the words are made of: A-Z lower-cased; digits, letters and all beyond ASCII stay; the rest parts words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(TABLE).split()


class Phrases:
    """The distinct windows of some benchmark items, as word numbers from 1, and their items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of((text or "").encode("utf-8", "surrogatepass"))]
            for k in range(max(1, len(own) - WINDOW + 1) if own else 0):
                found.setdefault(tuple(own[k : k + WINDOW]), set()).add(item)
        self.phrases = list(found)
        self.items = [sorted(x, key=str) for x in found.values()]
        self.lengths = np.array([len(p) for p in self.phrases], np.int64)
        self.words = np.zeros((len(self.phrases), WINDOW), np.int64)
        for k, p in enumerate(self.phrases):
            self.words[k, : len(p)] = p


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words).astype(np.int64)))[:-1]

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)


class Wavelet:
    """A wavelet matrix: rank and access over numbers below 2 ** depth."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels = []
        for k in range(depth - 1, -1, -1):
            bit = (symbols >> k & 1).astype(bool)
            self.levels.append((k, Bits(bit), len(bit) - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        first = np.zeros_like(at)
        for k, bits, zeros in self.levels:
            one = symbol >> k & 1
            r, f = bits.rank(at), bits.rank(first)
            at, first = np.where(one, zeros + r, at - r), np.where(one, zeros + f, first - f)
        return at - first

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k, bits, zeros in self.levels:
            one, r = bits.get(at), bits.rank(at)
            out |= one << k
            at = np.where(one, zeros + r, at - r)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text``; each 0 is smaller than all else and differs from other zeros. Ends with a 0."""
    n, zero = len(text), text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        new = np.append(0, np.cumsum(np.diff(rank[order]) != 0)) if step == 1 else np.append(0, np.cumsum(np.diff(key[order]) != 0))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        step *= 2


class FMIndex:
    """Over segments of numbers from 1, each with a 0 before it, and a 0 at the end."""

    def __init__(self, text: np.ndarray):
        order, most = suffix_order(text), int(text.max())
        last = text[order - 1]  # position 0 has the 0 at the end before it
        self.wavelet = Wavelet(last, max(1, most.bit_length()))
        self.starts = np.append(0, np.cumsum(np.bincount(text, minlength=most + 1)))
        # A walk back ends at the latest where a segment begins, so it never meets a 0.
        sampled = (order % SAMPLED == 0) | (last == 0)
        self.sampled, self.positions, self.most = Bits(sampled), order[sampled], most

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase."""
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.starts[-1])
        for k in range(words.shape[1] - 1, -1, -1):
            on = np.flatnonzero((k < lengths) & (lo < hi))
            c = words[on, k]
            known = c <= self.most
            hi[on[~known]] = lo[on[~known]]
            on, c = on[known], c[known]
            lo[on], hi[on] = self.starts[c] + self.wavelet.rank(c, lo[on]), self.starts[c] + self.wavelet.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            there = self.sampled.get(rows) == 1
            out[todo[there]] = self.positions[self.sampled.rank(rows[there])] + steps
            todo, rows = todo[~there], rows[~there]
            c = self.wavelet.access(rows)
            rows = self.starts[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out


def occurrences(numbers: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and position of every occurrence in word numbers (0: any other word, or a document's end)."""
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths):
        return none, none
    inside = np.diff(np.concatenate([[0], (numbers > 0).astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    long = ends - begins >= phrases.lengths.min()
    begins, sizes = begins[long], (ends - begins)[long]
    if not len(begins):
        return none, none
    # A 0, the segment, a 0, the next segment, ... and a 0.
    offset = np.cumsum(sizes + 1) - sizes
    where = np.repeat(begins - offset, sizes) + (at := np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(sizes) + 1), sizes))
    text = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int64)
    text[at] = numbers[where]
    index = FMIndex(text)
    lo, hi = index.search(phrases.words, phrases.lengths)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    found = index.locate(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[which])
    back = np.zeros(len(text), np.int64)
    back[at] = where
    return which, back[found]


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
FOUND = "doc_id bigint, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending spans that cover the same words; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard_hits(data: np.ndarray, at: np.ndarray, phrases: Phrases) -> tuple[list[int], dict[int, list], dict[int, set]]:
    """Of some documents: numbers of words; spans and items of those with hits."""
    counts, parts, zero = [], [], np.zeros(1, np.int64)
    get = phrases.numbers.get
    raw = data[at[0] : at[-1]].tobytes().translate(TABLE)
    for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True):
        own = raw[a:b].split()
        counts.append(len(own))
        parts += [np.fromiter(map(get, own, repeat(0)), np.int64, len(own)), zero]
    which, position = occurrences(np.concatenate(parts), phrases)
    first = np.cumsum(np.array(counts) + 1) - counts - 1
    doc = np.searchsorted(first, position, "right") - 1
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    for d, w, p in zip(doc.tolist(), which.tolist(), (position - first[doc]).tolist(), strict=True):
        spans.setdefault(d, []).append((p, p + len(phrases.phrases[w])))
        items.setdefault(d, set()).update(phrases.items[w])
    return counts, spans, items


def _one_block(docs: DataFrame, items: list[tuple], keep_text: bool, hits_only: bool) -> DataFrame:
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases(items))  # of BLOCK bytes of text at most, or one item
    schema = _FOUND if keep_text else _FOUND.remove(1)

    @task("phrases")
    def find(batches):
        own = phrases.value
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in blocks(np.diff(at), SHARD):
                counts, spans, found = shard_hits(data, at[i : j + 1], own)
                take = sorted(spans) if hits_only else range(j - i)
                columns = [
                    b.column(0)[i:j].take(pa.array(take, pa.int64())),
                    *[b.column(1)[i:j].take(pa.array(take, pa.int64()))] * keep_text,
                    pa.array([counts[k] for k in take], pa.int64()),
                    pa.array([[{"start": x, "stop": y} for x, y in merged(spans.get(k, ()))] for k in take], pa.list_(_SPAN)),
                    pa.array([sorted(map(str, found.get(k, ()))) for k in take], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(find, FOUND.replace("n_words", "text string, n_words") if keep_text else FOUND)


def _benchmark_blocks(benchmark: DataFrame):
    """Lists of items (item_id, text) of ``BLOCK`` characters at most, or of one larger item."""
    part, size = [], 0
    for item, text in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        if part and size + len(text) > BLOCK:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += len(text)
    if part:
        yield part


def hits(docs: DataFrame, benchmark: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, (text,) n_words, spans (merged spans of hit words) and items (sorted ids) of every document.

    ``benchmark`` has item_id and text. It is taken in blocks of ``BLOCK`` bytes; with more than one,
    the blocks' spans and items are merged per doc_id and text. Null texts have no words and no windows; an empty
    table gives an empty one; an empty benchmark hits nothing; repeated rows are searched each.
    """
    docs = text_of(docs, "doc_id")
    # The driver holds one block and the next item.
    blocks_, key = _benchmark_blocks(benchmark), F.struct("doc_id", F.md5("text").alias("text")).alias("_key")
    first, second = next(blocks_, []), next(blocks_, None)
    if second is None:
        return _one_block(docs, first, keep_text, False)
    out = written(_one_block(docs, first, True, False), "hits").withColumn("_key", key)
    rest = None
    while second is not None:
        one = written(_one_block(docs, second, True, True).select(key, F.col("spans").alias("s"), F.col("items").alias("i")), "hits")
        rest, second = one if rest is None else rest.unionByName(one), next(blocks_, None)
    rest = rest.groupBy("_key").agg(F.array_distinct(F.flatten(F.collect_set("s"))).alias("s"), F.array_distinct(F.flatten(F.collect_set("i"))).alias("i"))
    joined = out.join(rest.withColumnRenamed("_key", "_of"), F.col("_key").eqNullSafe(F.col("_of")), "left")
    every = F.array_sort(F.concat("spans", F.coalesce("s", F.slice("spans", 1, 0))))
    empty = F.slice("spans", 1, 0)
    joins = lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["stop"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(x)))
    items = F.sort_array(F.array_distinct(F.concat("items", F.coalesce("i", F.array().cast("array<string>")))))
    return joined.select("doc_id", *["text"] * keep_text, "n_words", F.aggregate(every, empty, joins).alias("spans"), items.alias("items"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated from ``hits``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between those; a line end takes their place."""
    data = text.encode("utf-8", "surrogatepass")
    plain = data.translate(TABLE)
    starts, ends, at = [], [], 0
    for w in plain.split():
        at = plain.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : starts[a]])
        last = ends[b - 1]
    out.append(data[last:])
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of documents, with all hit words cut out; n_chars follows the text.

    Documents without hits stay as they are (a null text becomes an empty one); those of which no word
    is left go.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = docs.select(F.struct("doc_id", *others).alias("_row"), "text", "doc_id")
    found = hits(carried.select("doc_id", "text"), benchmark, keep_text=True).filter(F.size("spans") > 0).select("doc_id", "text", "spans").distinct()

    @F.pandas_udf("string")
    def without(text, spans):
        import pandas as pd

        return pd.Series([cut(t, [(s["start"], s["stop"]) for s in own]) for t, own in zip(text, spans, strict=True)])

    changed = found.select(F.col("doc_id").alias("_of"), F.md5("text").alias("_key"), without("text", "spans").alias("_cut"))
    joined = docs.join(changed, docs["doc_id"].eqNullSafe(F.col("_of")) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == F.col("_key")), "left")
    left = joined.filter(F.col("_cut").isNull() | F.col("_cut").rlike(r"[0-9A-Za-z\x{80}-\x{10ffff}]"))
    text = F.coalesce("_cut", "text", F.lit(""))
    return left.select(*[text.alias(c) if c == "text" else F.char_length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def items_sha256(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
