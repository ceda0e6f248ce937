"""LM scoring by context-tree weighting over bytes.

Texts become canonical bytes: their words (A-Z lower-cased) with one space between and a line end
behind the last. Each byte is a row of binary decisions along a Huffman code; the decisions of one
node of the code in one context (the last 0 to ``DEPTH`` bytes) have a Krichevsky-Trofimov estimate, and the
estimates of all depths are mixed with the weights of context-tree weighting. Nodes have exact keys (the
context and the node of the code).

No table of the whole corpus is ever in one place. Texts are taken in blocks; each block asks for its distinct
n-grams and words (with their counts in texts that are learned from), which are dealt to buckets, n-grams by the last ``CUT``
bytes of their context. A bucket adds up its counts, weighs its part of the tree (contexts from ``CUT`` to
``DEPTH`` bytes), and answers each block with the values of what that has asked for; the block's texts then meet the answers.
The contexts shorter than ``CUT`` (their number is bounded by the bytes there are, not by the corpus) are
added up from the buckets and weighed on the driver.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, blocks, mix, task, text_of, utf8

DEPTH, CUT, END = 5, 3, 10
#: Canonical bytes of a block, and of those that are counted or scored at once.
BLOCK, PIECE = 16 << 20, 2 << 20
#: Text bytes for each bucket, and the most buckets (what is distinct in a bucket grows slowly then; a bucket's questions pass by in a stream).
BUCKET, MOST_BUCKETS = 16 << 20, 1 << 14
#: N-grams that are folded, weighed or looked up at once, and that are kept apart before they are added up.
GRAMS, MERGE = 1 << 17, 1 << 21
#: Buckets' sums over short contexts are added up by so many tasks before they reach the driver.
TOPS = 16
_LOWER = np.array([c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256)], np.uint8)


def canonical(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The canonical bytes of texts and their offsets: words with single spaces, ``END`` behind each text."""
    n, size = len(at) - 1, at[-1] - at[0]
    stream = np.full(size + n, END, np.uint8)
    ends = at[1:] - at[0] + np.arange(n)
    text = np.ones(size + n, bool)
    text[ends] = False
    stream[text] = _LOWER[data[at[0] : at[-1]]]
    # Of a run of spaces the last one stays, but for those before an end; then none stays behind an end.
    space = stream == 32
    keep = ~(space & np.append(space[1:] | (stream[1:] == END), True))
    stream = stream[keep]
    after = np.append(True, stream[:-1] == END)
    stream = stream[~((stream == 32) & after)]
    ends = np.flatnonzero(stream == END)
    return stream, np.append(0, ends + 1)


def grams(stream: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each byte the number of it (lowest eight bits) and the ``depth`` bytes before it; before a text stand ENDs."""
    code = stream.astype(np.uint64)
    within = np.arange(len(stream)) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, depth + 1):
        before = np.full(len(stream), END, np.uint64)
        before[k:] = stream[:-k]
        before[within < k] = END
        code |= before << np.uint64(8 * k)
    return code


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each byte its path: nodes (256 x length, -1: past the end) and bits; every byte gets a code."""
    heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    children, new = {}, 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        children[new] = (x, y)
        heapq.heappush(heap, (a + b, new, new))
        new += 1
    paths: dict[int, list[tuple[int, int]]] = {new - 1: []}
    for node in range(new - 1, 255, -1):
        for bit, child in enumerate(children[node]):
            paths[child] = [*paths[node], (node - 256, bit)]
    longest = max(len(paths[k]) for k in range(256))
    nodes, bits = np.full((256, longest), -1, np.int64), np.zeros((256, longest), np.int64)
    for k in range(256):
        for j, (node, bit) in enumerate(paths[k]):
            nodes[k, j], bits[k, j] = node, bit
    return nodes, bits, longest


def node_keys(codes: np.ndarray, depth: int, node: np.ndarray) -> np.ndarray:
    """The key of a node of the Huffman code in the context of the last ``depth`` bytes: the context, and the node in the lowest eight bits."""
    return (codes.view(np.int64) >> 8 & (1 << 8 * depth) - 1) << 8 | node


def shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """Of keys at ``depth`` those of the same nodes in the context that is one byte shorter."""
    return (keys >> 8 & (1 << 8 * (depth - 1)) - 1) << 8 | keys & 255


def added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sums of their values."""
    own, inverse = np.unique(keys, return_inverse=True)
    return own, *[np.bincount(inverse, v, len(own)) for v in values]


def fold(codes: np.ndarray, counts: np.ndarray, code: tuple, block: int, depth: int = DEPTH, least: int = 0) -> tuple[list, list, list]:
    """Keys (ascending), zeros and ones of all nodes that n-grams touch, for each depth from ``least`` on; ``block``: n-grams at once."""
    nodes, bits, longest = code
    found = []
    for k in range(0, len(codes), block):
        c, n = codes[k : k + block], counts[k : k + block]
        symbol, parts = (c & np.uint64(255)).astype(np.int64), []
        for j in range(longest):
            on = nodes[symbol, j] >= 0
            if not on.any():
                break
            bit = bits[symbol[on], j]
            parts.append((node_keys(c[on], depth, nodes[symbol[on], j]), np.where(bit == 0, n[on], 0), np.where(bit == 1, n[on], 0)))
        found.append(added(*(np.concatenate(x) for x in zip(*parts, strict=True))))
    level = added(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    levels = [level]
    for d in range(depth, least, -1):
        level = added(shorter(level[0], d), *level[1:])
        levels.append(level)
    return tuple(list(x) for x in zip(*levels[::-1], strict=True))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift -= np.log(x + k)
    y = x + 8
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)


def weighed(keys: list, zeros: list, ones: list, block: int, least: int = 0, below: np.ndarray | None = None) -> tuple[list, list, np.ndarray]:
    """For each depth from ``least`` on the keys with the estimates of a one, and the weights of the own estimates against longer contexts'.

    Last comes the log probability that each node of the least depth gives to all that it has seen. ``below``: the
    sums of that over the longer contexts of the deepest nodes; without it those are the tree's leaves.
    """
    estimate, weight, half = [], [], math.log(0.5)
    for d in range(least + len(keys) - 1, least - 1, -1):
        k = d - least
        total, e, w = (np.ones(len(keys[k])) for _ in range(3))
        for i in range(0, len(total), block):
            on = slice(i, i + block)
            a, b = zeros[k][on].astype(float), ones[k][on].astype(float)
            own = _lgamma(a + 0.5) + _lgamma(b + 0.5) - math.log(math.pi) - _lgamma(a + b + 1)
            total[on] = own if below is None else np.logaddexp(half + own, half + below[on])
            if below is not None:
                w[on] = np.exp(half + own - total[on])
            e[on] = (b + 0.5) / (a + b + 1.0)
        estimate.append((keys[k], e))
        weight.append(w)
        if k:
            below = np.bincount(np.searchsorted(keys[k - 1], shorter(keys[k], d)), total, len(keys[k - 1]))
    return estimate[::-1], weight[::-1], total


def weigh(keys: list, zeros: list, ones: list, block: int) -> tuple[list, list]:
    """``weighed`` of a whole tree, without the total."""
    return weighed(keys, zeros, ones, block)[:2]


def log10_probability(codes: np.ndarray, model: tuple, depth: int = DEPTH) -> np.ndarray:
    """log10 of each byte's probability in its context; a context never seen leaves its parent's mixture as it is."""
    estimate, weight, (nodes, bits, longest) = model
    symbol, out = (codes & np.uint64(255)).astype(np.int64), np.zeros(len(codes))
    for j in range(longest):
        on = np.flatnonzero(nodes[symbol, j] >= 0)
        if not len(on):
            break
        c, node, bit = codes[on], nodes[symbol[on], j], bits[symbol[on], j]
        p = np.full(len(on), np.nan)
        for d in range(depth, -1, -1):
            (keys, e), w = estimate[d], weight[d]
            if not len(keys):
                continue
            key = node_keys(c, d, node)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            p = np.where(keys[at] != key, p, np.where(np.isnan(p), e[at], w[at] * e[at] + (1 - w[at]) * p))
        p = np.where(np.isnan(p), 0.5, p)
        out[on] += np.log10(np.where(bit == 1, p, 1 - p))
    return out


def held_out():
    """Whether crc32 of the doc_id as text leaves no remainder by 10 (null: as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _is_held_out(ids: pa.Array) -> np.ndarray:
    """``held_out`` in a task."""
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d in ids.to_pylist()], bool)


def small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def large(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits, compressed plane by plane: ascending ones and small ones take a few bytes so."""
    return small(numbers.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(large(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


#: What a row is: some texts; a block's n-grams or words in one bucket; a bucket's; counts of bytes; sums over short contexts.
TEXT, ASKED_GRAMS, ASKED_WORDS, GRAM_COUNTS, WORD_COUNTS, BYTES, SHORT = range(7)
#: For texts: canonical bytes, and of each text the size, doc_id and marks. For grams and words: those, and their counts
#: or values. n, v: for texts how many there are, and are learned from; for words the sum, and how many have a count.
ROWS = "kind int, block bigint, bucket int, n bigint, v bigint, data binary, numbers binary"
_ROWS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("v", pa.int64()), ("data", pa.binary()), ("numbers", pa.binary())])
#: Marks of texts: held out; without a doc_id.
HELD, NO_ID = 1, 2


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ROWS)


def _added(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and the sums of their counts."""
    if not kept:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(kept) == 1:
        return kept[0]
    grams, counts = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


class Asked:
    """The distinct n-grams and words of a block's texts, with their counts in the texts that are learned from."""

    def __init__(self, depth: int, buckets: int, cut: int):
        self.depth, self.buckets, self.cut = depth, buckets, cut
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: Counter = Counter()
        self.held: set[bytes] = set()
        self.size = 0

    def add(self, stream: np.ndarray, ends: np.ndarray, held: np.ndarray) -> None:
        mark, sizes = np.uint64(1 << 63), np.diff(ends)
        of_held = np.repeat(held, sizes)
        own = np.sort(grams(stream, ends, self.depth) | np.where(of_held, mark, np.uint64(0)))
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
        count, own = np.diff(np.append(first, len(own))), own[first]
        split = int(np.searchsorted(own, mark))
        self.grams += [(own[:split], count[:split]), (own[split:] & ~mark, np.zeros(len(own) - split, np.int64))]
        if sum(len(g) for g, _ in self.grams) > MERGE:
            self.grams = [_added(self.grams)]
        self.words.update(stream[~of_held].tobytes().split())
        self.held.update(stream[of_held].tobytes().split())
        self.size += len(stream)

    def rows(self, block: int) -> Iterator[dict]:
        own, count = _added(self.grams)
        context = own >> np.uint64(8) & np.uint64((1 << 8 * self.cut) - 1)
        bucket = (mix(context + np.uint64(1)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(bucket, minlength=self.buckets)))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            on = order[ends[k] : ends[k + 1]]
            yield {"kind": ASKED_GRAMS, "block": block, "bucket": k, "data": packed(own[on]), "numbers": packed(count[on])}
        dealt: dict[int, list[bytes]] = {}
        for w in self.held:
            self.words.setdefault(w, 0)
        for w in self.words:
            dealt.setdefault(zlib.crc32(w) % self.buckets, []).append(w)
        for k, words in dealt.items():
            yield {"kind": ASKED_WORDS, "block": block, "bucket": k, "data": small(b" ".join(words)), "numbers": packed(np.array([self.words[w] for w in words], np.int64))}


def _blocks(docs: DataFrame, depth: int, buckets: int, cut: int) -> DataFrame:
    """Texts, with the block that each is in, and what the blocks ask for."""

    @task("ctw")
    def gather(batches):
        block, asked, symbols = TaskContext.get().partitionId() << 32, Asked(depth, buckets, cut), np.zeros(256, np.int64)
        for b in batches:
            data, at = utf8(b.column(1))
            held_ = _is_held_out(b.column(0))
            for i, j in blocks(np.diff(at), PIECE):
                stream, ends = canonical(data, at[i : j + 1])
                held = held_[i:j]
                symbols += np.bincount(stream[~np.repeat(held, np.diff(ends))], minlength=256)
                asked.add(stream, ends, held)
                ids = b.column(0)[i:j]
                none = ids.is_null().to_numpy(zero_copy_only=False)
                about = np.concatenate([np.diff(ends), ids.fill_null(0).to_numpy(), held * HELD + none * NO_ID]).astype(np.int64)
                yield _batch([{"kind": TEXT, "block": block, "n": j - i, "v": int((~held).sum()), "data": small(stream.tobytes()), "numbers": packed(about)}])
                if asked.size >= BLOCK:
                    for row in asked.rows(block):
                        yield _batch([row])
                    block, asked = block + 1, Asked(depth, buckets, cut)
        for row in asked.rows(block):
            yield _batch([row])
        if symbols.any():
            yield _batch([{"kind": BYTES, "bucket": k, "n": int(n)} for k, n in enumerate(symbols.tolist()) if n])

    return docs.mapInArrow(gather, ROWS)


def _of_buckets(batches) -> Iterator[tuple[int, Iterator[dict]]]:
    """Each bucket with its rows, from batches in order of buckets."""
    rows = (r for b in batches for r in b.select(["kind", "block", "bucket", "data", "numbers"]).to_pylist())
    row = next(rows, None)
    while row is not None:
        bucket = row["bucket"]

        def own():
            nonlocal row
            while row is not None and row["bucket"] == bucket:  # noqa: B023
                yield row
                row = next(rows, None)

        each = own()
        yield bucket, each
        for _ in each:
            pass


def _counts(asked: DataFrame, code: tuple, depth: int, cut: int) -> DataFrame:
    """The buckets' n-grams and words with the sums of their counts, and sums over their contexts of ``cut`` bytes."""

    @task("ctw")
    def count(batches):
        for bucket, rows in _of_buckets(batches):
            kept, size, words = [], 0, Counter()
            for r in rows:
                numbers = unpacked(r["numbers"])
                if r["kind"] == ASKED_GRAMS:
                    kept.append((unpacked(r["data"], np.uint64), numbers))
                    size += len(numbers)
                    if size > MERGE:
                        kept = [_added(kept)]
                        size = len(kept[0][0]) // 2
                else:
                    for w, n in zip(large(r["data"]).split(b" "), numbers.tolist(), strict=True):
                        words[w] += n
            own, n = _added(kept)
            for k in range(0, len(own), MERGE):
                yield _batch([{"kind": GRAM_COUNTS, "bucket": bucket, "data": packed(own[k : k + MERGE]), "numbers": packed(n[k : k + MERGE])}])
            if words:
                numbers = np.fromiter(words.values(), np.int64, len(words))
                yield _batch([{"kind": WORD_COUNTS, "bucket": bucket, "n": int(numbers.sum()), "v": int((numbers > 0).sum()), "data": small(b" ".join(words)), "numbers": packed(numbers)}])
            if cut and (n > 0).any():
                keys, zeros, ones = fold(own[n > 0], n[n > 0], code, GRAMS, depth, cut)
                total = weighed(keys, zeros, ones, GRAMS, cut)[2]
                sums = added(shorter(keys[0], cut), zeros[0], ones[0], total)
                yield _batch([{"kind": SHORT, "bucket": bucket, "data": sums[0].tobytes(), "numbers": np.concatenate(sums[1:]).tobytes()}])

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, ROWS)


def _sums(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, ...]:
    """Keys with their zeros, ones and totals, added up."""
    parts = [(np.frombuffer(d, np.int64), *np.frombuffer(x, np.float64).reshape(3, -1)) for d, x in rows]
    return added(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else tuple(np.zeros(0, t) for t in (np.int64, float, float, float))


def _short(counted: DataFrame, cut: int) -> tuple[list, list]:
    """Estimates and weights of the contexts of fewer than ``cut`` bytes."""
    if not cut:
        return [], []

    @task("ctw")
    def add(batches):
        rows: list[tuple[bytes, bytes]] = []
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.append((d, x))
                if len(rows) > 16:
                    keys, *values = _sums(rows)
                    rows = [(keys.tobytes(), np.concatenate(values).tobytes())]
        keys, *values = _sums(rows)
        yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([np.concatenate(values).tobytes()])], names=["data", "numbers"])

    own = counted.filter(F.col("kind") == SHORT).select("data", "numbers", F.pmod("bucket", F.lit(TOPS)).alias("to"))
    sums = own.repartition(TOPS, "to").select("data", "numbers").mapInArrow(add, "data binary, numbers binary")
    # TOPS rows: contexts of CUT - 1 bytes are a bounded number, however large the corpus.
    keys, zeros, ones, total = _sums([(bytes(d), bytes(x)) for d, x in sums.collect()])
    levels = [(keys, zeros, ones)]
    for d in range(cut - 1, 0, -1):
        levels.append(added(shorter(levels[-1][0], d), *levels[-1][1:]))
    return weighed(*(list(x) for x in zip(*levels[::-1], strict=True)), GRAMS, 0, total)[:2]


def _answers(asked: DataFrame, counted: DataFrame, code: tuple, top: tuple, depth: int, cut: int) -> DataFrame:
    """For each block and bucket the n-grams that it has asked for with the log10 of their probabilities, and the words with their counts."""
    shared = asked.sparkSession.sparkContext.broadcast(top)

    @task("ctw")
    def answer(batches):
        for _, rows in _of_buckets(batches):
            counts, words, grams_, values = [], {}, None, None
            for r in rows:
                if r["kind"] == GRAM_COUNTS:
                    counts.append((unpacked(r["data"], np.uint64), unpacked(r["numbers"])))
                elif r["kind"] == WORD_COUNTS:
                    words.update(zip(large(r["data"]).split(b" "), unpacked(r["numbers"]).tolist(), strict=True))
                elif r["kind"] == ASKED_WORDS:
                    yield _batch([{**r, "numbers": packed(np.array([words[w] for w in large(r["data"]).split(b" ")], np.int64))}])
                else:
                    if grams_ is None:
                        grams_, n = _added(counts)
                        estimate, weight, _ = weighed(*fold(grams_[n > 0], n[n > 0], code, GRAMS, depth, cut), GRAMS, cut)
                        model = (shared.value[0] + estimate, shared.value[1] + weight, code)
                        values = np.concatenate([log10_probability(grams_[k : k + GRAMS], model, depth) for k in range(0, len(grams_), GRAMS)])
                    yield _batch([{**r, "numbers": packed(values[np.searchsorted(grams_, unpacked(r["data"], np.uint64))])}])

    columns = ["kind", "block", "bucket", "n", "v", "data", "numbers"]
    both = counted.filter(F.col("kind").isin(GRAM_COUNTS, WORD_COUNTS)).unionByName(asked).select(*columns)
    # Counts come before questions.
    return both.repartition("bucket").sortWithinPartitions("bucket", F.col("kind").isin(ASKED_GRAMS, ASKED_WORDS)).mapInArrow(answer, ROWS)


class Answers:
    """What a block's texts are scored with; ``below``: the base's denominator."""

    def __init__(self, below: float):
        self.below, self.unknown = below, math.log10(0.1 / below)
        self.grams: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.words: dict[bytes, float] = {}
        self.ready = False

    def add(self, kind: int, data: bytes, numbers: bytes) -> None:
        if kind == ASKED_GRAMS:
            self.grams.append(unpacked(data, np.uint64))
            self.values.append(unpacked(numbers, np.float64))
        else:
            n = unpacked(numbers)
            logs = np.where(n > 0, np.log10((n + 0.1) / self.below), self.unknown)
            self.words.update(zip(large(data).split(b" "), logs.tolist(), strict=True))

    def prepared(self) -> None:
        if not self.ready:
            own, values = np.concatenate(self.grams), np.concatenate(self.values)
            order = np.argsort(own)
            self.grams, self.values, self.ready = own[order], values[order], True

    def scores(self, stream: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
        """The log10 probabilities of texts (65,536 at most)."""
        self.prepared()
        sizes = np.diff(ends)
        own = np.sort(grams(stream, ends, depth) << np.uint64(16) | np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes))
        gram = own >> np.uint64(16)
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
        value = self.values[np.searchsorted(self.grams, gram[first])]
        return np.bincount((own & np.uint64(65535)).astype(np.int64), np.repeat(value, np.diff(np.append(first, len(gram)))), len(sizes))

    def base(self, stream: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text: words, words that are known, the sum of their logs."""
        words = stream.tobytes().split()
        value = np.fromiter(map(self.words.__getitem__, words), float, len(words))
        # Behind each word stands a space or an end, and behind no word an end alone.
        after = (stream == 32) | (stream == END)
        after[ends[:-1]] = False
        n = np.add.reduceat(after, ends[:-1], dtype=np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        return n, np.bincount(doc, value != self.unknown, len(n)).astype(np.int64), np.bincount(doc, value, len(n))


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def scored(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    Documents that are not held out are learned from, and all are scored. score is the log10
    probability of the words (A-Z lower-cased) with one space between, and of the end behind them; that is
    what the base scores as tokens. A context that was never learned leaves the mixture of the shorter ones as it is.
    A null text is an empty one, of which only the end is
    scored. Repeated rows count and are scored each; other columns go; an empty table gives an empty one.
    """
    if not 1 <= depth <= DEPTH:
        raise ValueError(f"contexts have 1 to {DEPTH} bytes, not {depth}")
    spark, cut = docs.sparkSession, min(CUT, depth)
    docs = text_of(docs, "doc_id")
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if not rows:
        return spark.createDataFrame([], RESULT)
    buckets = min(size // BUCKET + 1, MOST_BUCKETS)
    with Work(spark) as work:
        found = work.written(_blocks(docs, depth, buckets, cut), "blocks")
        texts, asked = found.filter(F.col("kind") == TEXT), found.filter(F.col("kind").isin(ASKED_GRAMS, ASKED_WORDS))
        histogram = np.zeros(256, np.int64)
        for symbol, n in found.filter(F.col("kind") == BYTES).groupBy("bucket").agg(F.sum("n")).collect():  # 256 rows at most
            histogram[symbol] = n
        code = huffman(histogram)
        counted = work.written(_counts(asked, code, depth, cut), "counts")
        total, distinct = counted.filter(F.col("kind") == WORD_COUNTS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        ends = texts.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
        total, distinct = total + ends, distinct + (ends > 0)
        below = total + 0.1 * (distinct + 1)
        answers = _answers(asked, counted, code, _short(counted, cut), depth, cut)

        @task("ctw")
        def score(batches):
            end, block, own = math.log10((ends + 0.1) / below), None, Answers(below)
            for r in (x for b in batches for x in b.to_pylist()):
                if r["block"] != block:
                    block, own = r["block"], Answers(below)
                if r["kind"] != TEXT:
                    own.add(r["kind"], r["data"], r["numbers"])
                    continue
                stream, (sizes, ids, marks) = np.frombuffer(large(r["data"]), np.uint8), unpacked(r["numbers"]).reshape(3, -1)
                at = np.append(0, np.cumsum(sizes))
                for k in range(0, len(sizes), 1 << 15):
                    part, on = at[k : k + (1 << 15) + 1], slice(k, k + (1 << 15))
                    data = stream[part[0] : part[-1]]
                    n, known, base = own.base(data, part - part[0])
                    sums = own.scores(data, part - part[0], depth)
                    columns = [pa.array(ids[on], pa.int64(), mask=(marks[on] & NO_ID) > 0), (marks[on] & HELD) > 0, n + 1, known + int(ends > 0), np.full(len(n), total), base + end, sums, -sums * math.log2(10) / sizes[on]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORED, strict=True)], schema=_SCORED)

        columns = ["kind", "block", "data", "numbers"]
        both = answers.select(*columns).unionByName(texts.select(*columns))
        # Answers come before texts.
        return work.result(both.repartition("block").sortWithinPartitions("block", F.col("kind") == TEXT).mapInArrow(score, RESULT), "scored")
