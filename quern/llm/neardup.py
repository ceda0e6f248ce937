"""MinHash near-dedup with DartMinHash signatures and banded joining.

The elements of a text are its shingles of five words (A-Z lower-cased, parted by white space), with
their numbers of occurrences as weights. Every unit of weight of an element throws darts: a Poisson
process along the axis of ranks, seeded by the element, whose darts fall on random coordinates. Only
ranks below a threshold that is in proportion to 1 / total weight are looked at, so the work for a signature
hardly depends on the text's length. The earliest dart on each coordinate is the signature; two
texts agree on a coordinate with the probability of their weighted Jaccard similarity.

Texts, not documents, are what is linked: a text is known by the 128 bits of its MD5 and gets a number,
and doc_ids (which may be null or stand at several texts) come back at the end.

Texts that agree on a whole band share a bucket. Elements that only one of the texts in question has
bound the sizes of the texts that it can be similar to; texts without a partner of such a size leave
the bucket. Those that stay are compared (exactly) with a few of them, the pivots, if they are in
another class yet and the sizes allow it; then the pivots leave. Buckets that still hold different
classes go on, with more pivots, from the smallest classes. So a bucket of n copies takes some n
comparisons, not n squared, and no link between classes is lost. A text that is in one class with the
pivots of all its buckets costs one comparison for each of these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FEW, Work, blocks, few, fewer, keeps, mix, rows_of, task, text_of, utf8

SHINGLE, LEAST = 5, 0.8
#: 25 bands of 5: of the pairs at similarity 0.8 one in 20,000 shares no band, above that fewer.
BANDS, ROWS = 25, 5
BLOCK = 1 << 20
#: Pivots of a bucket in the first round, how many times more in each later one (what is left then are the
#: outsiders of each bucket), the most there are in a round (the others come in the next), and rounds of leaving by size.
PIVOTS, MORE, MOST_PIVOTS, LEAVING = 4, 4, 64, 2
#: Elements of pivots (8 bytes each) that are broadcast at most; members of a bucket that are joined in one task on average.
ELEMENTS, MEMBERS = 1 << 21, 10_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Words(dict):
    """Words to 64-bit hashes; forgets when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = Words()
keeps("words", _words.clear)


def elements(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the unit elements (shingle and number of the occurrence) of texts, and offsets.

    A text of fewer than five words, but not none, has one shingle of all its words.
    """
    raw = data[at[0] : at[-1]].tobytes().translate(_LOWER)
    get, parts, counts = _words.__getitem__, [], []
    for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True):
        own = raw[a:b].split()
        counts.append(len(own))
        own += [b""] * (SHINGLE - 1)
        parts.append(np.fromiter(map(get, own), np.uint64, len(own)))
    words, n = np.concatenate(parts), np.array(counts, np.int64)
    sizes = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), sizes)
    offsets = np.append(0, np.cumsum(sizes))
    first = np.cumsum(n + SHINGLE - 1) - n - SHINGLE + 1
    start = first[doc] + np.arange(len(doc)) - offsets[doc]
    with np.errstate(over="ignore"):
        h = np.zeros(len(doc), np.uint64)
        for k in range(SHINGLE):
            h = mix(h ^ words[start + k] * _P[k])
        # Later occurrences of a shingle in a text become elements of their own.
        own = mix(h + doc.astype(np.uint64) * _P[0])
        ordered = np.sort(own)
        repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(repeated):
            k = np.searchsorted(repeated, own)
            again = np.flatnonzero(repeated[np.minimum(k, len(repeated) - 1)] == own)
            again = again[np.argsort(own[again], kind="stable")]
            same = np.append(False, own[again[1:]] == own[again[:-1]])
            begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(again))))
            h[again] = mix(h[again] + (np.arange(len(again)) - begin).astype(np.uint64) * _P[1])
    return h, offsets


def signatures(h: np.ndarray, offsets: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """For each text ``size`` numbers, the earliest dart on each coordinate; rows without elements are 0."""
    n = np.diff(offsets)
    rank, out = np.full(len(n) * size, np.inf), np.zeros(len(n) * size, np.uint64)
    level = np.full(len(n), size * (math.log(size) + 2))
    todo = np.flatnonzero(n > 0)
    while len(todo):
        sizes = n[todo]
        doc = np.repeat(todo, sizes)
        element = h[np.repeat(offsets[todo] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(doc))]
        limit = (level / np.maximum(n, 1))[doc]
        time = np.zeros(len(doc))
        cells, times, darts = [], [], []
        turn = 0
        with np.errstate(over="ignore"):
            while len(element):
                turn += 1
                x = mix(element + np.uint64(turn) * _P[2])
                time = time - np.log((x >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)
                on = time < limit
                doc, element, limit, time, x = doc[on], element[on], limit[on], time[on], x[on]
                x = mix(x ^ _P[3])
                cells.append(doc * size + (x % np.uint64(size)).astype(np.int64))
                times.append(time)
                darts.append(x)
        cell, at, dart = np.concatenate(cells), np.concatenate(times), np.concatenate(darts)
        np.minimum.at(rank, cell, at)
        win = at == rank[cell]
        out[cell[win]] = dart[win]
        # A coordinate without a dart: look further along the ranks.
        todo = todo[np.isinf(rank.reshape(-1, size)[todo]).any(1)]
        level[todo] *= 2
    return out.reshape(-1, size)


def bands(signature: np.ndarray) -> np.ndarray:
    """A number for each band of each text."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BANDS):
            h = np.full(len(signature), k + 1, np.uint64)
            for j in range(ROWS):
                h = mix(h ^ signature[:, k * ROWS + j] * _P[j])
            out[:, k] = h
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def text_key(text: str = "text") -> Column:
    """The 128 bits that a text is known by."""
    return F.unhex(F.md5(F.col(text)))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the exact text), n (unit elements; 0 without words) and bands of every document."""

    @task("words")
    def sign(batches):
        for b in batches:
            data, at = utf8(b.column(2))
            for i, j in blocks(np.diff(at), BLOCK):
                h, offsets = elements(data, at[i : j + 1])
                has = np.diff(offsets) > 0
                found = bands(signatures(h, offsets)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * BANDS)).astype(np.int32)), pa.array(found[has].ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(np.diff(offsets)), lists], schema=_SIGNED)

    return text_of(docs, "doc_id").select("doc_id", text_key().alias("key"), "text").mapInArrow(sign, "doc_id bigint, key binary, n bigint, bands array<bigint>")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' unit elements."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, elements of the wanted texts (node, key, doc); each text is read from the rows of one doc_id."""
    schema = pa.schema([("node", pa.int64()), ("elements", pa.list_(pa.int64()))])

    @task("words")
    def count(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in blocks(np.diff(at), BLOCK):
                h, offsets = elements(data, at[i : j + 1])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))], schema=schema)

    rows = text_of(docs, "doc_id").withColumn("_key", text_key())
    own = rows.join(few(wanted), (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("node", "text")
    return own.dropDuplicates(["node"]).mapInArrow(count, "node bigint, elements array<bigint>")


def _linked(pairs: DataFrame, bodies: DataFrame, pivots: DataFrame) -> DataFrame:
    """a, b of the pairs (pivot, node) at ``LEAST`` or more, from bodies (node, elements).

    ``pivots`` are the distinct pivots with their n. They are broadcast with their elements if these are few.
    """
    size = pivots.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sides = bodies.join(few(pivots.select("node"), rows=size[1]), "node", "left_semi").select(F.col("node").alias("pivot"), F.col("elements").alias("_elements"))
    if size[0] <= ELEMENTS and size[1] <= FEW:
        sides = F.broadcast(sides)
    both = bodies.join(few(pairs), "node").join(sides, "pivot")
    common = F.size(F.array_intersect("elements", "_elements"))
    union = F.size("elements") + F.size("_elements") - common
    return both.filter(common >= F.lit(LEAST) * union).select(F.col("pivot").alias("a"), F.col("node").alias("b"))


def _united(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for edges (a, b), in one task."""
    schema = pa.schema([("node", pa.int64()), ("label", pa.int64())])

    def unite(batches):
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                above.setdefault(a, a)
                above.setdefault(b, b)
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], schema=schema)

    return edges.coalesce(1).mapInArrow(unite, "node bigint, label bigint")


def _to_roots(parents: DataFrame, work: Work) -> DataFrame:
    """node, label: every node's pointer followed to its end, by doubling."""
    labels = work.written(parents, "labels")
    n = rows_of(labels)
    while True:
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        stepped = work.written(labels.join(above, "label").select("node", F.col("above").alias("label"), (F.col("above") != F.col("label")).alias("changed")), "labels", n)
        labels = stepped.select("node", "label")
        if stepped.filter("changed").isEmpty():
            return labels


def components(edges: DataFrame, work: Work, rows: int | None = None, bound: int | None = None) -> DataFrame | None:
    """node, label (the smallest node of its component) for edges (a, b), ``rows`` at most if told; None without edges.

    In each round every node points to the smallest one around it, pointers are followed to their ends, and
    the edges between different ends are the next round's, of which there are far fewer. ``bound`` edges or
    fewer (``FEW`` unless told; a hundred bytes each) are united in one task.
    """
    bound = FEW if bound is None else bound
    edges, labels = work.written(edges.filter("a <> b").distinct(), "edges", rows), None
    while n := rows_of(edges):
        if n <= bound:
            found = work.written(_united(edges), "labels")
            return found if labels is None else _relabelled(labels, found, work)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = _to_roots(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), work)
        labels = found if labels is None else _relabelled(labels, found, work)
        ends = edges.join(found.select(F.col("node").alias("a"), F.col("label").alias("end_a")), "a").join(found.select(F.col("node").alias("b"), F.col("label").alias("end_b")), "b")
        edges = work.written(ends.select(F.col("end_a").alias("a"), F.col("end_b").alias("b")).filter("a <> b").distinct(), "edges", n)
    return labels


def _relabelled(labels: DataFrame, found: DataFrame, work: Work) -> DataFrame:
    """Labels taken to what they are called in ``found``, whose nodes are labels or new nodes."""
    n, m = rows_of(labels), rows_of(found)
    to = few(found.select(F.col("node").alias("label"), F.col("label").alias("to")), rows=m)
    old = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return work.written(old.unionByName(found.join(few(labels.select("node"), rows=n), "node", "left_anti")), "labels", n + m)


def _with_partners(state: DataFrame, bodies: DataFrame, total: int, work: Work) -> DataFrame:
    """bucket, salt, salts, node, n, most: the members of buckets that can be similar to another one by size.

    With u elements that no other text has, a text of n elements shares n - u at most, so what is similar to
    it has at most ``most`` = (n - u) (1 + LEAST) / LEAST - n elements. ``total``: elements of all bodies.
    """
    columns = ["bucket", "salt", "salts", "node", "n"]
    for k in range(LEAVING):
        members = rows_of(state)
        there = bodies if k == 0 else bodies.join(few(work.written(state.select("node").distinct(), "nodes", members)), "node", "left_semi")
        single = there.select("node", F.explode("elements").alias("element")).groupBy("element").agg(F.count("*").alias("times"), F.min("node").alias("node"))
        single = fewer(single, total).filter("times = 1")
        own = few(work.written(single.groupBy("node").agg(F.count("*").alias("u")), "single", total // 40))  # a row or more from each task for a body
        most = (F.col("n") - F.coalesce("u", F.lit(0))) * F.lit((1 + LEAST) / LEAST) - F.col("n") + F.lit(1e-6)
        state = state.select(*columns).join(own, "node", "left").select(*columns, most.alias("most"))
        sizes = state.groupBy("bucket").agg(F.min("n").alias("lo"), F.max("most").alias("hi"), F.count("*").alias("c")).filter("c > 1")
        sizes = few(work.written(sizes, "sizes", members))
        state = work.written(state.join(sizes, "bucket").filter("most >= lo and n <= hi").select(*columns, "most"), "members")
    return state


def _salted(lists: DataFrame) -> DataFrame:
    """Each bucket's row for each of its salts."""
    return lists.select(F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "*").drop("salts")


def _all_labels(docs: DataFrame, work: Work) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The signed rows, the distinct texts (node, key, doc: the smallest doc_id) and the labels of linked ones."""
    sign = work.written(signed(docs), "signed")
    texts = sign.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = work.written(texts.withColumn("node", F.monotonically_increasing_id()), "texts", 4 * rows_of(sign))  # a row has a list of bands
    members = texts.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = members.groupBy("bucket").agg((F.floor((F.count("*") - 1) / MEMBERS) + 1).cast("int").alias("salts"), F.count("*").alias("c")).filter("c > 1").drop("c")
    shared = few(work.written(shared, "buckets", rows_of(texts) * BANDS // 2))
    salted = members.join(shared, "bucket").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    state = work.written(salted, "members")
    wanted = texts.join(few(work.written(state.select("node").distinct(), "nodes", rows_of(state))), "node", "left_semi").select("node", "key", "doc", "n")
    wanted = work.written(wanted, "wanted", rows_of(texts))
    total = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bodies = work.written(_bodies(docs, wanted), "bodies", total // 40)
    state = _with_partners(state, bodies, total, work).withColumn("label", F.col("node"))
    labels, most_pivots = None, PIVOTS
    while members := rows_of(state):
        slack = F.col("most") / F.col("n")
        if labels is None:
            sized, order = state, Window.partitionBy("bucket").orderBy(slack.desc(), "node")
        else:
            sizes = few(work.written(state.groupBy("bucket", "label").agg(F.count("*").alias("size")), "sizes", members))
            sized, order = state.join(sizes, ["bucket", "label"]), Window.partitionBy("bucket").orderBy("size", slack.desc(), "node")
        chosen = sized.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most_pivots)
        pivot = F.struct(F.col("node").alias("pivot"), F.col("label").alias("pivot_label"), F.col("n").alias("pivot_n"), F.col("most").alias("pivot_most"))
        lists = work.written(chosen.groupBy("bucket").agg(F.first("salts").alias("salts"), F.collect_list(pivot).alias("pivots")), "pivots", members)  # most_pivots at most
        bound = rows_of(lists) + members // MEMBERS  # rows of lists with their salts
        met = state.drop("salts").join(few(_salted(lists), FEW // most_pivots, bound), ["bucket", "salt"])
        fits = F.filter("pivots", lambda p: (p["pivot_label"] != F.col("label")) & (F.col("n") <= p["pivot_most"]) & (p["pivot_n"] <= F.col("most")))
        # A pair meets in many buckets: each text's distinct pivots come first.
        met = met.select("node", F.transform(fits, lambda p: p["pivot"]).alias("p")).filter(F.size("p") > 0)
        own = met.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("p"))
        joined = fewer(own, members).select("node", F.explode("p").alias("pivot"))
        asked = joined.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node")).distinct()
        asked = work.written(asked, "pairs", members * most_pivots)
        pairs = rows_of(asked)
        if pairs:
            ends = work.written(asked.select(F.col("pivot").alias("node")).distinct().join(few(texts.select("node", "n"), rows=rows_of(texts)), "node"), "ends", pairs)
            links = _linked(asked, bodies, ends)
            if labels is not None:
                for end in ("a", "b"):
                    links = links.join(few(labels.select(F.col("node").alias(end), F.col("label").alias("_to")), rows=rows_of(labels)), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
            found = components(links, work, pairs)
            if found is not None:
                labels = found if labels is None else _relabelled(labels, found, work)
        left = state.join(few(_salted(lists.select("bucket", "salts", F.col("pivots.pivot").alias("gone"))), FEW // most_pivots, bound), ["bucket", "salt"]).filter(~F.array_contains("gone", F.col("node"))).drop("gone")
        if labels is not None:
            left = left.drop("label").join(few(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
        left = work.written(left, "left", members)
        still = work.written(left.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("bucket"), "still", members)
        state = work.written(left.join(few(still), "bucket", "left_semi"), "members", members)
        most_pivots = min(most_pivots * MORE, MOST_PIVOTS)
    return sign, texts, labels


def _judged(docs: DataFrame, work: Work) -> tuple[DataFrame, int]:
    """doc_id, key, copy_of, class_id of every row, and whether it stands for its class; the number of rows."""
    sign, texts, labels = _all_labels(docs, work)
    named = texts.select("node", "key", "doc")
    if labels is not None:
        named = named.join(few(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Of each class of several texts the first one by doc_id (nulls last) and key.
    if labels is not None:
        heads = named.join(few(work.written(labels.select("label").distinct(), "roots", rows_of(labels))), "label", "left_semi").groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key")).alias("head"))
        named = named.join(few(work.written(heads, "heads", rows_of(labels))), "label", "left").select("key", "doc", F.coalesce("head.doc", "doc").alias("class_doc"), F.coalesce("head.key", "key").alias("class_key"))
    else:
        named = named.select("key", "doc", F.col("doc").alias("class_doc"), F.col("key").alias("class_key"))
    rows = sign.select("doc_id", "key", "n").join(named, "key", "left")
    words = F.col("n") > 0
    out = rows.select("doc_id", "key", F.when(words, F.col("doc")).otherwise(F.col("doc_id")).alias("copy_of"), F.when(words, F.col("class_doc")).otherwise(F.col("doc_id")).alias("class_id"),
                       (~words | ((F.col("key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_doc")))).alias("stands"))
    return out, rows_of(sign)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, copy_of, class_id of every document.

    copy_of is the smallest doc_id with the same text; class_id the smallest doc_id that a chain of
    links (similarity of ``LEAST`` or more) leads to; null ones count only where there is no other. A text without words (null and empty ones too) is
    linked to none, so both are its own doc_id. Texts are linked, not doc_ids: rows of one doc_id with different
    texts are rows of different classes unless the texts are alike. Repeated rows give repeated rows; other columns go; an
    empty table gives an empty one.
    """
    with Work(docs.sparkSession) as work:
        rows, n = _judged(docs, work)
        return work.result(rows.select("doc_id", "copy_of", "class_id"), "classes", n)


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, of the text with the smallest doc_id (then key); columns as they were.

    Rows whose text has no words (null and empty ones too) are copies of none and stay. Of repeated rows (one doc_id and
    text) one stays, whatever their other columns; rows of one doc_id with unlike texts stay each. Null doc_ids come last.
    An empty table gives an empty one.
    """
    with Work(docs.sparkSession) as work:
        rows, n = _judged(docs, work)
        found = work.written(rows, "classes", n)
        gone = work.result(found.filter("not stands").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).distinct(), "gone", n)
        repeated = not found.filter("stands").groupBy("doc_id", "key").count().filter("count > 1").isEmpty()
    key = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    kept = docs.join(few(gone), (key == F.col("_key")) & docs["doc_id"].eqNullSafe(F.col("_doc")), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
