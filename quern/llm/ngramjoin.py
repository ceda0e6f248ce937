"""Jaccard self-join of documents on sets of word n-grams, by groups of identical prefixes.

A document's set holds its distinct shingles of three words (A-Z lower-cased, parted by white space). Documents of one set are one
node. First, nodes go that can have no partner: the elements that no other node has bound the sizes that a partner can have. They are
counted among the elements in a fixed quarter of all hashes, then, for what is left, among all.

Elements of those that are left stand in order of their frequency, rare ones first. Two sets of similarity ``LEAST`` per cent or more have an
element in common within the prefixes of both (the first tenth or so of each). Nodes of one prefix and one size are a group; elements that
no other node has are left out of prefixes, for they lead nowhere. A group is one member in the list of each of its prefix's elements, with the place of
the element. Pairs of groups are filtered by sizes, by the bounds and by places. Pairs that pass are expanded into members, which are
compared exactly, if they are in different classes yet.

Lists are not expanded into all pairs. A few of a list's members, the pivots, meet the others, and leave the list when they have; lists
go on, with more pivots, while they hold different classes. Members of one group meet in the same way before groups do. Of two groups
one member for each class is compared first, and whole groups only where classes are still different. So no link between classes is lost, and a group of n near
copies takes some n comparisons. Lists of sets that pass all filters and yet are alike in none take a comparison for each pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FEW, Work, blocks, few, fewer, mix, rows_of, task, text_of, utf8
from .neardup import _LOWER, _P, _relabelled, _salted, _words, components

SHINGLE, LEAST = 3, 90
BLOCK = 1 << 20
#: Hashes below this are looked at for elements that only one node has.
LOW = 1 << 62
#: Pivots of a list in the first round, how many times more in each later one, the most in a round; members of a list that are joined in one task on average.
PIVOTS, MORE, MOST_PIVOTS, MEMBERS = 8, 8, 512, 10_000
#: Elements of pivots (8 bytes each) that are broadcast at most.
ELEMENTS = 1 << 21


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Elements of a set of ``n`` of which a partner has one among its own first ones: n - ceil(0.9 n) + 1."""
    return np.where(n > 0, n - (n * LEAST + 99) // 100 + 1, 0)


def sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of texts, and offsets; a text of fewer than three words, but not none, has one of all its words."""
    raw = data[at[0] : at[-1]].tobytes().translate(_LOWER)
    get, parts, counts = _words.__getitem__, [], []
    for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True):
        own = raw[a:b].split()  # of bytes: at just the six white-space bytes
        counts.append(len(own))
        own += [b""] * (SHINGLE - 1)
        parts.append(np.fromiter(map(get, own), np.uint64, len(own)))
    words, n = np.concatenate(parts), np.array(counts, np.int64)
    sizes = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), sizes)
    start = (np.cumsum(n + SHINGLE - 1) - n - SHINGLE + 1)[doc] + np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc]
    h = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = mix(h ^ words[start + k] * _P[k])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.append(0, np.cumsum(np.bincount(doc, minlength=len(n))))


def _key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the set; null without words), n (its size), low (its elements below ``LOW``, and its prefix at least) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("low", pa.list_(pa.int64()))])

    @task("words")
    def sign(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in blocks(np.diff(at), BLOCK):
                h, offsets = sets(data, at[i : j + 1])
                n = np.diff(offsets)
                below = np.append(0, np.cumsum(h < np.uint64(LOW)))
                sizes = np.maximum(below[offsets[1:]] - below[offsets[:-1]], prefix_size(n))
                doc = np.repeat(np.arange(len(n)), sizes)
                own = h[offsets[doc] + np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc]]
                keys = [_key(h[x:y]) if y > x else None for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                low = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(own.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(keys, pa.binary()), pa.array(n), low], schema=schema)

    return text_of(docs, "doc_id").mapInArrow(sign, "doc_id bigint, key binary, n bigint, low array<bigint>")


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, elements of the wanted sets (node, key, doc); each is read from the rows of one doc_id."""
    schema = pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("elements", pa.list_(pa.int64()))])

    @task("words")
    def read(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in blocks(np.diff(at), BLOCK):
                h, offsets = sets(data, at[i : j + 1])
                keys = [_key(h[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0)[i:j], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))], schema=schema)

    rows = text_of(docs, "doc_id")
    rows = rows.join(few(wanted.select(F.col("doc").alias("_doc")).distinct()), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    own = rows.mapInArrow(read, "key binary, doc bigint, elements array<bigint>").alias("r")
    named = few(wanted).alias("w")
    return own.join(named, (F.col("r.key") == F.col("w.key")) & F.col("r.doc").eqNullSafe(F.col("w.doc"))).select("node", "elements").dropDuplicates(["node"])


def _least(n: Column, m: Column) -> Column:
    """Common elements that sets of ``n`` and ``m`` elements need: 90 / 190 of their sum, rounded up."""
    return F.ceil((n + m) * LEAST / F.lit(100 + LEAST) - F.lit(1e-9))


def _with_partners(nodes: DataFrame, elements: DataFrame, work: Work) -> DataFrame:
    """node, n, most: nodes that another one can be similar to by size, from those (node, n) and some or all of their elements (node, element).

    With u elements that no other node has, a set of n shares n - u at most, so what is similar to it has at
    most ``most`` = (n - u) 190 / 90 - n elements. Nodes that leave take their elements with them, so it is done twice.
    """
    for k in range(2):
        there = elements if k == 0 else elements.join(few(nodes.select("node"), rows=rows_of(nodes)), "node", "left_semi")
        single = there.groupBy("element").agg(F.count("*").alias("times"), F.min("node").alias("node")).filter("times = 1")
        own = work.written(single.groupBy("node").agg(F.count("*").alias("u")), "single")  # few rows, but from many elements
        most = F.floor((F.col("n") - F.coalesce("u", F.lit(0))) * F.lit(100 + LEAST) / F.lit(LEAST) - F.col("n") + F.lit(1e-6))
        left = nodes.select("node", "n").join(few(own), "node", "left").select("node", "n", most.alias("most"))
        nodes = work.written(left.filter(F.col("most") * 100 >= F.col("n") * LEAST), "nodes", rows_of(nodes))
    return nodes


def _prefixes(nodes: DataFrame, bodies: DataFrame, work: Work) -> DataFrame:
    """node, first (the place of the first element that another node has), prefix (the elements from there on), by rising frequency among ``nodes``."""
    elements = bodies.join(few(nodes.select("node"), rows=rows_of(nodes)), "node", "left_semi").select("node", F.explode("elements").alias("element"))
    counts = elements.groupBy("element").agg(F.count("*").alias("times")).filter("times > 1")
    shared = elements.join(counts, "element").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("times", "element"))).alias("shared"))  # a set's own elements
    size = F.col("n") - F.floor((F.col("n") * LEAST + 99) / 100) + 1
    first = F.col("n") - F.size("shared")
    own = shared.join(few(nodes.select("node", "n"), rows=rows_of(nodes)), "node").select("node", first.alias("first"), F.transform(F.slice("shared", 1, F.greatest(size - first, F.lit(0)).cast("int")), lambda x: x["element"]).alias("prefix"))
    return work.written(own.filter(F.size("prefix") > 0), "prefixes")  # few rows, but from all their elements


def _verified(pairs: DataFrame, bodies: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of nodes those that are similar; the elements of all a are broadcast if they are few."""
    ends = pairs.select(F.col("a").alias("node")).distinct().join(few(sizes, rows=rows_of(bodies)), "node").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    side = bodies.join(few(pairs.select(F.col("a").alias("node")).distinct(), rows=ends[1]), "node", "left_semi").select(F.col("node").alias("a"), F.col("elements").alias("_elements"))
    if ends[0] <= ELEMENTS and ends[1] <= FEW:
        side = F.broadcast(side)
    both = bodies.withColumnRenamed("node", "b").join(few(pairs), "b").join(side, "a")
    common = F.size(F.array_intersect("elements", "_elements"))
    return both.filter(common * 100 >= (F.size("elements") + F.size("_elements") - common) * LEAST).select("a", "b")


class Classes:
    """Classes of nodes as links are found: members (item, node), labels (node, label; a node without one is its own)."""

    def __init__(self, members: DataFrame, bodies: DataFrame, sizes: DataFrame, work: Work):
        self.members, self.bodies, self.sizes, self.work, self.labels = members, bodies, sizes, work, None

    def labelled(self) -> DataFrame:
        """item, node, label of every member."""
        if self.labels is None:
            return self.members.withColumn("label", F.col("node"))
        return self.members.join(few(self.labels, rows=rows_of(self.labels)), "node", "left").select("item", "node", F.coalesce("label", "node").alias("label"))

    def ranges(self) -> DataFrame:
        """item, lo, hi: the least and the greatest class of its members."""
        return self.labelled().groupBy("item").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))

    def link(self, pairs: DataFrame) -> None:
        """Compares pairs (a, b) of nodes and unites the classes of those that are similar."""
        asked = self.work.written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "pairs")
        if not rows_of(asked):
            return
        links = _verified(asked, self.bodies, self.sizes)
        if self.labels is not None:
            for end in ("a", "b"):
                links = links.join(few(self.labels.select(F.col("node").alias(end), F.col("label").alias("_to")), rows=rows_of(self.labels)), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        found = components(links, self.work, rows_of(asked))
        if found is not None:
            self.labels = found if self.labels is None else _relabelled(self.labels, found, self.work)


def _rounds(lists: DataFrame, classes: Classes, fits: Callable[[Column, Column], Column], meet: Callable[[DataFrame], None], work: Work) -> None:
    """Pivots of each list (list, item, n, most, place) meet its other members until what is left of it is of one class.

    ``fits`` says of two members (structs) whether items can be similar; ``meet`` gets the distinct pairs (p, q) of items that can.
    """
    sized = lists.groupBy("list").agg((F.floor((F.count("*") - 1) / MEMBERS) + 1).cast("int").alias("salts"), F.count("*").alias("c")).filter("c > 1").drop("c")
    sized = work.written(sized, "lists")
    if not rows_of(sized):
        return
    salted = lists.join(few(sized), "list")
    state, most_pivots = work.written(salted.withColumn("salt", F.pmod(F.xxhash64("item"), F.col("salts")).cast("int")), "members"), PIVOTS
    while members := rows_of(state):
        ranged = state.join(classes.ranges(), "item")
        still = ranged.groupBy("list").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).filter("a < b").select("list")
        open_ = work.written(ranged.join(few(work.written(still, "still", members)), "list", "left_semi"), "open", members)
        if not (members := rows_of(open_)):
            return
        order = Window.partitionBy("list").orderBy((F.col("most") - F.col("n")).desc(), "item")
        chosen = open_.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most_pivots)
        one = F.struct("item", "n", "most", "place", "lo", "hi")
        pivots = work.written(chosen.groupBy("list").agg(F.first("salts").alias("salts"), F.collect_list(one).alias("pivots")), "pivots", members)  # most_pivots at most
        bound = rows_of(pivots) + members // MEMBERS
        met = open_.drop("salts").join(few(_salted(pivots), FEW // most_pivots, bound), ["list", "salt"])
        own = F.struct("item", "n", "most", "place", "lo", "hi")
        alike = lambda p: (p["lo"] == F.col("hi")) & (p["hi"] == F.col("lo"))  # noqa: E731  all of both in one class
        found = met.select("item", F.transform(F.filter("pivots", lambda p: (p["item"] != F.col("item")) & ~alike(p) & fits(p, own)), lambda p: p["item"]).alias("p")).filter(F.size("p") > 0)
        # A pair meets in many lists: each item's distinct pivots come first.
        own_pivots = found.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("p"))
        pairs = fewer(own_pivots, members).select(F.col("item").alias("q"), F.explode("p").alias("p"))
        pairs = work.written(pairs.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct(), "met", members * most_pivots)
        if rows_of(pairs):
            meet(pairs)
        gone = _salted(pivots.select("list", "salts", F.col("pivots.item").alias("gone")))
        left = open_.join(few(gone, FEW // most_pivots, bound), ["list", "salt"]).filter(~F.array_contains("gone", F.col("item")))
        state = work.written(left.select("list", "item", "n", "most", "place", "salts", "salt"), "members", members)
        most_pivots = min(most_pivots * MORE, MOST_PIVOTS)


def _labels(docs: DataFrame, work: Work) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The signed rows, the distinct sets (node, key, doc: the smallest doc_id, n) and the labels (node, label) of linked ones."""
    sign = work.written(signed(docs), "signed")
    texts = sign.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("low").alias("low"))
    texts = work.written(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    low = texts.select("node", F.explode("low").alias("element"))
    # Elements between LOW and the prefix's end don't count: others may have them without showing them.
    if not rows_of(texts):
        return sign, texts, None
    nodes = _with_partners(texts.select("node", "n"), low.filter((F.col("element") >= 0) & (F.col("element") < LOW)), work)
    wanted = work.written(texts.select("node", "key", "doc").join(few(nodes), "node"), "wanted", rows_of(texts))
    if not rows_of(wanted):
        return sign, texts, None
    bodies = work.written(_bodies(docs, wanted.select("node", "key", "doc")), "bodies", wanted.agg(F.sum("n")).first()[0] // 40 + 1)
    nodes = _with_partners(wanted.select("node", "n"), bodies.select("node", F.explode("elements").alias("element")), work)
    if not rows_of(nodes):
        return sign, texts, None
    own = nodes.join(few(_prefixes(nodes, bodies, work), FEW // 10), "node")
    grouped = own.withColumn("key", F.unhex(F.md5(F.concat_ws(",", F.col("n").cast("string"), F.concat_ws(",", F.col("prefix").cast("array<string>"))))))
    grouped = work.written(grouped, "groups", rows_of(nodes))
    groups = grouped.groupBy("key").agg(F.first("n").alias("n"), F.max("most").alias("most"), F.min("first").alias("first"), F.first("prefix").alias("prefix"), F.count("*").alias("size"))
    groups = work.written(groups.withColumn("item", F.monotonically_increasing_id()), "numbered", rows_of(nodes))
    wanted = grouped.select("node", "n", "most", "key").join(few(groups.select("key", "item", "size")), "key").drop("key")
    wanted = work.written(wanted, "members", rows_of(nodes))
    lists = groups.select("item", "n", "most", "first", F.posexplode("prefix").alias("k", "list")).select("list", "item", "n", "most", (F.col("first") + F.col("k")).cast("int").alias("place"))
    sizes = wanted.select("node", "n")
    # Members of one group; the list is the group, the items are its nodes.
    inside = Classes(wanted.select(F.col("node").alias("item"), "node"), bodies, sizes, work)
    own = wanted.filter("size > 1").select(F.col("item").alias("list"), F.col("node").alias("item"), "n", "most", F.lit(0).alias("place"))
    _rounds(own, inside, lambda p, q: F.lit(True), lambda pairs: inside.link(pairs.select(F.col("p").alias("a"), F.col("q").alias("b"))), work)
    between = Classes(wanted.select("item", "node"), bodies, sizes, work)
    between.labels = inside.labels

    def fits(p: Column, q: Column) -> Column:
        """Sizes within each other's bounds, and enough elements from the common one on."""
        can = F.least(p["place"], q["place"]) + F.least(p["n"] - p["place"], q["n"] - q["place"])
        return (p["n"] * 100 >= q["n"] * LEAST) & (q["n"] * 100 >= p["n"] * LEAST) & (p["n"] <= q["most"]) & (q["n"] <= p["most"]) & (can >= _least(p["n"], q["n"]))

    def meet(pairs: DataFrame) -> None:
        """One member for each class of two groups first; then all whose classes are still different."""
        for whole in (False, True):
            if whole and rows_of(of) == rows_of(wanted):
                return  # each member was one of its own
            of = between.labelled() if whole else between.labelled().groupBy("item", "label").agg(F.min("node").alias("node"))
            of = work.written(of, "of", rows_of(wanted))
            left = of.select(F.col("item").alias("p"), F.col("node").alias("a"), F.col("label").alias("_a"))
            right = of.select(F.col("item").alias("q"), F.col("node").alias("b"), F.col("label").alias("_b"))
            if whole:
                ranges = between.ranges()
                for end in ("p", "q"):
                    pairs = pairs.join(ranges.select(F.col("item").alias(end), F.col("lo").alias(f"{end}_lo"), F.col("hi").alias(f"{end}_hi")), end)
                pairs = pairs.filter("NOT (p_lo = q_hi AND p_hi = q_lo)").select("p", "q")
            between.link(pairs.join(left, "p").join(right, "q").filter("_a <> _b").select("a", "b"))

    _rounds(lists, between, fits, meet, work)
    return sign, texts, between.labels


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    component_id is the smallest doc_id that a chain of links (Jaccard similarity of ``LEAST`` per cent or more) leads to; null ones count
    only where there is no other. A text without words (null and empty ones too) has no shingles and is linked to none. Sets are linked, not doc_ids:
    rows of one doc_id with different texts are rows of different components unless the texts are alike. Repeated rows give
    repeated rows; texts of any length are read whole, in blocks; other columns go, whatever their names; an empty table gives an empty one.
    """
    with Work(docs.sparkSession) as work:
        sign, texts, labels = _labels(docs, work)
        named = texts.select("node", "key", "doc")
        if labels is not None:
            named = named.join(few(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
            heads = named.join(few(work.written(labels.select("label").distinct(), "roots", rows_of(labels))), "label", "left_semi").groupBy("label").agg(F.min("doc").alias("head"))
            named = named.join(few(work.written(heads, "heads", rows_of(labels))), "label", "left").select("key", F.coalesce("head", "doc").alias("first"))
        else:
            named = named.select("key", F.col("doc").alias("first"))
        rows = sign.select("doc_id", "key", "n").join(named, "key", "left")
        return work.result(rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id")), "linked", rows_of(sign))
