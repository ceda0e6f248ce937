"""A trie of conversations' common beginnings, with what each node saves and how many ends lie below it.

A node is a sequence of first turns and is known by a digest. A turn's number in its sequence and its digest give four numbers, whose sums over
the first turns (with the depth) make the node's digest; so a conversation of any length is summed up over range partitions
(``running``), and the digest of the node above comes from the same sums without the last turn. Equal digests are one node: its
members are counted before the shuffle, so that a beginning which a third of all conversations share costs no more than others.

What lies below a node comes up by pointer jumping: after k rounds each node has the sums of all nodes less than 2^k below it
and a pointer to its ancestor at that distance. A round adds each node's sums to that ancestor's, and follows pointers twice as far;
so there are as many rounds as the longest conversation's length has bits.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, task
from .running import running

#: The first turns that a conversation can have from another one: the one whose id is the multiple of ``BASE`` at or before its own.
MOST, BASE = 3, 20
#: Characters of ids that stand in one row at most on their way to a digest.
PIECE = 1 << 20
LANES = ("a", "b", "c", "d")
_WORD = r"[^\x20\x09-\x0D]+"


def _key(depth: Column, sums: list[Column]) -> Column:
    """The digest of a node from its depth and the sums of its turns."""
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def turns(conversations: DataFrame) -> DataFrame:
    """conv (of the id, never null), conv_id, turn, role, text_key, words of every row; texts go no further."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id", "turn", role.alias("role"), F.sha2(text, 256).alias("text_key"), F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("words"))


def rebuilt(rows: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv, conv_id, at, turn_key, words, last) and the conversations (conv, conv_id, n: own turns, taken).

    The first h = crc32(id) mod (MOST + 1) turns come from the conversation of ``BASE``; a null id takes none.
    """
    placed = running(rows, "conv", [F.col("turn"), F.col("role"), F.col("text_key")], work)
    turn_key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text_key"), 256)
    placed = work.written(placed.select("conv", "conv_id", "at", turn_key.alias("turn_key"), "words"), "turns")
    h = F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST + 1)), F.lit(0))
    convs = work.written(placed.groupBy("conv", "conv_id").agg(F.count("*").alias("n")).withColumn("h", h), "conversations")
    # A row for each conversation that can be a base, with its first turns.
    one = F.struct("at", "turn_key", "words")
    bases = placed.filter((F.col("at") < MOST) & (F.col("conv_id") % BASE == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(one)).alias("first"))  # MOST at most
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE).join(bases, "base", "left")
    own = own.withColumn("first", F.slice(F.coalesce("first", F.array().cast("array<struct<at: bigint, turn_key: string, words: bigint>>")), 1, F.col("h").cast("int")))
    own = work.written(own.select("conv", "conv_id", "n", "h", F.size("first").cast("bigint").alias("taken"), "first"), "heads")
    heads = own.select("conv", "conv_id", "n", "h", "taken", F.explode("first").alias("t")).select("conv", "conv_id", F.col("t.at").alias("at"), F.col("t.turn_key").alias("turn_key"), F.col("t.words").alias("words"), ((F.col("n") <= F.col("h")) & (F.col("t.at") == F.col("taken") - 1)).alias("last"))
    rest = placed.join(own.select("conv", "n", "h", "taken"), "conv").filter("at >= h")
    rest = rest.select("conv", "conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "turn_key", "words", (F.col("at") == F.col("n") - 1).alias("last"))
    return heads.unionByName(rest), own.select("conv", "conv_id", "n", "h", "taken")


def paths(rows: DataFrame, work: Work) -> DataFrame:
    """conv_id, node, parent, depth, words, last for each turn of rebuilt conversations."""
    mixed = F.sha2(F.concat_ws(":", F.col("at").cast("string"), "turn_key"), 256)
    lanes = [F.conv(F.substring("mixed", 1 + 8 * k, 8), 16, 10).cast("bigint").alias(c) for k, c in enumerate(LANES)]
    summed = running(rows.withColumn("mixed", mixed).select("conv", "conv_id", F.col("at").alias("place"), "words", "last", *lanes, *[x.alias(f"own_{c}") for x, c in zip(lanes, LANES, strict=True)]), "conv", [F.col("place")], work, LANES)
    above = [F.col(c) - F.col(f"own_{c}") for c in LANES]
    return summed.select("conv_id", _key(F.col("at") + 1, [F.col(c) for c in LANES]).alias("node"), _key(F.col("at"), above).alias("parent"), (F.col("at") + 1).alias("depth"), "words", "last")


def ends_digests(ends: DataFrame, work: Work) -> DataFrame:
    """node, ends_sha256: of the ids of the conversations (node, conv_id) that end at a node, in order, parted by commas.

    Ids of a node are joined to pieces by range partitions and the digest reads piece after piece, so no list of them is ever whole in memory.
    """
    pieces_schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])
    digests_schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    @task("trie")
    def join(batches):
        for b in batches:
            own, found = [], []
            for node, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own and (own[0] != node or own[2] >= PIECE):
                    found.append((own[0], own[1], ",".join(own[3])))
                    own = []
                own = own or [node, conv, 0, []]
                own[3].append(str(conv))
                own[2] += len(own[3][-1]) + 1
            if own:
                found.append((own[0], own[1], ",".join(own[3])))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), pieces_schema, strict=True)] if found else [pa.array([], f.type) for f in pieces_schema], schema=pieces_schema)

    @task("trie")
    def digest(batches):
        node, state = None, None
        for b in batches:
            done = []
            for own, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if own != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = own, sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), digests_schema, strict=True)], schema=digests_schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=digests_schema)

    named = ends.filter("conv_id IS NOT NULL")
    pieces = work.written(named.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, first bigint, piece string"), "pieces")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, root: bytes, depth: int, work: Work) -> DataFrame:
    """node, n_leaves, saved_tokens: the sums of leaves and saved over each node's subtree, for nodes (node, parent, depth, leaves, saved)."""
    state = nodes.select("node", "depth", "leaves", "saved", F.col("parent").alias("above"))
    far = 1  # how far ``above`` is
    while far <= depth:
        added = state.filter(F.col("depth") >= far).select(F.col("above").alias("node"), F.lit(None).cast("bigint").alias("depth"), "leaves", "saved", F.lit(None).cast("binary").alias("next"))
        rows = state.select("node", "depth", "leaves", "saved", F.lit(None).cast("binary").alias("next")).unionByName(added)
        if 2 * far < depth:
            # A hot ancestor's rows are those of a skewed join, which Spark splits.
            to = state.filter(F.col("depth") > far).select(F.col("node").alias("above"), F.col("above").alias("next"))
            jumped = state.filter(F.col("depth") > 2 * far).select("node", "above").join(to, "above")
            rows = rows.unionByName(jumped.select("node", F.lit(None).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"), "next"))
        summed = rows.groupBy("node").agg(F.max("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("next").alias("next"))
        far *= 2
        above = F.when(F.col("depth") > far, F.col("next")).when(F.col("depth") == far, F.lit(root))
        state = work.written(summed.select("node", "depth", "leaves", "saved", above.alias("above")), "sums")
    return state.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are in order of ``turn`` (null first), ties by role, then by the text's SHA-256; repeated rows are turns like others. A null role or
    text is an empty one. Rows without a conv_id are one conversation, which takes no turns from another; it counts as a member and names a node
    (as null) only where no other does, and is not named in ends_sha256. Texts of any length are digested where they are read. Columns other than
    the four go, whatever their names. An empty table gives an empty one (there is no root without conversations).
    """
    spark = conversations.sparkSession
    with Work(spark) as work:
        rows = work.written(turns(conversations), "rows")
        whole, convs = rebuilt(rows, work)
        steps = work.written(paths(whole, work), "paths")
        zero = [F.lit(0)] * len(LANES)
        root = bytes(spark.range(1).select(_key(F.lit(0), zero)).first()[0])
        top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(F.lit(root).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("words"))
        nodes = steps.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words")).unionByName(top)
        nodes = work.written(nodes, "nodes")
        depth = nodes.agg(F.max("depth")).first()[0]
        children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
        known = work.written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "known")
        leaf = (F.col("n_children") == 0).cast("bigint")
        sums = rolled_up(known.withColumn("leaves", leaf).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), root, depth or 0, work)
        turnless = convs.filter((F.col("taken") == 0) & (F.col("n") <= F.col("h"))).select(F.lit(root).alias("node"), "conv_id")
        digests = ends_digests(steps.filter("last").select("node", "conv_id").unionByName(turnless), work)
        over = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        out = known.join(sums, "node").join(digests, "node", "left").join(over, "parent", "left")
        out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
        return work.result(out, "trie")
