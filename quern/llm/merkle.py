"""A Merkle manifest of a dataset: a tree of digests for each language, and one over these.

A document's leaf is the SHA-256 of its fields. Per language the leaves stand in order of doc_id; every ``FANOUT``
neighbours have one parent, level by level, until one node is left, the language's subroot. Subroots, in order of languages,
give the root in the same way.

Leaves get their places by range partitions (``running``), so a language of any size is spread over tasks. Aligned blocks of
``FANOUT ** LEVELS`` nodes are matrices of 64 bytes (hex digits) a node. A block's levels come from it by reshaping rows of
siblings, and blocks' tops are the nodes of the next round, of which there are that many times fewer. On the way back each block
learns the siblings above it, and finds those inside by index arithmetic.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, few, rows_of, task
from .running import running

FANOUT, LEVELS = 8, 4
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
_PATH = "array<struct<before: string, after: string>>"


def digest(fields: list[Column]) -> Column:
    """SHA-256 (hex) of fields, each as ``-`` if null, else its bytes in UTF-8, ``:`` and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (of the language, in order of languages, null first), leaf, changed (the leaf after tampering, else null)."""
    whole = [F.col(c) for c in FIELDS]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    lowered = digest([*whole[:-1], F.translate("text", _UPPER, _LOWER)])
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), digest(whole).alias("leaf"), F.when(tampered, lowered).alias("changed"))


def parents(nodes: np.ndarray) -> np.ndarray:
    """The digests (n, 64) of the next level: of each row of ``FANOUT`` siblings, the last row being as long as it is."""
    full = len(nodes) // FANOUT
    rows = [*nodes[: full * FANOUT].reshape(full, FANOUT * 64), *([nodes[full * FANOUT :].reshape(-1)] if len(nodes) % FANOUT else [])]
    return np.frombuffer("".join([sha256(r).hexdigest() for r in rows]).encode(), np.uint8).reshape(-1, 64)


def levels_of(nodes: np.ndarray, levels: int) -> list[np.ndarray]:
    """The levels of a block from its nodes up to its top."""
    out = [nodes]
    for _ in range(levels):
        out.append(parents(out[-1]))
    return out


def siblings(matrices: list[np.ndarray], i: int):
    """What stands before and after node ``i`` in its run, level by level below the top."""
    for m in matrices[:-1]:
        first = i - i % FANOUT
        yield m[first:i].tobytes(), m[i + 1 : first + FANOUT].tobytes()
        i //= FANOUT


def _hex(column: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def _blocks(nodes: DataFrame, *keep: str) -> DataFrame:
    """A row for each aligned block of nodes (tree, at, levels, leaf and what is kept): its digests, its kept columns as lists, and its top."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = f"tree string, block bigint, levels int, digests binary, {''.join(f'{c} array<{kinds[c]}>, ' for c in keep)}top string"

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        matrix, levels = _hex(table["leaf"]), min(LEVELS, table["levels"][0].as_py())
        one = {"tree": [table["tree"][0].as_py()], "block": [table["at"][0].as_py() // BLOCK], "levels": pa.array([table["levels"][0].as_py()], pa.int32()), "digests": [matrix.tobytes()]}
        lists = {c: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[c].combine_chunks()) for c in keep}
        return pa.table(one | lists | {"top": [levels_of(matrix, levels)[-1].tobytes().decode()]})

    return nodes.withColumn("block", F.expr(f"at div {BLOCK}")).groupBy("tree", "block").applyInArrow(pack, schema)


def grown(nodes: DataFrame, work: Work, *keep: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round and the tops (tree, top) of all trees, from nodes (tree, at, levels: of the whole tree, leaf)."""
    rounds, tops = [], None
    while True:
        blocks = work.written(_blocks(nodes, *keep), "blocks")
        rounds.append(blocks)
        done = blocks.filter(F.col("levels") <= LEVELS).select("tree", "top")
        tops = done if tops is None else tops.unionByName(done)
        left = blocks.filter(F.col("levels") > LEVELS)
        if left.isEmpty():
            return rounds, tops
        nodes, keep = left.select("tree", F.col("block").alias("at"), (F.col("levels") - LEVELS).alias("levels"), F.col("top").alias("leaf")), ()


def _paths(blocks: DataFrame) -> DataFrame:
    """tree, at, above: the siblings of each node of blocks (with their own ``above``), level by level."""
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("above", pa.list_(_STEP))])

    @task("merkle")
    def walk(batches):
        for b in batches:
            for row in b.to_pylist():
                matrices = levels_of(np.frombuffer(row["digests"], np.uint8).reshape(-1, 64), min(LEVELS, row["levels"]))
                first, n = row["block"] * BLOCK, len(matrices[0])
                steps = [[{"before": x.decode(), "after": y.decode()} for x, y in siblings(matrices, i)] + row["above"] for i in range(n)]
                yield pa.RecordBatch.from_pydict({"tree": [row["tree"]] * n, "at": np.arange(first, first + n), "above": steps}, schema=schema)

    return blocks.select("tree", "block", "levels", "digests", "above").mapInArrow(walk, f"tree string, at bigint, above {_PATH}")


#: Paths (up to some kilobytes each) that are broadcast at most.
FEW_PATHS = 10_000


def with_above(rounds: list[DataFrame], above: DataFrame, work: Work) -> DataFrame:
    """The blocks of the first round with ``above``: the siblings on their way to the root. ``above``: tree, above of each tree's top."""
    tops = above.select("tree", F.lit(0).cast("bigint").alias("block"), "above")
    found = tops.join(few(rounds[-1].select("tree").distinct(), FEW_PATHS), "tree", "left_semi") if len(rounds) > 1 else tops
    for k in range(len(rounds) - 1, -1, -1):
        joined = rounds[k].join(few(work.written(found, "above"), FEW_PATHS), ["tree", "block"])
        if k == 0:
            return joined
        # Trees that end in the round before have their top there.
        ended = tops.join(few(rounds[k - 1].filter(F.col("levels") <= LEVELS).select("tree"), FEW_PATHS), "tree", "left_semi")
        found = _paths(joined).withColumnRenamed("at", "block").unionByName(ended)


def _proved(blocks: DataFrame, root: str) -> DataFrame:
    """A row for each leaf of blocks with doc_ids, changed leaves, ``above`` and subroot."""
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names), ("verified", pa.bool_())])

    @task("merkle")
    def prove(batches):
        for b in batches:
            for row in b.to_pylist():
                matrices = levels_of(np.frombuffer(row["digests"], np.uint8).reshape(-1, 64), min(LEVELS, row["levels"]))
                above = [(s["before"].encode(), s["after"].encode()) for s in row["above"]]
                own, proofs, folds = [m.tobytes().decode() for m in matrices[0]], [], []
                for i, (leaf, changed) in enumerate(zip(own, row["changed"], strict=True)):
                    proof, node = sha256(), (leaf if changed is None else changed).encode()
                    for before, after in [*siblings(matrices, i), *above]:
                        proof.update(before + after)
                        node = sha256(before + node + after).hexdigest().encode()
                    proofs.append(proof.hexdigest())
                    folds.append(node.decode())
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(own), pa.array([row["subroot"]] * n), pa.array([root] * n), pa.array(proofs), pa.array(folds), pa.array([x == root for x in folds])], schema=schema)

    columns = blocks.select("doc_id", "changed", "levels", "digests", "above", "subroot")
    return columns.mapInArrow(prove, f"doc_id bigint, {', '.join(f'{c} string' for c in names)}, verified boolean")


def _levels(n: str) -> Column:
    """Levels above ``n`` leaves: the digits of n - 1 to the base ``FANOUT``."""
    return F.when(F.col(n) > 1, F.length(F.conv((F.col(n) - 1).cast("string"), 10, FANOUT))).otherwise(0)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Leaves, subroots, roots and proofs are of the documents as they are. Where 3 divides the crc32 of the doc_id, the text is
    tampered with (A-Z lower-cased) before its leaf is folded with the siblings of the others to folded_root.
    Any field may be null; documents without a language have a tree of their own, the first. Rows without a doc_id come first
    and are not tampered with; rows of one doc_id stand in order of their leaves, repeated rows have a leaf each. Empty and very
    long texts are texts like others, hashed where they are read and not shuffled. Columns other than the five go, whatever their names.
    An empty table gives an empty one.
    """
    with Work(docs.sparkSession) as work:
        found = work.written(leaves(docs), "leaves")
        if not rows_of(found):
            return docs.sparkSession.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        sizes = work.written(found.groupBy("tree").agg(F.count("*").alias("n")), "trees").select("tree", _levels("n").alias("levels"))
        laid = running(found, "tree", [F.col("doc_id"), F.col("leaf")], work).join(few(sizes), "tree")
        rounds, tops = grown(laid, work, "doc_id", "changed")
        tops = work.written(tops, "subroots")
        trees = rows_of(tops)
        over = running(tops.withColumn("all", F.lit("")), "all", [F.col("tree")], work)
        over = work.written(over, "languages")
        nodes = over.withColumn("n", F.lit(trees)).select(F.col("all").alias("tree"), "at", _levels("n").alias("levels"), F.col("top").alias("leaf"))
        upper, roots = grown(nodes, work)
        root = roots.first()["top"]
        start = roots.select("tree", F.array().cast(_PATH).alias("above"))
        paths = _paths(with_above(upper, start, work)).select("at", "above")
        above = work.written(over.join(few(paths, FEW_PATHS, trees), "at").select("tree", "above"), "above")
        whole = with_above(rounds, above, work).join(few(tops.withColumnRenamed("top", "subroot")), "tree")
        return work.result(_proved(whole, root), "manifest")
