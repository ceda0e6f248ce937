"""Approximate vector search: inverted lists around centroids, of which a query reads a few."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import fresh_path, state_of
from .retrieval import ranked

#: Vectors that centroids are fitted on at most, a bounded sample by the hash of the id; centroids at most; vectors and queries of a packed block.
SAMPLE, CENTROIDS, BLOCK, CHUNK = 20_000, 4096, 1024, 256
#: The share of true neighbours that a search without ``probes`` is to find, and the vectors of the sample that its number of lists is measured with.
RECALL, MEASURED = 0.95, 500


def fitted(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centroids of a sample by k-means: spread seeds (each far from those before), then ``rounds`` of means; an empty list keeps its centroid."""
    rng = np.random.default_rng(7)
    chosen = [int(rng.integers(len(sample)))]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < lists:
        total = nearest.sum()
        chosen.append(int(rng.choice(len(sample), p=nearest / total)) if total > 0 else int(rng.integers(len(sample))))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centroids = sample[chosen].copy()
    for _ in range(rounds):
        own = assigned(sample, centroids, 1)[:, 0]
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def assigned(vectors: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest centroids of each vector, nearest first."""
    far = (centroids**2).sum(1)[None] - 2 * vectors @ centroids.T
    if probes < len(centroids):
        some = np.argpartition(far, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(far, axis=1, kind="stable")


def needed_probes(sample: np.ndarray, centroids: np.ndarray, k: int = 10, recall: float = RECALL) -> int:
    """The lists that a query has to read so that ``recall`` of its ``k`` nearest are in them, measured on a part of the sample against all of it."""
    asked = sample[:MEASURED]
    near = assigned(asked, sample, min(k, len(sample)))
    own = assigned(sample, centroids, 1)[:, 0]
    order = assigned(asked, centroids, len(centroids))
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(len(centroids))[None].repeat(len(asked), 0), 1)
    return int(np.quantile(np.take_along_axis(turn, own[near], 1), recall, method="higher")) + 1


def _matrix(column, unit: bool) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in column])
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if unit else v


class VectorIndex:
    """Lists of vectors below ``path``: every vector (doc_id, vector) lies in the list of its nearest centroid.

    ``metric``: "cosine" (vectors are brought to length 1) or "l2". Centroids are fitted on ``SAMPLE`` vectors at most and stay; ``add`` lists
    further vectors around them. Vectors are packed to blocks of ``BLOCK`` within a list, so a list of any size is many rows, and lists
    are folders, of which a search reads those that a query asks for. Rows without a vector are left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        row = spark.read.parquet(f"{path}/centroids").first()
        self.metric, self.probes, self.centroids = row["metric"], row["probes"], np.frombuffer(bytes(row["centroids"]), np.float64).reshape(row["lists"], -1)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, metric: str = "cosine", lists: int | None = None) -> VectorIndex:
        spark = vectors.sparkSession
        own = vectors.filter("vector IS NOT NULL")
        n = own.count()
        sample = own.select("vector").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()  # SAMPLE rows at most
        lists = min(lists or math.ceil(math.sqrt(n)), CENTROIDS, max(1, len(sample)))
        points = _matrix([r["vector"] for r in sample], metric == "cosine") if sample else np.zeros((1, 1))
        centroids = fitted(points, lists)
        row = (metric, len(centroids), needed_probes(points, centroids), bytearray(centroids.tobytes()))
        spark.createDataFrame([row], "metric string, lists int, probes int, centroids binary").coalesce(1).write.parquet(f"{path}/centroids")
        out = cls(spark, path)
        out.add(own)
        return out

    def _nearest(self, df: DataFrame, probes: int) -> DataFrame:
        """id, vector and list, a row for each of the ``probes`` nearest centroids."""
        shared, unit, most = self.spark.sparkContext.broadcast(self.centroids), self.metric == "cosine", min(probes, len(self.centroids))  # CENTROIDS at most

        def find(batches):
            for b in batches:
                if len(b):
                    lists = assigned(_matrix(b["vector"], unit), shared.value, most)
                    yield b.loc[b.index.repeat(most)].assign(list=lists.ravel().astype(np.int32))

        return df.select("id", "vector").mapInPandas(find, "id bigint, vector array<float>, list int")

    def add(self, vectors: DataFrame) -> None:
        """Lists more vectors; what is there stays as it is."""
        listed = self._nearest(vectors.filter("vector IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("vector").cast("array<float>").alias("vector")), 1)
        listed.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list").mapInPandas(_packed("list", BLOCK), _PACKED).write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """query_id, doc_id, score, rank of the best ``k`` of the lists nearest to each query (query_id, query): ``probes`` of them, else as many as the sample needed for ``RECALL``.

        Queries are packed by list and meet the blocks of that list alone; a pair of blocks is one product of matrices and gives the
        best ``k`` for each query. Scores are exact; a vector in a list that is not read is not found.
        """
        probes = probes or self.probes
        unit = self.metric == "cosine"
        asked = self._nearest(queries.filter("query IS NOT NULL").select(F.col("query_id").alias("id"), F.col("query").cast("array<float>").alias("vector")), probes)
        chunks = asked.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("list").mapInPandas(_packed("list", CHUNK), _PACKED)
        blocks = self.spark.read.schema(_PACKED).parquet(f"{self.path}/lists")
        met = blocks.select("list", F.col("ids").alias("doc_ids"), F.col("vectors").alias("docs"), F.col("size").alias("n")).join(chunks, "list").select("doc_ids", "docs", "n", "ids", "vectors", "size")

        def score(batches):
            import pandas as pd

            for b in batches:
                for row in b.itertuples(index=False):
                    d, q = np.frombuffer(row.docs, np.float32).reshape(row.n, -1).astype(np.float64), np.frombuffer(row.vectors, np.float32).reshape(row.size, -1).astype(np.float64)
                    if unit:
                        s = (q @ d.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None], 1e-12)
                    else:
                        s = -((q[:, None] - d[None]) ** 2).sum(2)
                    ids = np.asarray(row.doc_ids)
                    order = np.argsort(ids, kind="stable")
                    s, ids = np.round(s[:, order], 6), ids[order]
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({"query_id": np.repeat(row.ids, best.shape[1]), "doc_id": ids[best.ravel()], "score": np.take_along_axis(s, best, 1).ravel()})

        out = ranked(met.mapInPandas(score, "query_id bigint, doc_id bigint, score double"), "score", k)
        return out if unit else out.withColumn("score", F.abs(-F.col("score")))


_PACKED = "ids array<bigint>, vectors binary, size int, list int"


def _packed(by: str, most: int):
    """Rows in order of ``by`` to blocks of ``most`` at most with one value of it."""

    def pack(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for own, part in b.groupby(by, sort=True):
                for i in range(0, len(part), most):
                    some = part.iloc[i : i + most]
                    rows.append((some["id"].to_numpy(), np.stack(list(some["vector"])).astype(np.float32).tobytes(), len(some), own))
            if rows:
                yield pd.DataFrame(rows, columns=["ids", "vectors", "size", by]).astype({"size": "int32", by: "int32"})

    return pack


_built: dict[tuple, tuple] = {}


def kept_index(vectors: DataFrame, source: str, metric: str = "cosine") -> VectorIndex:
    """The index of ``vectors``, which are read from ``source``: built at first, and anew if files there have changed."""
    spark = vectors.sparkSession
    key, state = (spark.sparkContext.applicationId, source, metric), state_of(spark, source)
    path, before = _built.get(key, (None, None))
    if before != state:
        path = fresh_path(spark, "vectors")
        VectorIndex.build(vectors, path, metric)
        _built[key] = path, state
    return VectorIndex(spark, path)
