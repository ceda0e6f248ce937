"""Streams that follow a table of rules: each micro-batch takes the version that is published when it begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of a version at most: they become one expression.
MOST_RULES = 2000


def labels(text: Column, rules: list[tuple[str, str, float]]) -> Column:
    """array of (label, score): the weights of a label's patterns (label, pattern, weight) that a text holds, best first, equal ones by name."""
    by: dict[str, list[tuple[str, float]]] = {}
    for label, pattern, weight in rules:
        by.setdefault(label, []).append((pattern, float(weight)))
    scores = [F.struct((-sum((F.when(text.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in own), F.lit(0.0))).alias("minus"), F.lit(label).alias("label")) for label, own in sorted(by.items())]
    met = F.filter(F.array(*scores), lambda x: x["minus"] < 0) if scores else F.array().cast("array<struct<minus: double, label: string>>")
    return F.transform(F.array_sort(met), lambda x: F.struct(x["label"].alias("label"), (-x["minus"]).alias("score")))


def read_rules(spark: SparkSession, root: str, version: str | None = None) -> tuple[str, list[tuple[str, str, float]]]:
    """The version that is published below ``root`` (or the one told) and its rules (label, pattern, weight), ``MOST_RULES`` at most."""
    version = version or spark.read.text(f"{root}/CURRENT").first()[0]
    rows = spark.read.parquet(f"{root}/versions/{version}").select("label", "pattern", F.col("weight").cast("double")).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules in version {version}")
    return version, [tuple(r) for r in sorted(rows)]


def label_rows(df: DataFrame, root: str, version: str | None = None, text: str = "text") -> DataFrame:
    """Rows with ``labels`` by the published rules and ``rules_version``."""
    version, rules = read_rules(df.sparkSession, root, version)
    return df.withColumn("labels", labels(F.coalesce(F.col(text), F.lit("")), rules)).withColumn("rules_version", F.lit(version))


def labelled_stream(stream: DataFrame, root: str, out: str, checkpoint: str, text: str = "text", **trigger):
    """Starts a query that labels a stream's rows: rules that are published while it runs hold from the next batch on.

    Which version a batch takes is written down before its rows, so a batch that is run again after a failure has the same rules and overwrites its own part.
    """

    def land(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        at = f"{out}/_versions/batch={n}"
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
            spark.createDataFrame([(read_rules(spark, root)[0],)], "version string").coalesce(1).write.mode("overwrite").parquet(at)
        label_rows(batch, root, spark.read.parquet(at).first()[0], text).write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
