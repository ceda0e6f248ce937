"""Sources, sinks and streams on small folders."""

import time

import pytest
from pyspark.sql import functions as F

from quern.sources import tables as S
from quern.streaming import ingest_stream, sessions, tumbling


def test_upsert_and_merge(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, t int")
    assert sorted(map(tuple, S.upsert(old, new, "k", "t").collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert sorted(map(tuple, S.update_columns(old, new.filter("t = 3"), "k", ["v"]).collect())) == [(1, "a", 1), (2, "d", 1)]
    assert sorted(map(tuple, S.merge_counts(old.withColumn("n", F.lit(1)), new.withColumn("n", F.lit(1)), "k", "n", "t").collect())) == [(1, 1, 1), (2, 3, 3), (3, 1, 1)]


def test_publish(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    for n in (1, 2):
        S.publish(spark.range(n), root)
        assert S.published(spark, root).count() == n


def test_inventory_and_export(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("one")
    rows = S.file_inventory(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and len({r.hash for r in rows}) == 1
    S.export(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/md", "markdown")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/md").collect()] == ["| 1 |  |"]


def test_pages(spark):
    df = spark.createDataFrame([(1, "a\fb"), (2, None)], "doc_id int, text string")
    assert [(r.doc_id, r.page, r.page_text) for r in S.pages_of(df).orderBy("doc_id", "page").collect()] == [(1, 1, "a"), (1, 2, "b"), (2, 1, "")]
    assert [r[0] for r in df.select(S.page_text(F.col("text"), F.lit(3))).collect()] == [None, None]


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello")
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xfe\xff")
    for n in range(2):
        q = ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination(60)
        if n == 0:
            (tmp_path / "in/c.txt").write_text("more")
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out/documents").collect()) == ["hello", "more"]
    assert [r.reason for r in spark.read.parquet(f"{tmp_path}/out/quarantine").collect()] == ["not UTF-8"]


@pytest.mark.parametrize("kind", ["tumbling", "sessions"])
def test_windows(spark, sf, tmp_path, kind):
    (tmp_path / "ev").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/ev").schema).parquet(f"{tmp_path}/ev")
    out = tumbling(stream, "1 hour", "event_type") if kind == "tumbling" else sessions(stream, "30 minutes", "user_id")
    q = out.writeStream.format("memory").queryName(f"w_{kind}_{int(time.time())}").outputMode("complete" if kind == "tumbling" else "append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = spark.table(q.name).agg(F.sum("n")).first()[0]
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    assert found == total if kind == "tumbling" else 0 < found <= total


def test_ewma_state(spark, sf):
    """The processor over micro-batches, with a stand-in for Spark's state, against the batch form."""
    import pandas as pd

    from quern.operators.evaluate import ewma_rate
    from quern.streaming.events import _Rate

    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    class Handle:
        def getValueState(self, name, schema, ttlDurationMs):  # noqa: N802, N803
            return Value()

    events = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'click'")
    times = sorted(r[0] for r in events.selectExpr("unix_micros(cast(ts as timestamp)) / 1e6").collect())
    processor = _Rate(60.0, 1000)
    processor.init(Handle())
    for k in range(0, len(times), 37):
        out = next(processor.handleInputRows(("click",), [pd.DataFrame({"t": times[k : k + 37]})], None))
    assert out["n"][0] == len(times)
    assert ewma_rate(events, "event_type", "ts").first().rate == pytest.approx(out["rate"][0], abs=1e-8)
