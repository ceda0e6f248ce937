"""Streams: files that fail are tried again, also after a restart; rules change between batches."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quern.sources.tables import publish
from quern.streaming.retries import retried_stream
from quern.streaming.rules import label_rows, labelled_stream, read_rules


def rows(spark, path):
    return spark.read.parquet(path).collect() if os.path.isdir(path) else []


def until(condition, seconds=90):
    end = time.time() + seconds
    while not (found := condition()):
        assert time.time() < end, "took too long"
        time.sleep(0.5)
    return found


def fails_twice(counts):
    """A file's third attempt is the first that goes well; attempts are counted in a folder, as executors have no memory in common."""

    def process(path, content):
        text = content.decode()
        if "bad" in text:
            raise ValueError("never")
        if "twice" in text:
            at = f"{counts}/{os.path.basename(path)}"
            with open(at, "a") as f:
                f.write("x")
            if os.path.getsize(at) <= 2:
                raise OSError("not yet")
        return text

    return process


def test_failed_files_are_tried_again_after_a_restart(spark, tmp_path):
    folder, out, checkpoint, counts = (str(tmp_path / x) for x in ("in", "out", "checkpoint", "counts"))
    os.makedirs(folder)
    os.makedirs(counts)
    for name, text in (("a", "good"), ("b", "fails twice"), ("c", "bad")):
        (tmp_path / "in" / f"{name}.txt").write_text(text)
    start = lambda: retried_stream(spark, folder, out, checkpoint, every="1 second", process=fails_twice(counts), most=3, first=2.0)
    query = start()
    try:
        until(lambda: len(rows(spark, f"{out}/attempts")) >= 2)
    finally:
        query.stop()
    (tmp_path / "in" / "d.txt").write_text("late")
    query = start()
    try:
        until(lambda: len(rows(spark, f"{out}/documents")) >= 3 and len(rows(spark, f"{out}/quarantine")) >= 1)
        time.sleep(3)  # nothing more comes
    finally:
        query.stop()
    name = lambda r: os.path.basename(r["path"])
    assert sorted((name(r), r["text"], r["attempts"]) for r in rows(spark, f"{out}/documents")) == [("a.txt", "good", 1), ("b.txt", "fails twice", 3), ("d.txt", "late", 1)]
    assert [(name(r), r["attempts"], r["error"]) for r in rows(spark, f"{out}/quarantine")] == [("c.txt", 3, "ValueError: never")]
    assert sorted((name(r), r["attempts"]) for r in rows(spark, f"{out}/attempts")) == [("b.txt", 1), ("b.txt", 2), ("c.txt", 1), ("c.txt", 2)]
    assert os.path.getsize(f"{counts}/b.txt") == 3


def test_rules_that_change_between_batches(spark, tmp_path):
    root, folder, out, checkpoint = (str(tmp_path / x) for x in ("rules", "in", "out", "checkpoint"))
    os.makedirs(folder)
    rules = lambda *r: publish(spark.createDataFrame(list(r), "label string, pattern string, weight double"), root)
    first = rules(("bill", "total", 1.0), ("bill", "price", 1.0), ("note", "total", 1.5))
    (tmp_path / "in" / "1.txt").write_text("total price")
    stream = spark.readStream.format("text").load(folder).withColumnRenamed("value", "text")
    query = labelled_stream(stream, root, out, checkpoint, processingTime="500 milliseconds")
    try:
        until(lambda: len(rows(spark, f"{out}/rows")) == 1)
        second = rules(("note", "total", 3.0), ("bill", "price", 1.0))
        (tmp_path / "in" / "2.txt").write_text("total price")
        until(lambda: len(rows(spark, f"{out}/rows")) == 2)
    finally:
        query.stop()
    found = {r["rules_version"]: [(x["label"], x["score"]) for x in r["labels"]] for r in rows(spark, f"{out}/rows")}
    assert found == {first: [("bill", 2.0), ("note", 1.5)], second: [("note", 3.0), ("bill", 1.0)]}
    # A batch that is run again takes the rules that it had.
    done = {r["version"] for r in rows(spark, f"{out}/_versions")}
    assert done >= {first, second}


def test_rules_of_odd_tables(spark, tmp_path):
    root = str(tmp_path / "rules")
    publish(spark.createDataFrame([], "label string, pattern string, weight double"), root)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    assert [r["labels"] for r in label_rows(df, root).collect()] == [[], []]
    publish(spark.range(2001).select(F.lit("l").alias("label"), F.col("id").cast("string").alias("pattern"), F.lit(1.0).alias("weight")), root)
    with pytest.raises(ValueError, match="2000"):
        read_rules(spark, root)
